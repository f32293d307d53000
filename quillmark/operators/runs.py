"""Selection runs: manifests to items, samples to statistics, files on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import geo, text
from quillmark.operators import stats
from quillmark.operators.compose import concat, ranked

#: Column names that mean the same in manifests, best first (fixed values).
FIELDS = {
    "image_path": ("image", "images", "image_path", "path", "file_name", "filename", "relative_path"),
    "gt_text": ("gt_text", "ground_truth", "ground_truth_text", "label", "answer", "solution", "location", "gt"),
    "gt_latitude": ("gt_latitude", "latitude", "lat", "gt_lat"),
    "gt_longitude": ("gt_longitude", "longitude", "lon", "lng", "gt_lon", "gt_lng"),
}


def common_fields(df: DataFrame, override: dict[str, str] | None = None) -> DataFrame:
    """Standard names for a manifest: the override, else the first alias that is present."""
    override = override or {}
    out = []
    for name, aliases in FIELDS.items():
        hit = override.get(name) or next((a for a in aliases if a in df.columns), None)
        kind = "double" if name.endswith("tude") else "string"
        out.append((F.col(hit).try_cast(kind) if hit else F.lit(None).cast(kind)).alias(name))
    return df.select(*out)


def build_items(images: DataFrame, annotations: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Images with their annotation (the last of a path), else their sidecar; without ground truth they go.

    ``annotations`` and ``sidecars`` have ``image_path`` and the ground truth;
    ``annotations`` may have ``ord``, the order of its rows, and ``place``, of
    which the least decides among rows that tie.
    """
    order = [F.desc("ord")] if "ord" in annotations.columns else [F.desc("gt_text")]
    order += [F.col("place")] if "place" in annotations.columns else []
    last = stats.dedup(annotations, "image_path", order)
    fields = ["gt_text", "gt_latitude", "gt_longitude"]
    out = images.join(last.select("image_path", F.struct(*fields).alias("a")), "image_path", "left")
    best: Column = F.col("a")
    if sidecars is not None:
        out = out.join(sidecars.select("image_path", F.struct(*fields).alias("b")), "image_path", "left")
        best = F.coalesce(best, F.col("b"))
    out = out.withColumn("gt", best).select("image_path", *[F.col(f"gt.{f}").alias(f) for f in fields])
    out = out.where(F.col("gt_text").isNotNull() | (F.col("gt_latitude").isNotNull() & F.col("gt_longitude").isNotNull()))
    return out.withColumn("item_id", text.item_id(F.col("image_path")))


def expand_samples(items: DataFrame, k: int) -> DataFrame:
    return items.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample_index"))


def incomplete(samples: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Items whose saved generations are not exactly the indices 0 to k - 1."""
    got = samples.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("sample_index")).alias("seen"))
    want = F.sequence(F.lit(0), F.lit(k - 1))
    return items.select("item_id").join(got, "item_id", "left").where(~F.coalesce((F.col("n") == k) & (F.col("seen") == want), F.lit(False))).select("item_id")


def latlon_reward(samples: DataFrame, max_km: float = geo.SELECTOR_MAX_KM) -> DataFrame:
    """Reward of parsed coordinates against the ground truth, with the reason of a zero."""
    p = text.latlon(F.col("raw_output"))
    out = samples.withColumn("parsed", p).withColumn("distance_km", geo.haversine_km(F.col("parsed.lat"), F.col("parsed.lon"), F.col("gt_latitude"), F.col("gt_longitude")))
    error = F.when(F.col("parsed").isNull(), "missing_latlon").when(F.col("gt_latitude").isNull() | F.col("gt_longitude").isNull(), "missing_gt_latlon")
    return out.withColumn("error", error).withColumn("reward", geo.reward_geoscore(F.when(error.isNull(), F.col("distance_km")), max_km))


def geocode_reward(samples: DataFrame, cache: DataFrame, max_km: float = geo.REWARD_MAX_KM, confidence: float = 0.0) -> DataFrame:
    """Reward of a text answer through a lookup table ``key, latitude, longitude, confidence``.

    Ever shorter prefixes of the answer are tried until the table has one.
    """
    answer = text.answer_block(F.col("raw_output"))
    rows = samples.withColumn("parsed_answer", answer)
    tried = rows.select("item_id", "sample_index", F.posexplode(text.geocode_candidates(answer)).alias("pos", "c")).withColumn("key", text.geocode_key(F.col("c")))
    hit = tried.join(cache, "key").groupBy("item_id", "sample_index").agg(F.min_by(F.struct("latitude", "longitude", "confidence"), "pos").alias("g"))
    out = rows.join(hit, ["item_id", "sample_index"], "left")
    error = (
        F.when(F.col("parsed_answer").isNull(), "missing_answer").when(F.col("g").isNull(), "pred_geocode_failed")
        .when(F.col("g.confidence") < confidence, "pred_low_confidence").when(F.col("gt_latitude").isNull(), "gt_geocode_failed"))
    km = geo.haversine_km(F.col("g.latitude"), F.col("g.longitude"), F.col("gt_latitude"), F.col("gt_longitude"))
    return out.withColumn("error", error).withColumn("reward", geo.reward_geoscore(F.when(error.isNull(), km), max_km))


def select_run(samples: DataFrame, items: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Statistics, value, probability and the flag of a weighted sample of k items."""
    scored = stats.value_probability(stats.item_stats(samples, "item_id", "reward", items))
    chosen = stats.gumbel_topk(scored, "probability", k, ("item_id",), seed).select("item_id", F.lit(True).alias("selected"))
    return scored.join(chosen, "item_id", "left").fillna(False, ["selected"])


def run_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items newly selected and dropped between two selections."""
    a, b = (d.where("selected").select("item_id").distinct() for d in (before, after))
    new, gone = b.join(a, "item_id", "left_anti"), a.join(b, "item_id", "left_anti")
    return new.withColumn("change", F.lit("newly_selected")).unionByName(gone.withColumn("change", F.lit("dropped")))


def packaged(df: DataFrame) -> DataFrame:
    """The selected rows, or all rows if none is selected."""
    any_ = df.agg(F.coalesce(F.max(F.col("selected").cast("int")), F.lit(0)).alias("__any"))
    return df.join(F.broadcast(any_)).where((F.col("__any") == 0) | F.col("selected")).drop("__any")


def viewed(df: DataFrame, needle: str = "", selected_only: bool = False, issue_kind: str | None = None, order: str | None = None, descending: bool = True) -> DataFrame:
    """The viewer's filters: a part of id, truth or path, in any case; selected rows; items with errors of a kind, or (``none``) without any.

    With ``order``, ``place`` numbers the rows by it, nulls last, ties by ``item_id``.
    """
    hit = F.contains(F.lower(F.concat_ws("\n", *[F.col(c) for c in ("item_id", "gt_text", "relative_path") if c in df.columns])), F.lit(needle.lower()))
    out = df.where(hit) if needle else df
    out = out.where("selected") if selected_only else out
    if issue_kind == "none":
        out = out.where(F.coalesce("errors", F.lit(0)) == 0)
    elif issue_kind:
        out = out.where(F.coalesce(F.col(f"{issue_kind}s"), F.lit(0)) > 0)
    if not order:
        return out
    key = -F.col(order) if descending else F.col(order)
    return ranked(out, [F.col(order).isNull(), key, F.col("item_id")], "place")


def write_run(folder: str, **tables: DataFrame) -> None:
    """One JSON-lines table a name; ``samples`` is parted by model."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("model_name") if name == "samples" and "model_name" in df.columns else writer).json(f"{folder}/{name}")


def allocate(total: int, models: int) -> list[int]:
    """Samples of each model; the first ones take the remainder."""
    return [total // models + (i < total % models) for i in range(models)]


def issue(parsed: Column, error: Column, mode: Column) -> Column:
    """What went wrong with a sample: no answer, a judge that did not answer, another error; null if nothing did."""
    failed = F.coalesce(error, F.lit("")) != ""
    judge = (error == "judge_json_parse_failed") | (failed & (mode == "llm_judge"))
    return F.when(F.coalesce(parsed, F.lit("")) == "", "generation_error").when(judge, "judge_error").when(failed, "generation_error")


def issue_totals(samples: DataFrame) -> DataFrame:
    """``item_id, generation_errors, judge_errors, errors`` of samples with ``parsed_answer, error, reward_mode``."""
    kind = issue(F.col("parsed_answer"), F.col("error"), F.col("reward_mode"))
    g = samples.withColumn("__kind", kind).groupBy("item_id")
    counts = g.agg(F.count_if(F.col("__kind") == "generation_error").alias("generation_errors"), F.count_if(F.col("__kind") == "judge_error").alias("judge_errors"))
    return counts.withColumn("errors", F.col("generation_errors") + F.col("judge_errors"))


def run_statistics(samples: DataFrame, items: DataFrame) -> DataFrame:
    """One row on a run: sizes, rewards, shares of parsed and cut outputs, probabilities by selection, items with errors.

    Null rewards and probabilities count as zero, sums over nothing as zero.
    """
    reward, p = F.coalesce(F.col("reward"), F.lit(0.0)), F.coalesce(F.col("probability"), F.lit(0.0))
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    of_samples = samples.agg(
        F.count(F.lit(1)).alias("num_samples"), share(reward).alias("reward_mean"), F.coalesce(F.min(reward), F.lit(0.0)).alias("reward_min"), F.coalesce(F.max(reward), F.lit(0.0)).alias("reward_max"),
        share(some("parsed_answer")).alias("parsed_rate"), share(F.coalesce(F.col("truncated"), F.lit(False))).alias("truncated_rate"), share(some("error")).alias("error_rate"))
    chosen = F.coalesce(F.col("selected"), F.lit(False))
    of_items = items.agg(
        F.count(F.lit(1)).alias("num_items"), F.count_if(chosen).alias("num_selected"), share(chosen).alias("selected_rate"), share(p).alias("probability_mean"),
        share(F.when(chosen, p)).alias("selected_probability_mean"), share(F.when(~chosen, p)).alias("unselected_probability_mean"))
    t = issue_totals(samples).agg(F.count_if(F.col("generation_errors") > 0).alias("items_with_generation_error"), F.count_if(F.col("judge_errors") > 0).alias("items_with_judge_error"))
    return of_samples.join(F.broadcast(of_items)).join(F.broadcast(t))


def selection_bins(items: DataFrame, probability: str, selected: str, order: list[str], bins: int = 10) -> DataFrame:
    """``bin, n, p_min, p_max, p_mean, select_rate``: items in equal counts by probability, how many of each are selected."""
    r = ranked(items, [F.col(probability), *[F.col(c) for c in order]], "__rn", "__m")
    b = F.floor((F.col("__rn") * bins - 1) / F.col("__m")) + 1
    x = F.col(probability)
    return r.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("p_min"), F.max(x).alias("p_max"), F.avg(x).alias("p_mean"), F.avg(F.col(selected).cast("double")).alias("select_rate"))


def census(cache: DataFrame, samples: DataFrame) -> DataFrame:
    """``kind, key, n``: statuses, codes and messages of a lookup cache, errors of samples, answers whose lookup failed."""
    def counted(df: DataFrame, kind: str, key: Column) -> DataFrame:
        return df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n")

    failed = samples.where("error = 'pred_geocode_failed'")
    parts = [
        counted(cache, "status", F.coalesce("status", F.lit("missing"))), counted(cache.where("code IS NOT NULL"), "code", F.col("code")),
        counted(cache.where("coalesce(message, '') <> ''"), "message", F.col("message")), counted(samples, "error", F.coalesce("error", F.lit("none"))),
        counted(failed, "failed_answer", F.coalesce("parsed_answer", F.lit(""))),
    ]
    return concat(parts)


def judge_rewards(samples: DataFrame, output: str = "judge_output") -> DataFrame:
    """Reward of a judge's ``output`` for samples with ``gt_text`` and ``parsed_answer``, with the reason of a zero and whether it was cut."""
    said = F.coalesce(F.col(output), F.lit(""))
    verdict = text.judge_verdict(said)
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    error = F.when(missing("gt_text"), "missing_gt_text").when(missing("parsed_answer"), "missing_parsed_answer").when(verdict.isNull(), "judge_json_parse_failed")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), verdict["score"]))
    cut = (said != "") & ~F.endswith(F.rtrim(said), F.lit("}"))
    return samples.withColumn("error", error).withColumn("reward", F.when(error.isNull(), score).otherwise(0.0)).withColumn("truncated", cut)


def with_domain(rows: DataFrame, domain: Column, name: str = "domain") -> DataFrame:
    """Fills a null or empty domain; an unknown one fills nothing."""
    own = F.col(name) if name in rows.columns else F.lit(None).cast("string")
    return rows.withColumn(name, F.when((own.isNull() | (own == "")) & (domain != "UNKNOWN"), domain).otherwise(own))


def benchmark_files(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """The files of a benchmark: the metadata of domain folders, else JSON lines in the root, else JSON that its name calls one.

    Files whose name starts with ``download_`` belong to none of the first two.
    """
    base = root.rstrip("/") + "/"
    d = files.where(F.col(path).startswith(base)).withColumn("__r", F.lower(F.substr(path, F.lit(len(base) + 1)))).withColumn("__n", F.substring_index("__r", "/", -1))
    named = ~F.col("__n").startswith("download_")
    loose = F.col("__n").rlike(r"\.jsonl?$") & ~F.col("__r").rlike("(^|/)shards2/") & ~F.col("__n").contains("metadata") & F.col("__n").rlike(r"bench|_500\.json$|remote_|indoor_")
    tier = F.when(F.col("__r").rlike(r"^[^/]+/[^/]*_metadata\.jsonl$") & named, 1).when(F.col("__r").rlike(r"^[^/]+\.jsonl$") & named, 2).when(loose, 3)
    # A file of an upper kind may be one of a lower kind too, but then the lower kind is not asked for.
    d = d.withColumn("__tier", tier).where("__tier IS NOT NULL")
    best = d.agg(F.min("__tier").alias("__tier"))
    return d.join(F.broadcast(best), "__tier").drop("__tier", "__r", "__n")


def reward_mask(reward: Column, threshold: float | None) -> Column:
    """Strictly above the threshold; without one, all."""
    return F.lit(True) if threshold is None else F.coalesce(reward > threshold, F.lit(False))


def row_key(columns: list[str], leave_out: tuple[str, ...] = ("choices",)) -> Column:
    """MD5 of a row as JSON, its columns in the order of their names."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns) if c not in leave_out])).cast("binary"))
