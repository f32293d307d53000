"""Evaluation metrics and reports."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.geo import THRESHOLDS_KM, report_geoscore
from quillmark.operators.compose import medians, running_total

UNKNOWN = "UNKNOWN"


def group_key(c: str) -> Column:
    return F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", UNKNOWN).otherwise(F.col(c))


def geo_report(rows: DataFrame, groups: tuple[str, ...], status: str = "status", km: str = "distance", by: tuple[str, ...] = ()) -> DataFrame:
    """Overall and by each group: counts by status, hits within each threshold over
    all rows (<=), distance over valid rows, GeoScore with failures as 0.

    ``by`` names columns of which each combination is reported on its own. Sums
    are combined before the shuffle; medians come from counts of values, so no
    group is gathered.
    """
    d = F.when(F.col(status) == 1, F.col(km))
    kinds = F.array(F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("key")), *[F.struct(F.lit(g).alias("kind"), group_key(g).alias("key")) for g in groups])
    keyed = rows.select(*by, F.col(status).alias("__st"), d.alias("__d"), F.coalesce(report_geoscore(d), F.lit(0.0)).alias("__s"), F.inline(kinds).alias("group_kind", "group_key"))
    by = [*by, "group_kind", "group_key"]
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("__st") == 1).alias("ok"), F.count_if(F.col("__st") == 0).alias("unparsed"), F.count_if(F.col("__st") == -1).alias("failed"),
        *[(F.count_if(F.col("__d") <= t) / F.count(F.lit(1))).alias(f"acc_{t}km") for t in THRESHOLDS_KM],
        F.avg("__d").alias("distance_mean"), F.avg("__s").alias("geoscore_mean"),
    ]
    out = keyed.groupBy(*by).agg(*aggs).join(medians(keyed, by, "__d", "distance_median"), by, "left").join(medians(keyed, by, "__s", "geoscore_median"), by, "left")
    return out.select(*by, *[c for c in out.columns if c.startswith(("rows", "ok", "un", "fail", "acc"))], "distance_mean", "distance_median", "geoscore_mean", "geoscore_median")


def geo_report_by_file(rows: DataFrame, groups: tuple[str, ...], file: str = "file", status: str = "status", km: str = "distance") -> DataFrame:
    """``geo_report`` of each file (a null or blank one is UNKNOWN) and, if there are several, of all as ``combined``."""
    named = rows.withColumn("__file", group_key(file))
    several = F.broadcast(named.agg((F.count_distinct("__file") > 1).alias("__several")))
    both = named.join(several).withColumn("report", F.explode(F.when(F.col("__several"), F.array(F.col("__file"), F.lit("combined"))).otherwise(F.array("__file"))))
    return geo_report(both, groups, status, km, ("report",))


#: Titles of a text report's lines, and their formats. Fixed values.
_LINES = (
    ("大洲级准确率 (2500km, 失败=0): ", "acc_2500km", "%.4f", ""), ("国家级准确率 (750km, 失败=0): ", "acc_750km", "%.4f", ""), ("区域级准确率 (200km, 失败=0): ", "acc_200km", "%.4f", ""),
    ("城市级准确率 (25km, 失败=0): ", "acc_25km", "%.4f", ""), ("街道级准确率 (1km, 失败=0): ", "acc_1km", "%.4f", ""), ("平均距离 (仅有效预测): ", "distance_mean", "%.2f", " km"),
    ("中位数距离 (仅有效预测): ", "distance_median", "%.2f", " km"), ("平均GeoScore (失败=0): ", "geoscore_mean", "%.1f", ""), ("中位数GeoScore (失败=0): ", "geoscore_median", "%.1f", ""),
)


def report_text(report: DataFrame, titles: dict[str, str], by: tuple[str, ...] = ("report",)) -> DataFrame:
    """``text`` of each report: its groups' lines between rules, the overall one first, then the kinds of ``titles`` in their order.

    A title holds ``{key}`` where the group's name goes. A report has a row for
    each group, so one text is as long as it has groups.
    """
    rule = "=" * 50
    title, rank = F.when(F.col("group_kind") == "overall", F.lit("总体")), F.when(F.col("group_kind") == "overall", 0)
    for i, (kind, text) in enumerate(titles.items()):
        title = title.when(F.col("group_kind") == kind, F.replace(F.lit(text), F.lit("{key}"), F.col("group_key")))
        rank = rank.when(F.col("group_kind") == kind, i + 1)
    counts = F.concat(F.lit("{1: "), F.col("ok"), F.lit(", 0: "), F.col("unparsed"), F.lit(", -1: "), F.col("failed"), F.lit("}"))
    lines = [F.lit(rule), F.concat(title, F.lit("评测结果:")), F.concat(F.lit("总样本数: "), "rows"), F.concat(F.lit("有效预测数: "), "ok"), F.concat(F.lit("状态统计: "), counts)]
    lines += [F.concat(F.lit(a), F.format_string(f, F.coalesce(F.col(c), F.lit(0.0))), F.lit(z)) for a, c, f, z in _LINES]
    part = F.struct(rank.alias("rank"), F.col("group_key"), F.array_join(F.array(*lines, F.lit(rule)), "\n").alias("text"))
    known = report.where(rank.isNotNull())
    return known.groupBy(*by).agg(F.array_sort(F.collect_list(part)).alias("p")).select(*by, F.concat(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))


def geo_accuracy_valid_only(km: Column, threshold: float) -> Column:
    """The older rule: strictly nearer, in percent, over rows with a distance."""
    return 100.0 * F.count_if(km < threshold) / F.nullif(F.count(km), F.lit(0))


def ranking(df: DataFrame, order: str, label: str, score: str) -> DataFrame:
    """Mean reciprocal rank and NDCG of lists that each start at a positive row.

    Lists are runs of ``order`` in ``df``'s column ``part``; shorter than two
    rows they do not count.
    """
    running = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    g = df.withColumn("grp", F.sum((F.col(label) == 1).cast("int")).over(running)).where("grp > 0")
    w = Window.partitionBy("part", "grp")
    g = g.withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 2")
    g = g.withColumn("pos", F.row_number().over(w.orderBy(F.desc(score), order))).withColumn("ideal", F.row_number().over(w.orderBy(F.desc(label), order)))
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    per = g.groupBy("part", "grp").agg(
        F.max(F.when(F.col(label) == 1, 1.0 / F.col("pos")).otherwise(0.0)).alias("rr"),
        (F.sum(gain / F.log2(F.col("pos") + 1.0)) / F.sum(gain / F.log2(F.col("ideal") + 1.0))).alias("ndcg"),
    )
    return per.agg(F.count(F.lit(1)).alias("lists"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarities(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine, dot, and negated L1 and L2 distances of two vector columns."""
    x, y = F.col(a), F.col(b)
    diff = F.zip_with(x, y, lambda p, q: p.cast("double") - q.cast("double"))
    return df.select("*", (dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))).alias("cosine"), dot(x, y).alias("dot"),
                     (-F.aggregate(diff, F.lit(0.0), lambda s, v: s + F.abs(v))).alias("neg_l1"), (-F.sqrt(dot(diff, diff))).alias("neg_l2"))


def pearson(x: str, y: str, eps: float = 1e-18) -> Column:
    return F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y) + eps)


def label_correlations(df: DataFrame, scores: list[str], label: str) -> DataFrame:
    """``name, pearson, spearman`` of each score against a label; ties get their mean rank.

    Rows where either is null are left out; one row, or a constant, gives null.
    Ranks come from range parts, so no task sorts the whole table.
    """
    out = None
    for s in scores:
        d = df.select(F.col(s).cast("double").alias("x"), F.col(label).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
        for c in ("x", "y"):
            counts = d.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            ranks = running_total(counts, [F.col(c)], F.col("n"), "before").select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))
            d = d.join(ranks, c)
        one = d.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman")).select(F.lit(s).alias("name"), "pearson", "spearman")
        out = one if out is None else out.unionByName(one)
    return out


def length_stats(df: DataFrame, length: str) -> DataFrame:
    c = F.col(length)
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("size"))


def off_policy(df: DataFrame, sequence: str, old: str, new: str, mask: str | None = None) -> DataFrame:
    """KL, k3, perplexities, their differences and chi-squares of token log-probabilities.

    Tokens that ``mask`` leaves out count nowhere; a sequence of such tokens
    alone has log-probabilities of 0. Ratios are clamped at 20 where they are raised to a power.
    """
    on = F.lit(True) if mask is None else F.coalesce(F.col(mask).cast("boolean"), F.lit(False))
    bound = lambda x: F.greatest(F.least(x, F.lit(20.0)), F.lit(-20.0))
    kept = lambda x: F.when(on, x)
    r = F.col(new) - F.col(old)
    mean = lambda x: F.coalesce(F.avg(kept(x)), F.lit(0.0))
    seq = df.groupBy(sequence).agg(
        mean(r).alias("mr"), mean(F.col(old)).alias("mo"), mean(F.col(new)).alias("mn"), F.sum(kept(F.exp(bound(r)) - 1 - bound(r))).alias("k3"), F.sum(kept(-bound(r))).alias("kl"),
        F.sum(kept(F.exp(2 * bound(r)) - 1)).alias("chi"), F.count_if(on).alias("n"))
    diff = F.col("mo") - F.col("mn")
    return seq.agg(
        (F.sum("kl") / F.sum("n")).alias("kl"), (F.sum("k3") / F.sum("n")).alias("k3_kl"), (F.sum("chi") / F.sum("n")).alias("chi2_token"), F.avg(F.exp(2 * bound(F.col("mr"))) - 1).alias("chi2_seq"),
        F.avg(F.exp(-F.col("mn"))).alias("training_ppl"), F.avg(F.exp(-F.col("mo"))).alias("rollout_ppl"), F.avg(-F.col("mn")).alias("training_log_ppl"), F.avg(-F.col("mo")).alias("rollout_log_ppl"),
        F.avg(diff).alias("log_ppl_diff"), F.avg(F.abs(diff)).alias("log_ppl_abs_diff"), F.max(diff).alias("log_ppl_diff_max"), F.min(diff).alias("log_ppl_diff_min"), F.avg(F.exp(diff)).alias("ppl_ratio"),
    )


def importance_correction(df: DataFrame, sequence: str, log_ratio: str, weight: str, mode: str = "token_truncate", limit: float = 2.0, mask: str | None = None) -> DataFrame:
    """``is_weight_mean, ess, clipped_frac`` of corrected weights.

    The clipped share is that of tokens over the limit (``token_truncate``), of
    tokens whose weight became 0 (``token_mask``), or of sequences whose
    geometric mean of ratios is over it (``sequence_truncate``, ``sequence_mask``).
    """
    if mode not in ("token_truncate", "token_mask", "sequence_truncate", "sequence_mask"):
        raise ValueError(f"unknown mode {mode!r}")
    on = F.lit(True) if mask is None else F.coalesce(F.col(mask).cast("boolean"), F.lit(False))
    kept = df.where(on)
    r = F.greatest(F.least(F.col(log_ratio), F.lit(20.0)), F.lit(-20.0))
    base = effective_sample_size(kept, weight, limit)
    if mode == "token_truncate":
        clipped = kept.agg(F.avg((F.exp(r) > limit).cast("double")).alias("clipped_frac"))
    elif mode == "token_mask":
        clipped = kept.agg(F.avg((F.col(weight) == 0).cast("double")).alias("clipped_frac"))
    else:
        each = kept.groupBy(sequence).agg(F.exp(F.avg(r)).alias("g"))
        clipped = each.agg(F.avg((F.col("g") > limit).cast("double")).alias("clipped_frac"))
    return base.join(clipped)


def rewards_by_function(df: DataFrame, rewards: list[str]) -> DataFrame:
    """``name, mean, std, n``: each reward's mean and sample deviation over its values that are neither null nor nan."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("x")) for c in rewards])))
    return each.groupBy("name").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("x").alias("n"))


def kto_bounds(df: DataFrame, label: str, desirable_weight: float = 1.0, undesirable_weight: float = 1.0) -> DataFrame:
    """Weight ranges that balance desirable and undesirable rows between 1:1 and 4:3, each given the other's weight."""
    g = df.agg(F.count_if(F.col(label)).alias("desirable"), F.count_if(~F.col(label)).alias("undesirable"))
    d, u = F.greatest("desirable", F.lit(1)) * desirable_weight, F.greatest("undesirable", F.lit(1)) * undesirable_weight
    n, m = F.greatest("desirable", F.lit(1)), F.greatest("undesirable", F.lit(1))
    return g.select("*", (u / n).alias("desirable_low"), (u * 1.33 / n).alias("desirable_high"), (d / (m * 1.33)).alias("undesirable_low"), (d / m).alias("undesirable_high"))


def _f1(hits: int, a: int, b: int) -> float:
    return 2 * hits / (a + b) if a and b else 0.0


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, all of ``b`` at once for each word of ``a``: one bit a word of ``b``."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(b)) - 1
    row = whole  # a zero bit where the length grows
    for w in a:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & whole
    return len(b) - row.bit_count()


def _grams(w: list[str], n: int) -> Iterator:
    return iter(w) if n == 1 else zip(*(w[k:] for k in range(n)), strict=False)


def _hits(hypothesis: list[str], reference: Counter, n: int) -> int:
    """n-grams in common, as multisets; only those that the reference has are counted."""
    got = Counter(filter(reference.__contains__, _grams(hypothesis, n)))
    return sum(min(c, reference[g]) for g, c in got.items())


def rouge_n(df: DataFrame, key: str, hypothesis: Column, reference: Column, n: int) -> DataFrame:
    """``key`` and ROUGE-n F in percent of two arrays of words, a row per input row; 0 if either has no n-gram.

    Rows are independent: n-grams are counted where they are, and nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            known: dict[tuple, Counter] = {}  # many rows share a reference
            for h, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, r = h or [], tuple(r or ())
                if r not in known:
                    known[r] = Counter(_grams(list(r), n))
                a, b_ = max(len(h) - n + 1, 0), max(len(r) - n + 1, 0)
                out.append(200.0 * _hits(h, known[r], n) / (a + b_) if a and b_ else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=[key, f"rouge_{n}"])

    rows = df.select(F.col(key).alias(key), hypothesis.alias("h"), reference.alias("r"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField(f"rouge_{n}", T.DoubleType())]))


def rouge_bleu(hypothesis: list[str], reference: list[str]) -> dict[str, float]:
    """ROUGE-1/2/L F and smoothed BLEU-4 of word lists, in percent."""
    total = lambda w, n: max(len(w) - n + 1, 0)
    hits = {n: _hits(hypothesis, Counter(_grams(reference, n)), n) for n in range(1, 5)}
    out = {f"rouge_{n}": 100 * _f1(hits[n], total(hypothesis, n), total(reference, n)) for n in (1, 2)}
    known = set(reference)  # other words cannot lengthen the common subsequence
    out["rouge_l"] = 100 * _f1(common_subsequence([w for w in hypothesis if w in known], reference), len(hypothesis), len(reference))
    logs, misses = 0.0, 1.0
    for n in range(1, 5):
        if not hits[n]:
            misses *= 2
        logs += math.log((hits[n] or 1 / misses) / max(1, total(hypothesis, n))) / 4
    short = min(0.0, 1 - len(reference) / max(1, len(hypothesis)))
    out["bleu_4"] = 100 * math.exp(short + logs) if hypothesis and reference else 0.0
    return out


def rouge_bleu_rows(df: DataFrame, key: str, hypothesis: str, reference: str) -> DataFrame:
    """Row scores over blank-separated words, in Arrow batches; empty texts score 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [rouge_bleu((h or "").split(), (r or "").split()) for h, r in zip(b["h"], b["r"], strict=True)]
            yield pd.DataFrame({"id": b["id"], **{k: [round(g[k], 6) for g in got] for k in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")}})

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(hypothesis).alias("h"), F.col(reference).alias("r"))
    return rows.mapInPandas(run, "id long, rouge_1 double, rouge_2 double, rouge_l double, bleu_4 double")


def token_accuracy(df: DataFrame, prediction: str, label: str, ignore: int = -100) -> DataFrame:
    """Token and sequence accuracy: predictions shifted by one, ignored labels left out."""
    pairs = F.arrays_zip(F.slice(prediction, F.lit(1), F.greatest(F.size(prediction) - 1, F.lit(0))).alias("p"), F.slice(label, F.lit(2), F.greatest(F.size(label) - 1, F.lit(0))).alias("l"))
    kept = F.filter(pairs, lambda x: x["l"].isNotNull() & (x["l"] != ignore))
    hits = F.size(F.filter(kept, lambda x: x["p"] == x["l"]))
    rows = df.select(hits.alias("h"), F.size(kept).alias("n"))
    return rows.agg((F.sum("h") / F.nullif(F.sum("n"), F.lit(0))).alias("token_acc"), F.avg((F.col("h") == F.col("n")).cast("double")).alias("seq_acc"))


def infonce(df: DataFrame, batch: str, row: str, query: str, doc: str) -> DataFrame:
    """Mean similarity of positives and of in-batch negatives, and their margin.

    Each query meets each document of its batch, whose size is fixed: the join
    grows with rows times the size of a batch.
    """
    q = df.select(batch, F.col(row).alias("i"), F.col(query).alias("q"))
    d = df.select(batch, F.col(row).alias("j"), F.col(doc).alias("d"))
    s = q.join(d, batch).select("i", "j", (dot(F.col("q"), F.col("d")) / F.sqrt(dot(F.col("q"), F.col("q")) * dot(F.col("d"), F.col("d")))).alias("s"))
    pos, neg = F.avg(F.when(F.col("i") == F.col("j"), F.col("s"))), F.avg(F.when(F.col("i") != F.col("j"), F.col("s")))
    return s.agg(pos.alias("mean_pos"), neg.alias("mean_neg"), (pos - neg).alias("margin"))


def effective_sample_size(df: DataFrame, weight: str, limit: float = 2.0) -> DataFrame:
    """Mean weight and 1 / E[(w / E[w])^2], weights clamped to [1 / limit, limit]."""
    w = F.least(F.greatest(F.col(weight), F.lit(1 / limit)), F.lit(limit))
    g = df.agg(F.avg(weight).alias("is_weight_mean"), F.avg(w).alias("m"), F.avg(w * w).alias("m2"))
    return g.select("is_weight_mean", (1.0 / F.greatest(F.col("m2") / F.pow(F.col("m") + 1e-8, 2), F.lit(1e-10))).alias("ess"))


def sequence_mask(df: DataFrame, sequence: str, old: str, new: str, advantage: str, delta: float) -> DataFrame:
    """Sequences that stay: not both far off policy and of negative advantage."""
    g = df.groupBy(sequence).agg(F.avg(F.col(old) - F.col(new)).alias("off"), F.max(advantage).alias("advantage"))
    return g.where(~((F.col("off") > delta) & (F.col("advantage") < 0)))


def reward_metrics(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Mean, sample deviation and share of groups without variance."""
    g = df.groupBy(group).agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s"), F.sum(reward).alias("t"), F.count(reward).alias("n"), F.sum(F.col(reward) * F.col(reward)).alias("q"))
    mean = F.sum("t") / F.sum("n")
    var = (F.sum("q") - F.sum("n") * mean * mean) / (F.sum("n") - 1)
    return g.agg(mean.alias("reward"), F.sqrt(var).alias("reward_std"), F.avg((F.col("s") == 0).cast("double")).alias("frac_zero_std"))


def distance_summary(df: DataFrame, km: str) -> DataFrame:
    """Mean, median and the nearest-rank p90: the sorted value at min(n - 1, max(0, int(0.9 n) - 1)).

    Equal values are counted first, so that one that most rows share is one row.
    """
    counts = df.where(F.col(km).isNotNull()).groupBy(F.col(km).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    n = F.broadcast(counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")))
    r = running_total(counts, [F.col("x")], F.col("c"), "below").join(n)
    n = F.col("n")
    holds = lambda k: (F.col("below") < k) & (k <= F.col("below") + F.col("c"))
    middle = holds(F.floor((n + 1) / 2)) | holds(F.floor(n / 2) + 1)
    ninth = holds(F.least(n - 1, F.greatest(F.lit(0), F.floor(n * 0.9) - 1)) + 1)
    return r.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"),
        F.avg(F.when(middle, F.col("x"))).alias("median"), F.max(F.when(ninth, F.col("x"))).alias("p90"))


def contrastive(df: DataFrame, similarity: str, label: str, margin: float = 0.5) -> DataFrame:
    """Contrastive loss over distances (1 - similarity)."""
    d = 1 - F.col(similarity)
    return df.agg(F.avg(0.5 * (F.col(label) * d * d + (1 - F.col(label)) * F.pow(F.greatest(F.lit(0.0), margin - d), 2))).alias("loss"))


def cosine_loss(df: DataFrame, similarity: str, label: str) -> DataFrame:
    """Mean squared difference of similarities and labels."""
    return df.agg(F.avg(F.pow(F.col(similarity) - F.col(label), 2)).alias("loss"))


def online_contrastive(df: DataFrame, similarity: str, label: str, batch: str, margin: float = 0.5) -> DataFrame:
    """``batch, loss``: the sum over the hard pairs of a batch alone, by distances (1 - similarity).

    Negatives count that are nearer than the farthest positive, positives that
    are farther than the nearest negative; where there is at most one of the
    other kind, the mean of a pair's own kind is the limit.
    """
    rows = df.select(F.col(batch).alias("batch"), (1 - F.col(similarity)).alias("d"), (F.col(label) == 1).alias("p"))
    far, near = F.when(F.col("p"), F.col("d")), F.when(~F.col("p"), F.col("d"))
    limits = rows.groupBy("batch").agg(
        F.when(F.count(far) > 1, F.max(far)).otherwise(F.avg(near)).alias("below"), F.when(F.count(near) > 1, F.min(near)).otherwise(F.avg(far)).alias("above"))
    hard = F.when(F.col("p") & (F.col("d") > F.col("above")), F.pow("d", F.lit(2))).when(~F.col("p") & (F.col("d") < F.col("below")), F.pow(F.greatest(F.lit(0.0), margin - F.col("d")), 2)).otherwise(0.0)
    return rows.join(limits, "batch").groupBy("batch").agg(F.sum(hard).alias("loss"))


def pointwise_loss(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Mean binary cross entropy of logits."""
    x = F.col(logit)
    return df.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * F.col(label) + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def listwise_loss(df: DataFrame, logit: str, label: str, group: str, temperature: float = 1.0, min_size: int = 2) -> DataFrame:
    """Cross entropy of the positive among its group, mean over groups of ``min_size`` or more; 0 without any such group."""
    rows = df.select(F.col(group).alias("g"), (F.col(logit) / temperature).alias("x"), (F.col(label) == 1).alias("p"))
    tops = rows.groupBy("g").agg(F.max("x").alias("top"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    sums = rows.join(tops, "g").groupBy("g").agg((F.log(F.sum(F.exp(F.col("x") - F.col("top")))) + F.max("top") - F.max(F.when(F.col("p"), F.col("x")))).alias("loss"))
    return sums.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


#: Losses by name; add to it to plug in others.
LOSSES = {"infonce": infonce, "contrastive": contrastive, "cosine_similarity": cosine_loss, "online_contrastive": online_contrastive, "pointwise_reranker": pointwise_loss, "listwise_reranker": listwise_loss}


def best_runs(df: DataFrame, metric: str, group: str) -> DataFrame:
    """Marks the runs that reach their group's best metric."""
    top = F.max(metric).over(Window.partitionBy(group))
    return df.withColumn("best", F.abs(F.col(metric) - top) <= 1e-9 * F.greatest(F.abs(top), F.lit(1.0)))
