"""Task-dependent encodings of records and packed rows.

``encode`` is any expression from messages to an array of tokens; words
between blanks stand in where no tokenizer is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import templates
from quillmark.operators.compose import ranked, uniform
from quillmark.operators.normalize import MESSAGES, expand_rejected, remove_response

Encoder = Callable[[Column], Column]


def words(messages: Column) -> Column:
    return F.flatten(F.transform(messages, lambda m: F.array_remove(F.split(F.trim(m["content"]), r"\s+"), "")))


def characters(text: Column) -> Column:
    """Code points: the tokens of a text where no tokenizer is given."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def labelled(df: DataFrame, template: str = "chatml", loss: str = "default", tokens: Callable[[Column], Column] = characters) -> DataFrame:
    """Adds ``input_ids``, ``labels`` (-100 where nothing is learned) and, unless all weights are 0 or 1, ``loss_scale``."""
    binary = templates.is_binary(loss)
    df = templates.with_pieces(df, template, loss, name="__pieces")
    one = lambda p: F.transform(tokens(p["text"]), lambda t: F.struct(t.alias("t"), p["weight"].alias("w")))
    df = df.withColumn("__tokens", F.flatten(F.transform("__pieces", one)))
    df = df.withColumn("input_ids", F.transform("__tokens", lambda x: x["t"])).withColumn("labels", F.transform("__tokens", lambda x: F.when(x["w"] > 0, x["t"]).otherwise(-100)))
    if not binary:
        df = df.withColumn("loss_scale", F.transform("__tokens", lambda x: x["w"]))
    return df.drop("__pieces", "__tokens")


def _headless(c: str, values: Column) -> Column:
    """The first token of a cut row has nothing before it to be learned from."""
    if c == "input_ids":
        return values
    blank = F.lit(-100) if c == "labels" else F.lit(0.0)
    return F.transform(values, lambda x, i: F.when(i == 0, blank).otherwise(x))


def truncated(df: DataFrame, max_length: int, strategy: str = "right", protected: tuple[int, ...] = ()) -> DataFrame:
    """Rows over ``max_length`` tokens: cut on the ``right`` or ``left``, ``split`` into rows, ``delete``d or refused (``raise``).

    Protected tokens are never cut: of the others the first (right) or last
    (left) stay, as many as there is room for; protected ones alone may be over
    the limit. ``labels`` and ``loss_scale`` are cut alike. Null rows stay.
    """
    keys = [c for c in ("input_ids", "labels", "loss_scale") if c in df.columns]
    too_long = F.coalesce(F.size("input_ids") > max_length, F.lit(False))
    if strategy == "delete":
        return df.where(~too_long)
    if strategy == "raise":
        return df.withColumn("input_ids", F.when(too_long, F.raise_error(F.lit(f"a row is longer than {max_length}"))).otherwise(F.col("input_ids")))
    if strategy == "split":
        # Cut before they are exploded, so that no part carries the whole row.
        starts = F.sequence(F.lit(0), F.size("input_ids") - 1, F.lit(max_length))
        parts = F.transform(starts, lambda s: F.struct(*[F.slice(F.col(c), s + 1, F.lit(max_length)).alias(c) for c in keys]))
        df = df.withColumn("__long", too_long).withColumn("__part", F.explode(F.when(too_long, parts).otherwise(F.array(F.struct(*keys)))))
        part = lambda c: F.col("__part")[c]
        return df.withColumns({c: F.when(F.col("__long"), _headless(c, part(c))).otherwise(part(c)) for c in keys}).drop("__long", "__part")
    if strategy not in ("left", "right"):
        raise ValueError(f"no truncation strategy: {strategy}")
    kept_always = lambda t: t.isin(*protected) if protected else F.lit(False)
    free = F.filter(F.transform("input_ids", lambda t, i: F.when(~kept_always(t), i)), lambda i: i.isNotNull())
    df = df.withColumn("__free", F.when(too_long, free)).withColumn("__zip", F.when(too_long, F.arrays_zip(*keys)))
    room = F.greatest(max_length - F.size("input_ids") + F.size("__free"), F.lit(0))
    edge = F.coalesce(F.get("__free", room - 1), F.lit(-1)) if strategy == "right" else F.coalesce(F.get("__free", F.size("__free") - room), F.size("input_ids"))
    df = df.withColumn("__edge", edge)
    inside = (lambda i: i <= F.col("__edge")) if strategy == "right" else (lambda i: i >= F.col("__edge"))
    df = df.withColumn("__kept", F.filter("__zip", lambda z, i: kept_always(z["input_ids"]) | inside(i)))
    cut = {c: F.when(too_long, _headless(c, F.col("__kept")[c])).otherwise(F.col(c)) for c in keys}
    return df.withColumns(cut).drop("__free", "__zip", "__edge", "__kept")


def add_length(df: DataFrame, encode: Encoder = words, max_length: int | None = None) -> DataFrame:
    """Adds ``lengths``; rows over the limit go."""
    df = df.withColumn("lengths", F.array(F.size(encode(F.col("messages")))))
    return df.where(F.array_max("lengths") <= max_length) if max_length else df


def rlhf(df: DataFrame, encode: Encoder = words, also: tuple[str, ...] = ()) -> DataFrame:
    """``chosen_*`` and ``rejected_*`` of preference rows."""
    rejected = F.col("rejected_messages") if "rejected_messages" in df.columns else expand_rejected(F.col("messages"), F.col("rejected_response"))
    keep = [F.col(c) for c in ("margin", *also) if c in df.columns]
    return df.select(encode(F.col("messages")).alias("chosen_input_ids"), encode(rejected).alias("rejected_input_ids"), *keep)


def kto(df: DataFrame, encode: Encoder = words, also: tuple[str, ...] = ()) -> DataFrame:
    """Like ``rlhf``, but a rejected answer may be missing; ``label`` is whether the answer is wanted (null: no)."""
    none = F.lit(None).cast("string")
    rows = rlhf(df.withColumn("__label", F.coalesce(F.col("label").cast("boolean"), F.lit(False))).withColumn("rejected_response", F.col("rejected_response") if "rejected_response" in df.columns else none), encode, ("__label", "rejected_response", *also))
    missing = F.col("rejected_response").isNull() if "rejected_messages" not in df.columns else F.lit(False)
    return rows.withColumn("rejected_input_ids", F.when(~missing, F.col("rejected_input_ids"))).drop("rejected_response").withColumnRenamed("__label", "label")


def classified(df: DataFrame, encode: Encoder = words, single: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Tokens and the label of a classification, an integer where one class holds; null labels stay null."""
    return df.select(encode(F.col("messages")).alias("input_ids"), (F.col("label").cast("int") if single else F.col("label")).alias("labels"), *also)


#: Modes of encoding; those that serve a model encode as training does.
MODES = ("train", "transformers", "vllm", "lmdeploy", "sglang", "rlhf", "kto")


def dispatch(
    df: DataFrame, task: str = "causal_lm", mode: str = "train", training: bool = True, encode: Encoder = words, template: str = "chatml", loss: str = "default", return_lengths: bool = False,
) -> DataFrame:
    """The encoding that a task and a mode call for; a column ``channel`` goes through.

    ``return_lengths`` adds ``lengths``: the number of tokens of each sequence
    of a row, in the order of its columns, missing ones left out.
    """
    if mode not in MODES:
        raise ValueError(f"no mode: {mode}")
    also = ("channel",) if "channel" in df.columns else ()
    if task in ("causal_lm", "prm") and (mode not in ("rlhf", "kto") or task == "prm"):
        if task == "causal_lm" and not training:
            df = df.withColumn("messages", remove_response(F.col("messages"))[0])
        out = labelled(df, template, loss)
    elif task in ("causal_lm", "seq_cls") and mode == "rlhf":
        out = rlhf(df, encode, also)
    elif task == "causal_lm":
        out = kto(df, encode, also)
    elif task == "seq_cls":
        out = classified(df, encode, also=also)
    elif task in ("embedding", "reranker", "generative_reranker"):
        if not training:
            out = df.select(encode(F.col("messages")).alias("input_ids"), *also)
        else:
            out = embedding(df, encode, also) if task == "embedding" else rerank(df, encode, also)
    else:
        raise ValueError(f"no task: {task}")
    return with_lengths(out) if return_lengths else out


def with_lengths(df: DataFrame) -> DataFrame:
    """Adds ``lengths`` of all columns of token ids, those of lists of sequences one by one."""
    parts = []
    for name, kind in df.dtypes:
        if name.endswith("input_ids"):
            one = F.transform(name, lambda x: F.size(x)) if kind.startswith("array<array") else F.array(F.size(name))
            parts.append(F.when(F.col(name).isNotNull(), one).otherwise(F.array().cast("array<int>")))
    return df.withColumn("lengths", F.concat(*parts))


def embedding(df: DataFrame, encode: Encoder = words, also: tuple[str, ...] = ()) -> DataFrame:
    """Anchor, first positive, negatives; labels: the label (or 1), then a 0 for each negative."""
    first = F.get("positive_messages", F.lit(0))
    negatives = F.coalesce(F.col("negative_messages"), F.array()) if "negative_messages" in df.columns else F.array().cast(f"array<{MESSAGES}>")
    label = F.coalesce(F.col("label").cast("double"), F.lit(1.0)) if "label" in df.columns else F.lit(1.0)
    return df.select(
        encode(F.col("messages")).alias("anchor_input_ids"), encode(first).alias("positive_input_ids"), F.transform(negatives, encode).alias("negative_input_ids"),
        F.concat(F.array(label), F.transform(negatives, lambda _: F.lit(0.0))).alias("labels"), *also)


def rerank(df: DataFrame, encode: Encoder = words, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document of a query: positives (label 1) first, then negatives (0)."""
    docs = F.concat(F.transform("positive_messages", lambda d: F.struct(d.alias("d"), F.lit(1).alias("label"))), F.transform("negative_messages", lambda d: F.struct(d.alias("d"), F.lit(0).alias("label"))))
    rows = df.select("messages", *also, F.posexplode(docs).alias("position", "x"))
    return rows.select("position", encode(F.concat("messages", F.col("x.d"))).alias("input_ids"), F.col("x.label").alias("label"), *also)


def pack_rows(df: DataFrame, bins: list[str], order: str) -> DataFrame:
    """Concatenates the token rows of a bin; positions restart with every row."""
    g = df.groupBy(*bins).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "input_ids"))).alias("rows"))
    rows = F.transform("rows", lambda r: r["input_ids"])
    places = F.flatten(F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.sequence(F.lit(0), F.size(r) - 1)))
    return g.select(*bins, F.flatten(rows).alias("input_ids"), places.alias("position_ids"), F.transform(rows, lambda r: F.size(r)).alias("lengths"))


def length_batches(df: DataFrame, length: str, ids: tuple[str, ...], size: int, seed: int = 42, drop_last: bool = False) -> DataFrame:
    """Batches of rows of like length: megabatches of 50 batches in hash order, each sorted by length."""
    r = ranked(df, [uniform(seed, *[F.col(c) for c in ids]), *[F.col(c) for c in ids]], "__i")
    r = ranked(r.withColumn("__m", F.floor((F.col("__i") - 1) / (size * 50))), [F.col("__m"), -F.col(length), *[F.col(c) for c in ids]], "__j")
    r = r.withColumn("batch", F.floor((F.col("__j") - 1) / size)).drop("__i", "__j", "__m")
    if not drop_last:
        return r
    full = r.groupBy("batch").count().where(F.col("count") == size).select("batch")
    return r.join(full, "batch", "left_semi")
