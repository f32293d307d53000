"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent and normalised. The exponent
is bisected: an exponent of one leaves the shares alone, smaller ones even them
out, which raises the entropy and repeats small sources more often. The target
is either an entropy (as a share of its maximum) to be reached or a number of
repetitions that no source may exceed.

The weights are realised by block permutations under a token budget. A source's
documents are dealt into blocks by a hash; each epoch of the source runs
through its blocks in an order of its own, and the budget of the source cuts
the last epoch within one block. Running sums go over blocks, and over the
documents of the one block that the budget cuts, so no source is ever gathered
in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm._common import BLANKS, Scratch
from quillmark.operators.compose import running_total

#: Target entropy as a share of the entropy of equal weights, and the most repetitions.
ENTROPY, REPETITIONS = 0.97, 4.0
#: Documents a block holds on average.
BLOCK_DOCS = 64
#: The weights of the sources are broadcast up to so many (about 60 bytes each), joined by a shuffle beyond.
BROADCAST_SOURCES = 1_000_000


def tokens(text: Column) -> Column:
    """Words between blanks; a null or blank text has none."""
    t = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def temper(shares: np.ndarray, exponent: float) -> np.ndarray:
    """Weights in proportion to the shares to the exponent; before normalising."""
    top = shares.max() if len(shares) else 1.0
    return np.where(shares > 0, np.power(shares / (top or 1.0), exponent, where=shares > 0, out=np.zeros(len(shares))), 0.0)


def normalised(shares: np.ndarray, counts: np.ndarray, exponent: float) -> np.ndarray:
    raised = temper(shares, exponent)
    return raised / (raised * counts).sum()


def entropy(weights: np.ndarray, counts: np.ndarray | float = 1.0) -> float:
    w = np.asarray(weights, float)
    return float(-(counts * np.where(w > 0, w * np.log(np.where(w > 0, w, 1.0)), 0.0)).sum())


def solve(sizes: list[int], budget: float, target_entropy: float | None, max_repetitions: float | None, counts: list[int] | None = None) -> tuple[float, np.ndarray]:
    """Exponent, and the weight of one source of each of ``sizes``, of which there are ``counts`` (one each).

    Bisects for the largest exponent of [0, 1] that reaches ``target_entropy``,
    then raises it as far as ``max_repetitions`` asks; that limit wins. If even
    an exponent of one breaks it, the budget itself asks for more repetitions
    and one is used.
    """
    n = np.array(sizes, float)
    k = np.ones(len(n)) if counts is None else np.array(counts, float)
    shares, live = n / (n * k).sum(), k[n > 0].sum()

    def bisect(ok: Callable[[np.ndarray], bool], lo: float = 0.0, hi: float = 1.0, rising: bool = True) -> float:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(normalised(shares, k, mid)) == rising else (lo, mid)
        return lo if rising else hi

    exponent = 1.0
    if target_entropy is not None and live > 1:
        goal = target_entropy * math.log(live)
        if entropy(shares, k) < goal:
            exponent = bisect(lambda w: entropy(w, k) >= goal)
    if max_repetitions is not None:
        fits = lambda w: bool((w * budget <= max_repetitions * n * (1 + 1e-12)).all())
        if not fits(normalised(shares, k, exponent)):
            exponent = bisect(fits, exponent, 1.0, rising=False)
    return exponent, normalised(shares, k, exponent)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | None = None,
    target_entropy: float | None = ENTROPY, max_repetitions: float | None = REPETITIONS, block_docs: int = BLOCK_DOCS, seed: int = 1,
) -> DataFrame:
    """``doc_id, source, tokens, weight, exponent, epoch, block, place``: a row per drawn document.

    ``budget`` defaults to the tokens of the table. A source gets its weight of
    the budget in whole documents, the last of which may overrun it. ``epoch``
    counts a document's draws from 1; sorting by ``place`` gives the mixture,
    in which every source is spread evenly. A null source is a source of its
    own. Documents without a token carry no weight and come with every full or
    begun pass of their block. Repeated rows are drawn like others. A table
    without tokens gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens(F.col(text_col)).alias("tokens"), F.xxhash64(F.col(text_col).cast("string")).alias("t"))
    counts = scratch.save(rows.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("docs")).where("size > 0"))
    # Distinct sizes: k of them need k (k + 1) / 2 tokens, so they are few beside the sources of any table.
    kinds = sorted(tuple(r) for r in counts.groupBy("size").count().collect())
    exponent, unit, whole = 1.0, 1.0, float(budget or 0)
    if kinds:
        sizes, many = [r[0] for r in kinds], [r[1] for r in kinds]
        whole = float(budget if budget is not None else sum(s * k for s, k in kinds))
        exponent, weights = solve(sizes, whole, target_entropy, max_repetitions, many)
        unit = float(weights[-1])  # of a source of the greatest size
        top = float(sizes[-1])
        weight = F.pow(F.col("size") / F.lit(top), F.lit(exponent)) * F.lit(unit)
    else:
        weight = F.lit(0.0)
    sources = counts.select("source", "size", weight.alias("weight"), (weight * whole).alias("quota"), F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("long").alias("blocks"))
    if counts.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    dealt = rows.join(sources, same(rows, sources)).select(rows["source"], "doc_id", "tokens", "t", "weight", "quota", "blocks", "size", F.pmod(F.xxhash64("doc_id", "t", F.lit(seed)), F.col("blocks")).alias("block"))
    dealt = scratch.save(dealt.withColumn("source", F.col("source")))
    # Each epoch runs through the blocks in an order of its own, until the quota is met.
    block = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.first("quota").alias("quota"), F.first("size").alias("size"))
    passes = F.ceil(F.col("quota") / F.col("size")).cast("int")
    block = block.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), passes))).alias("epoch"))
    # Running sums over all blocks in one order; what stood before a source's epoch is taken off.
    order = [F.col("source"), F.col("epoch"), F.xxhash64("source", "block", "epoch", F.lit(seed)), F.col("block")]
    block = running_total(block, order, F.col("n"), "run")
    base = scratch.save(block.groupBy(F.col("source").alias("s"), F.col("epoch").alias("e")).agg(F.min("run").alias("base")))
    block = block.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")))
    block = block.withColumn("before", (F.col("epoch") - 1) * F.col("size") + F.col("run") - F.col("base")).where(F.col("before") < F.col("quota"))
    block = scratch.save(block.select("source", "block", "epoch", "before", (F.col("before") + F.col("n") > F.col("quota")).alias("cut")))
    b = block.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "before", "cut")
    drawn = dealt.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    spread = lambda *more: F.xxhash64("doc_id", "t", "epoch", F.lit(seed), *more)
    inside = Window.partitionBy("source", "block", "epoch").orderBy(spread(), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = drawn.where("cut").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).where(F.col("at") < F.col("quota")).drop("at")
    every = drawn.where("NOT cut").unionByName(cut)
    # A source's draws stand evenly along the mixture: by their block's share of the quota, jittered within it.
    jitter = (spread(F.lit("place")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))) * F.col("size") / F.col("blocks")
    place = F.least(F.lit(1.0), (F.col("before") + jitter) / F.col("quota"))
    return every.select("doc_id", "source", "tokens", "weight", F.lit(exponent).alias("exponent"), F.col("epoch").cast("long").alias("epoch"), "block", place.alias("place"))
