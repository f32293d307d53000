"""Metrics as mergeable states.

A metric names partial aggregates, how two of them merge, and what the merged
ones come to. ``update`` turns rows into one state row a group; states of parts,
batches or runs are rows of the same shape, which may be saved, united and
merged in any order, and are finished once. Nothing is held between calls.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.compose import concat
from quillmark.sources.spec import exists


class Part(NamedTuple):
    """A partial aggregate: of rows, of states under its own name, and what it is without any row."""

    of_rows: Column
    merged: Callable[[Column], Column]
    empty: Column


class Metric(NamedTuple):
    parts: dict[str, Part]
    finish: Callable[[dict[str, Column]], dict[str, Column]]
    #: Columns that tell updates of the same thing apart from others; of such updates the one latest in ``order`` counts.
    keys: tuple[str, ...] = ()
    order: str | None = None


def counted(of_rows: Column) -> Part:
    return Part(F.coalesce(of_rows, F.lit(0)), F.sum, F.lit(0).cast("long"))


def summed(of_rows: Column) -> Part:
    return Part(F.coalesce(of_rows, F.lit(0.0)).cast("double"), F.sum, F.lit(0.0))


def mean(value: str, array: bool = False, nan_value: float = 0.0) -> Metric:
    """Mean of a column of numbers, or of arrays of them, each element once; nulls are left out, and of nothing it is ``nan_value``."""
    if array:
        kept = F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: x.cast("double"))
        total, n = F.sum(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)), F.sum(F.size(kept))
    else:
        total, n = F.sum(F.col(value).cast("double")), F.count(value)
    return Metric({"total": summed(total), "n": counted(n)}, lambda s: {"value": F.when(s["n"] > 0, s["total"] / s["n"]).otherwise(F.lit(float(nan_value)))})


def moments(value: str) -> Metric:
    """Count, mean and population deviation."""
    x = F.col(value).cast("double")
    parts = {"n": counted(F.count(x)), "s1": summed(F.sum(x)), "s2": summed(F.sum(x * x)), "lo": Part(F.min(x), F.min, F.lit(None).cast("double")), "hi": Part(F.max(x), F.max, F.lit(None).cast("double"))}

    def finish(s: dict[str, Column]) -> dict[str, Column]:
        n = F.nullif(s["n"], F.lit(0))
        avg = s["s1"] / n
        return {"n": s["n"], "mean": avg, "std": F.sqrt(F.greatest(s["s2"] / n - avg * avg, F.lit(0.0))), "min": s["lo"], "max": s["hi"]}

    return Metric(parts, finish)


def distinct(value: str, lg_k: int = 12) -> Metric:
    """About how many values there are, from a sketch of a fixed size."""
    sketch = F.hll_sketch_agg(value, F.lit(lg_k))
    part = Part(sketch, lambda c: F.hll_union_agg(c), F.lit(None).cast("binary"))
    return Metric({"sketch": part}, lambda s: {"distinct": F.coalesce(F.hll_sketch_estimate(s["sketch"]), F.lit(0))})


def infer_stats(request: str = "id", prompt: str = "prompt_tokens", generated: str = "completion_tokens", start: str = "start", stop: str = "stop") -> Metric:
    """Tokens, samples and rates of generation; a request that comes again counts as it came last.

    ``start`` and ``stop`` are seconds; the runtime goes from the first start to the last stop of what counts.
    """
    none = F.lit(None).cast("double")
    parts = {
        "num_prompt_tokens": counted(F.sum(prompt)), "num_generated_tokens": counted(F.sum(generated)), "num_samples": counted(F.count(F.lit(1))),
        "first": Part(F.min(start).cast("double"), F.min, none), "last": Part(F.max(stop).cast("double"), F.max, none),
    }

    def finish(s: dict[str, Column]) -> dict[str, Column]:
        runtime = F.coalesce(s["last"] - s["first"], F.lit(0.0))
        rate = lambda n: n / F.nullif(runtime, F.lit(0.0))
        return {
            "num_prompt_tokens": s["num_prompt_tokens"], "num_generated_tokens": s["num_generated_tokens"], "num_samples": s["num_samples"],
            "runtime": runtime, "samples_per_s": rate(s["num_samples"]), "tokens_per_s": rate(s["num_generated_tokens"]),
        }

    return Metric(parts, finish, (request,), stop)


def accuracy(prediction: str, label: str) -> Metric:
    """Share of rows whose prediction is the label, of those with a label."""
    hit = F.col(label).isNotNull() & F.col(prediction).eqNullSafe(F.col(label))
    parts = {"hits": counted(F.count_if(hit)), "n": counted(F.count(label))}
    return Metric(parts, lambda s: {"acc": s["hits"] / F.nullif(s["n"], F.lit(0)), "n": s["n"]})


#: Metrics by name; ``register`` adds to them.
METRICS: dict[str, Callable[..., Metric]] = {"mean": mean, "moments": moments, "distinct": distinct, "infer_stats": infer_stats, "accuracy": accuracy}


def register(name: str, metric: Callable[..., Metric]) -> None:
    if name in METRICS:
        raise ValueError(f"there is a metric {name} already")
    METRICS[name] = metric


def update(metric: Metric, rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """State rows: a row a group, or one for all; with ``keys``, a row for each key of a group."""
    by = [*(group or []), *metric.keys]
    parts = metric.parts
    if metric.keys:  # what came last stands for its key
        last = F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in by]), F.struct(metric.order, F.xxhash64(*rows.columns)))
        rows = rows.groupBy(*by).agg(last.alias("__row")).select(*by, "__row.*")
    out = rows.groupBy(*by).agg(*[p.of_rows.alias(k) for k, p in parts.items()])
    return out.withColumn("at", F.lit(None).cast("double")) if not metric.keys else out.withColumn("at", F.col("last"))


def merge(metric: Metric, states: list[DataFrame], group: list[str] | None = None) -> DataFrame:
    """One state a group from many; of equal keys the latest stays."""
    by, names = list(group or []), list(metric.parts)
    every = concat(states)
    if metric.keys:
        best = F.max_by(F.struct(*[F.col(c) for c in names]), F.col("at"))
        return every.groupBy(*by, *metric.keys).agg(best.alias("__s"), F.max("at").alias("at")).select(*by, *metric.keys, "__s.*", "at")
    parts = metric.parts
    return every.groupBy(*by).agg(*[parts[k].merged(F.col(k)).alias(k) for k in names]).withColumn("at", F.lit(None).cast("double"))


def compute(metric: Metric, states: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The metric of each group, from its states; without a state and a group, of no row at all."""
    by, names = list(group or []), list(metric.parts)
    parts = metric.parts
    whole = states.groupBy(*by).agg(*[parts[k].merged(F.col(k)).alias(k) for k in names])
    have = {k: F.coalesce(F.col(k), parts[k].empty) for k in names}
    return whole.select(*by, *[c.alias(k) for k, c in metric.finish(have).items()])


def save(states: DataFrame, path: str, run: str) -> None:
    """Keeps the states of a run; saved again, they replace its former ones."""
    states.write.mode("overwrite").parquet(f"{path}/run={run}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The states of all runs, with ``run``."""
    return spark.read.parquet(path)


def reset(spark: SparkSession, path: str, run: str) -> None:
    """Forgets the states of a run."""
    if exists(spark, f"{path}/run={run}"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={run}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
