"""Replacement of rows that cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.compose import ranked, uniform
from quillmark.scratch import Scratch


def replaced(df: DataFrame, usable: Column, ids: list[str], seed: int = 42, tries: int = 10) -> DataFrame:
    """Every row in its place, unusable ones replaced; adds ``place`` (from 1, by ids) and ``tries``.

    A row counts as the first try. An unusable one takes the next rows of one
    hashed permutation of the table, which all replacements draw on in order of
    place and which starts again at its end, until one is usable. So the k-th
    unusable row takes the k-th usable one of the permutation, and its tries are
    the step between their positions. A row that is not served within ``tries``
    stops the job, and so does a table without a usable row.
    """
    scratch, keys = Scratch(df.sparkSession), [F.col(c) for c in ids]
    marked = scratch.save(ranked(df.withColumn("__ok", F.coalesce(usable, F.lit(False))), keys, "place"))
    n, good = marked.agg(F.count(F.lit(1)), F.count_if("__ok")).first()
    if n == good:
        return marked.drop("__ok").withColumn("tries", F.lit(1))
    if not good:
        raise ValueError("no row is usable")
    order = scratch.save(ranked(marked.select(*ids, "place", "__ok"), [uniform(seed, *keys), *keys], "__spot"))
    served = ranked(order.where("__ok").select("place", "__spot"), [F.col("__spot")], "__k").select(F.col("place").alias("__from"), "__spot", "__k")
    asking = ranked(marked.where("NOT __ok").select("place"), [F.col("place")], "__j").select("place", "__j")
    turn = lambda j: (F.floor((j - 1) / F.lit(good)) * n, F.pmod(j - 1, F.lit(good)) + 1)
    round_, k = turn(F.col("__j"))
    got = asking.select("place", "__j", round_.alias("__round"), k.alias("__k")).join(served, "__k").withColumn("__pos", F.col("__round") + F.col("__spot"))
    got = scratch.save(got.select("place", "__j", "__from", "__pos"))
    before = got.select((F.col("__j") + 1).alias("__j"), F.col("__pos").alias("__before"))
    step = got.join(before, "__j", "left").select("place", "__from", (F.col("__pos") - F.coalesce("__before", F.lit(0)) + 1).alias("tries"))
    late = F.raise_error(F.concat(F.lit("no usable row within the tries at place "), F.col("place").cast("string"))).cast("long")
    step = step.withColumn("tries", F.when(F.col("tries") > tries, late).otherwise(F.col("tries")))
    rows = marked.where("__ok").drop("__ok")
    kept = rows.withColumn("tries", F.lit(1).cast("long"))
    taken = rows.withColumnRenamed("place", "__from").join(step, "__from").drop("__from")
    return kept.unionByName(taken)
