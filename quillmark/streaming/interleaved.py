"""Interleaving of streams by draws: step s takes the next row of the source that a hash of s chooses.

The draws are those of ``compose.interleave``, so the order does not depend on
how rows arrive. A micro-batch numbers its rows by source, lays out as many
draws as they need, and joins the two; rows are done up to the first draw whose
row has not come yet. What waits (rows beyond it, draws without a row) is kept
in tables in the shared folder, one version a batch, so a broken-off batch is
run again from where it began.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators.compose import ranked_within, uniform
from quillmark.scratch import Scratch, importable
from quillmark.streaming.lanes import Versions

_DRAW = "position long, source int, k long"


class Interleaved:
    """Rows of several streams of the same columns, with ``source, k`` (its number there, from 1) and ``position``."""

    def __init__(self, spark: SparkSession, path: str, probabilities: list[float], order: list[str], seed: int = 42) -> None:
        if not probabilities or min(probabilities) <= 0 or abs(sum(probabilities) - 1) > 1e-9:
            raise ValueError("probabilities must be above 0 and add up to 1")
        self.spark, self.tables, self.p, self.order, self.seed = spark, Versions(spark, path), probabilities, order, seed

    def start(self, streams: list[DataFrame], checkpoint: str, **trigger: Any) -> StreamingQuery:
        importable(self.spark)
        both = reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(i)) for i, s in enumerate(streams)])
        if not self.tables.batches("waiting"):
            empty = self.spark.createDataFrame([], both.schema).withColumn("k", F.lit(0).cast("long")).withColumn("position", F.lit(0).cast("long"))
            self.tables.write(empty, "waiting", -1)
            self.tables.write(self.spark.createDataFrame([], _DRAW), "draws", -1)
            self.tables.write(self.spark.createDataFrame([(i, 0, 0) for i in range(len(self.p))], "source int, rows long, drawn long"), "counts", -1)
        return both.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).foreachBatch(self._batch).start()

    def run(self, streams: list[DataFrame], checkpoint: str, stop: str = "first_exhausted") -> DataFrame:
        """All rows of bounded streams, up to where a stop rule ends them."""
        self.start(streams, checkpoint).awaitTermination()
        return self.finish(stop)

    def rows(self) -> DataFrame:
        """The rows that are done: up to the first draw whose row has not come. Of streams that ended, those of ``first_exhausted``."""
        done = self.tables.batches("done")
        return self.tables.read("done", *done) if done else self._last("waiting").limit(0)

    def finish(self, stop: str = "first_exhausted") -> DataFrame:
        """``first_exhausted`` ends at the first draw from a source without a row left; ``all_exhausted`` when each has met such a draw, sources that ran out starting again."""
        if stop == "first_exhausted":
            return self.rows()
        if stop != "all_exhausted":
            raise ValueError(f"unknown stop rule {stop!r}")
        have = {r["source"]: r["rows"] for r in self._last("counts").collect()}
        if not all(have.values()):
            raise ValueError("an empty source cannot be interleaved")
        draws = self._last("draws")
        # The draw after a source's last row; each was laid out with the rows.
        ends = draws.groupBy("source").agg(F.min("position").alias("p"))
        last = ends.agg(F.max("p")).first()[0]
        every = self.rows().unionByName(self._last("waiting"))
        known = F.element_at(F.array(*[F.lit(have[i]) for i in range(len(self.p))]), F.col("source") + 1)
        again = draws.where(F.col("position") < last).select("position", F.col("source").alias("__s"), (F.pmod(F.col("k") - 1, known) + 1).alias("__k"))
        replayed = every.drop("position").join(again, (F.col("source") == F.col("__s")) & (F.col("k") == F.col("__k"))).drop("__s", "__k")
        return every.where(F.col("position") < last).unionByName(replayed)

    def _last(self, kind: str) -> DataFrame:
        return self.tables.read(kind, max(self.tables.batches(kind)))

    def _batch(self, rows: DataFrame, batch: int) -> None:
        scratch, tables = Scratch(self.spark), self.tables
        before = lambda kind: tables.read(kind, max(b for b in tables.batches(kind) if b < batch))
        counts = {r["source"]: (r["rows"], r["drawn"]) for r in before("counts").collect()}  # one row a source
        new = scratch.save(ranked_within(rows, ["source"], [F.col(c) for c in self.order], "k"))
        came = {r["source"]: r["n"] for r in new.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        base = F.element_at(F.array(*[F.lit(counts[i][0]) for i in range(len(self.p))]), F.col("source") + 1)
        numbered = new.withColumn("k", F.col("k") + base).withColumn("position", F.lit(None).cast("long"))
        have = {i: counts[i][0] + came.get(i, 0) for i in range(len(self.p))}
        draws, drawn = before("draws").select("position", "source", "k"), {i: counts[i][1] for i in range(len(self.p))}
        # One draw more than rows of each source, so that its end is known.
        while any(drawn[i] <= have[i] for i in drawn):
            start = sum(drawn.values())
            steps = int(max((have[i] + 1 - drawn[i]) / p + 12 * (max(have[i] + 1 - drawn[i], 0) * (1 - p)) ** 0.5 / p + 40 / p for i, p in enumerate(self.p)))
            more = scratch.save(self._drawn(start, steps, drawn))
            got = {r["source"]: r["n"] for r in more.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
            draws, drawn = draws.unionByName(more), {i: n + got.get(i, 0) for i, n in drawn.items()}
        rows = before("waiting").drop("batch").unionByName(numbered)
        known = F.element_at(F.array(*[F.lit(have[i]) for i in range(len(self.p))]), F.col("source") + 1)
        met = draws.where(F.col("k") <= known).select(F.col("position").alias("__p"), F.col("source").alias("__s"), F.col("k").alias("__k"))
        placed = rows.join(met, (F.col("source") == F.col("__s")) & (F.col("k") == F.col("__k")), "left")
        placed = scratch.save(placed.withColumn("position", F.coalesce("__p", "position")).drop("__p", "__s", "__k"))
        left = scratch.save(draws.where(F.col("k") > known))
        frontier = left.agg(F.min("position")).first()[0]
        tables.write(placed.where(F.col("position") < frontier), "done", batch)
        tables.write(placed.where(F.col("position") >= frontier), "waiting", batch)
        tables.write(left, "draws", batch)
        tables.write(self.spark.createDataFrame([(i, have[i], drawn[i]) for i in drawn], "source int, rows long, drawn long"), "counts", batch)

    def _drawn(self, start: int, steps: int, drawn: dict[int, int]) -> DataFrame:
        """``position, source, k`` of the steps from ``start`` on."""
        cuts = [sum(self.p[: i + 1]) for i in range(len(self.p))]
        u = uniform(self.seed, F.col("id"))
        source = F.coalesce(*[F.when(u < c, i) for i, c in enumerate(cuts)], F.lit(len(self.p) - 1))
        d = ranked_within(self.spark.range(start, start + steps).select(F.col("id").alias("position"), source.alias("source")), ["source"], [F.col("position")], "k")
        base = F.element_at(F.array(*[F.lit(drawn[i]) for i in range(len(self.p))]), F.col("source") + 1)
        return d.select("position", "source", (F.col("k") + base).cast("long").alias("k"))
