"""Order-dependent folds over a stream: packing and buffer shuffle, to the last row.

Rows are dealt to lanes, each an independent fold over its rows in order of
arrival. What a lane still holds after a micro-batch (an open bin, a buffer) is
a table of rows in the shared folder, one version a batch; the next batch reads
it, so a broken-off batch is run again from the same rows and overwrites what it
had written. A task streams through its lanes and keeps one window or buffer.
``finish`` hands out what is still held once a bounded stream has ended.

Out come ``batch, lane, place`` (and more) beside the rows; in this order they
are the folded stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from quillmark.operators.compose import fullest_fit
from quillmark.scratch import Scratch, importable

Row = dict[str, Any]
#: From held rows and arrivals, both in order: row and place of each; a row that stays held comes with its number among these.
Fold = Callable[[list[Row], Iterator[Row]], Iterator[tuple[Row, int, int | None]]]
_ROWS = 1000
_ADDED = [StructField(c, LongType()) for c in ("lane", "held", "place", "batch")]


def packing(length_col: str, capacity: int, window: int = 128) -> Fold:
    """Every ``window`` arrivals are packed together with the open bin; all bins but the one opened last are done.

    ``place`` numbers the bins of a batch and lane. An arrival without a length is left out.
    """

    def fold(held: list[Row], arrivals: Iterator[Row]) -> Iterator[tuple[Row, int, int | None]]:
        rows, number, more = list(held), 0, True
        while more:
            new = list(islice(arrivals, window))
            more = len(new) == window
            rows += [r for r in new if r[length_col] is not None]
            if not rows:
                continue
            bins = fullest_fit([r[length_col] for r in rows], capacity)
            last = max(bins)
            for b, r in sorted(((b, i) for i, b in enumerate(bins) if b < last)):
                yield rows[r], number + b, None
            rows, number = [r for r, b in zip(rows, bins, strict=True) if b == last], number + last
        for i, r in enumerate(rows):
            yield r, number, i

    return fold


def hashed(seed: int, id_col: str) -> Callable[[Row], float]:
    """A key in (0, 1) from a seed and an id, the same as ``compose.uniform``."""
    return lambda r: (int(hashlib.md5(f"{seed}|{r[id_col]}".encode()).hexdigest()[:8], 16) + 0.5) / (1 << 32)


def shuffling(size: int, key: Callable[[Row], float]) -> Fold:
    """Each arrival at a full buffer takes the slot that its key in (0, 1) names; the row there goes out.

    A row goes out after at most ``size`` later ones or when its slot is drawn;
    none goes out more than ``size`` places before its turn. What is left in the
    buffer at the end goes out by key.
    """

    def fold(held: list[Row], arrivals: Iterator[Row]) -> Iterator[tuple[Row, int, int | None]]:
        buffer, out = list(held), 0
        for r in arrivals:
            if len(buffer) < size:
                buffer.append(r)
                continue
            slot = int(key(r) * size)
            yield buffer[slot], out, None
            buffer[slot], out = r, out + 1
        last = {slot: place for place, slot in enumerate(sorted(range(len(buffer)), key=lambda i: (key(buffer[i]), i)))}
        for slot, r in enumerate(buffer):
            yield r, last[slot], slot

    return fold


def _fold_lanes(rows: DataFrame, fold: Fold) -> DataFrame:
    """Folds each ``lane`` of sorted rows; ``held`` numbers those held before and is null for arrivals."""
    schema = StructType([*rows.schema, StructField("place", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Row] = []
        for _, own in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["lane"]):
            held: list[Row] = []
            arrivals: Iterator[Row] = iter(())
            for r in own:
                if r["held"] is None:
                    arrivals = chain([r], own)
                    break
                held.append(r)
            for r, place, number in fold(held, arrivals):
                out.append({**r, "place": place, "held": number})
                if len(out) == _ROWS:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, schema)


class Versions:
    """Tables by kind and batch number in a folder; a batch counts once it is written whole, and replaces what it had written before."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _of(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch-{batch}"

    def read(self, kind: str, *batches: int) -> DataFrame:
        return self.spark.read.parquet(*[self._of(kind, b) for b in batches])

    def write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(self._of(kind, batch))

    def batches(self, kind: str) -> list[int]:
        """Numbers of the batches that are written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        where = path(f"{self.path}/{kind}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        found = [s.getPath() for s in fs.listStatus(where)]
        return sorted(int(p.getName().removeprefix("batch-")) for p in found if fs.exists(path(p, "_SUCCESS")))


class Folded:
    """A folded stream in a folder: finished rows by batch, and the rows held after each."""

    def __init__(self, spark: SparkSession, path: str, fold: Fold, lane: Column, order: list[str], lanes: int) -> None:
        self.spark, self.tables, self.fold = spark, Versions(spark, path), fold
        self.lane, self.order, self.lanes = lane, order, lanes

    def start(self, stream: DataFrame, checkpoint: str, **trigger: Any) -> StreamingQuery:
        """Runs the fold; ``availableNow=True`` ends with the stream, after which ``finish`` is due."""
        importable(self.spark)
        if not self.tables.batches("held"):
            self.tables.write(self.spark.createDataFrame([], StructType([*stream.schema, *_ADDED])), "held", -1)
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).foreachBatch(self._batch).start()

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Folds all that a bounded stream has, to its last row."""
        self.start(stream, checkpoint).awaitTermination()
        return self.finish()

    def finish(self) -> DataFrame:
        """Hands out what is held, in order; a stream that goes on later starts with nothing held."""
        last = max(self.tables.batches("held"))
        if last % 2 == 0:
            held = self.tables.read("held", last)
            self.tables.write(held, "done", last + 1)
            self.tables.write(held.limit(0), "held", last + 1)
        return self.rows()

    def rows(self) -> DataFrame:
        """All finished rows, with ``batch, lane, place``."""
        done = self.tables.batches("done")
        if not done:
            return self.tables.read("held", max(self.tables.batches("held"))).limit(0).drop("held")
        return self.tables.read("done", *done).drop("held")

    def _batch(self, rows: DataFrame, batch_id: int) -> None:
        number = 2 * batch_id
        before = self.tables.read("held", max(b for b in self.tables.batches("held") if b < number))
        arrivals = rows.withColumn("lane", F.pmod(self.lane, F.lit(self.lanes)).cast("long")).withColumn("held", F.lit(None).cast("long"))
        both = arrivals.unionByName(before.select(*arrivals.columns))
        dealt = both.repartition("lane").sortWithinPartitions("lane", F.col("held").asc_nulls_last(), *self.order)
        scratch = Scratch(self.spark)
        made = scratch.save(_fold_lanes(dealt, self.fold))
        self.tables.write(made.where("held IS NULL"), "done", number)
        self.tables.write(made.where("held IS NOT NULL"), "held", number)
        scratch.drop(made)
