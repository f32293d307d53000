"""Structured-streaming forms: file streams, split, packing, buffer shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.compose import ranked, uniform
from quillmark.streaming.lanes import Folded, hashed, packing, shuffling


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def split(stream: DataFrame, ids: list[str], validation: float | None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A stream has no length: rows go by their hash, and a share must be given."""
    if validation is None:
        raise ValueError("a stream can only be split by a given share")
    u = uniform(seed, *[F.col(c) for c in ids])
    return stream.where(u >= validation), stream.where(u < validation)


def pack(spark: SparkSession, path: str, id_col: str, length_col: str, capacity: int, key: str | None = None, window: int = 128, lanes: int = 8, order: list[str] | None = None) -> Folded:
    """Packs a stream to a capacity: ``pack(...).run(stream, checkpoint)`` or ``start`` and ``finish``.

    ``batch, lane, place`` name a bin. Rows are dealt to lanes by ``key``, or by
    id where one key would be too much for a task; every ``window`` rows of a
    lane are packed as they arrive (in the given order within a micro-batch),
    together with the bin left open before.
    """
    return Folded(spark, path, packing(length_col, capacity, window), F.xxhash64(key or id_col), order or [id_col], lanes)


def shuffle(spark: SparkSession, path: str, id_col: str, size: int = 1000, seed: int = 42, lanes: int = 8, order: list[str] | None = None) -> Folded:
    """Shuffles a stream through buffers of ``size`` rows in all; ``batch, lane, place`` is the order of each lane."""
    return Folded(spark, path, shuffling(max(1, size // lanes), hashed(seed, id_col)), F.xxhash64(id_col), order or [id_col], lanes)


def cyclic(df: DataFrame, order: list[str], rows_per_batch: int = 1000, epochs: int | None = None) -> DataFrame:
    """A stream that replays a table for ever, or ``epochs`` times; adds ``epoch`` and ``row``, both from 0.

    The stream counts positions, which its checkpoint keeps, so a restart goes
    on with the row it had come to; the numbered table is written once and met by a join.
    """
    numbered = ranked(df, [F.col(c) for c in order], "__rn")
    n = numbered.count()
    if not n:
        raise ValueError("an empty table cannot be replayed")
    ticks = df.sparkSession.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    at = ticks.select(F.floor(F.col("value") / F.lit(n)).cast("long").alias("epoch"), F.pmod("value", F.lit(n)).cast("long").alias("row"))
    at = at if epochs is None else at.where(F.col("epoch") < epochs)
    return at.join(numbered.withColumn("row", (F.col("__rn") - 1).cast("long")).drop("__rn"), "row")
