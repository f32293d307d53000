"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from quillmark.scratch import Scratch, importable, shared_dir

__all__ = ["BLANKS", "Scratch", "ascii_lower", "first_by_hash", "map_texts", "row_hash", "shared_dir", "table", "text_or_empty", "training_sample"]

#: White space that separates words and collapses in normalised texts.
BLANKS = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else (``lower`` would fold all of Unicode)."""
    return F.translate(c, _UPPER, _UPPER.lower())


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def first_by_hash(rows: DataFrame, label: str, n: int, h: str) -> DataFrame:
    """Up to ``n`` distinct values of the hash column ``h`` of each label, the smallest; ``label, h``.

    The labels must be few (their counts are broadcast). A cut at four times the
    share that is needed leaves few rows to rank, so no task ranks a label's
    rows; with that margin a label of over 4 n values yields n of them but for a
    chance under 1e-30 at n = 100.
    """
    keys = rows.select(label, h).distinct()
    counts = F.broadcast(keys.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
    near = keys.join(counts, label).where((F.col(h) / float(1 << 64) + 0.5) * F.col("__n") <= 4.0 * n)
    return near.withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy(h))).where(F.col("__r") <= n).drop("__n", "__r")


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(3), F.col(text_col))


def training_sample(rows: DataFrame, keys: DataFrame, n: int, chars: int) -> DataFrame:
    """``text, label`` of at most ``n`` distinct rows of each label.

    ``rows`` holds ``h, text``, ``keys`` the labels of the hashes, ``label, h``;
    only the latter is shuffled. As ``h`` is a hash of id and text, repeats of a
    row weigh nothing, and no label loses of its share to another. A text longer
    than ``chars`` gives the part of that length that starts at a hashed place.
    """
    chosen = first_by_hash(keys, "label", n, "h")  # at most n rows a label: broadcast whatever the table's size
    start = (F.pmod("h", F.greatest(F.length("text") - F.lit(chars), F.lit(0)) + 1) + 1).cast("int")
    cut = F.when(F.length("text") > chars, F.substring(F.col("text"), start, F.lit(chars))).otherwise(F.col("text"))
    return rows.join(F.broadcast(chosen), "h").select("label", "h", cut.alias("text")).groupBy("label", "h").agg(F.first("text").alias("text")).select("text", "label")


def map_texts(rows: DataFrame, fn: Callable[[list[str | None]], list[list]], added: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Adds columns that ``fn`` makes of the last column's texts, batch by batch, and drops the texts.

    The other columns pass through as Arrow arrays, so ids stay exact even
    beside nulls.
    """
    kept = rows.schema[:-1]
    schema = T.StructType([*kept.fields, *(T.StructField(n, from_arrow_type(t)) for n, t in added)])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(b.column(b.num_columns - 1).to_pylist())
            new = [pa.array(v, t) for v, (_, t) in zip(made, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=names)

    return rows.mapInArrow(run, schema)
