"""Batches appended one by one, with a log: a run that broke off goes on where it was.

The log holds a file for each batch that is written whole. A resumed run lists
the log and nothing else; what a broken-off batch left behind is overwritten
when the batch is run again, and is never read before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.compose import ranked
from quillmark.scratch import Scratch


class BatchLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[str]:
        """Names of the log's files: a batch's number, or first and last of a stretch that was committed at once."""
        where = self._path(f"{self.path}/log")
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def done(self) -> list[int]:
        """Numbers of the committed batches."""
        ends = [[int(i) for i in e.split("-")] for e in self._entries()]
        return sorted({i for e in ends for i in range(e[0], e[-1] + 1)})

    def write(self, number: int, rows: DataFrame, last: int | None = None) -> None:
        """Writes a batch, or a stretch of them up to ``last``, and then commits it; a batch that is committed is left alone."""
        if number in self.done():
            return
        name = str(number) if last in (None, number) else f"{number}-{last}"
        rows.write.mode("overwrite").parquet(f"{self.path}/data/batch-{name}")
        self._fs.create(self._path(f"{self.path}/log/{name}"), True).close()

    def rows(self) -> DataFrame | None:
        """The rows of all committed batches; none before the first."""
        names = sorted(self._entries())
        return self.spark.read.parquet(*[f"{self.path}/data/batch-{n}" for n in names]) if names else None


def sliced(df: DataFrame, order: list[Column], size: int) -> tuple[DataFrame, int]:
    """The rows, in the shared folder, with ``batch``: stretches of ``size`` rows of an order, numbered from 0; and how many there are."""
    rows = Scratch(df.sparkSession).save(ranked(df, order, "__rn").withColumn("batch", F.floor((F.col("__rn") - 1) / F.lit(size)).cast("long")).drop("__rn"))
    last = rows.agg(F.max("batch")).first()[0]
    return rows, 0 if last is None else last + 1


def run_batches(df: DataFrame, path: str, order: list[Column], size: int, make: Callable[[DataFrame], DataFrame], batches: Iterable[int] | None = None, at_once: int = 1) -> DataFrame | None:
    """What ``make`` gives for each batch of an order, appended in turn; batches that the log holds are passed over.

    A ``make`` that works row by row may be given up to ``at_once`` neighbouring
    batches together, which are written by one job and committed together; so
    the jobs need not grow with the batches. A run that breaks off loses no more.
    """
    log = BatchLog(df.sparkSession, path)
    rows, n = sliced(df, order, size)
    done = set(log.done())
    stretches: list[list[int]] = []
    for i in batches if batches is not None else range(n):
        if i in done:
            continue
        if stretches and i == stretches[-1][1] + 1 and i - stretches[-1][0] < at_once:
            stretches[-1][1] = i
        else:
            stretches.append([i, i])
    for i, j in stretches:
        log.write(i, make(rows.where(F.col("batch").between(i, j)).drop("batch")), j)
    return log.rows()
