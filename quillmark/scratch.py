"""Tables in the shared folder, and the path of Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did.

    On a cluster the package comes with ``--py-files``; this serves local runs
    that start in another folder.
    """
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset,
    as in local tests, a temporary folder stands in for it.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or getattr(shared_dir, "own", None)
    if not base:
        master = conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quillmark-")
    return f"{base.rstrip('/')}/quillmark"


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs a re-read, not a recomputation. ``drop`` removes a
    table as soon as no later step reads it; ``clear``, between jobs, removes
    what results may still have been reading, and what is left goes with the JVM.
    """

    _made: set[str] = set()

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = shared_dir(spark)
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        schema = df.schema
        # Parquet has no column of nothing but null literals.
        void = [f.name for f in schema if isinstance(f.dataType, T.NullType)]
        if void:
            df = df.select(*[F.lit(None).cast("string").alias(f.name) if f.name in void else F.col(f"`{f.name}`") for f in schema])
            schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        where, fs = self._fs(path)
        fs.deleteOnExit(where)
        self._paths[id(out)] = (out, path)
        Scratch._made.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            kept = self._paths.pop(id(df), None)
            if kept:
                self._delete(kept[1])

    def clear(self) -> None:
        """Removes all tables that any operator of this process has written and not dropped; no frame that reads one may be in use."""
        for path in list(Scratch._made):
            self._delete(path)

    def _delete(self, path: str) -> None:
        where, fs = self._fs(path)
        fs.delete(where, True)
        Scratch._made.discard(path)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())
