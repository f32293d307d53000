"""Dataset specs, the registry, and readers and writers of record files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"jsonl": "json", "json": "json", "csv": "csv", "txt": "text", "parquet": "parquet"}
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff")
WRAPPERS = ("data", "items", "samples", "annotations", "records")


@dataclass(frozen=True)
class Spec:
    """``[hub::]name[:subset/subset][#rows]``"""

    name: str
    hub: str | None = None
    subsets: tuple[str, ...] = ()
    rows: int | None = None

    @classmethod
    def parse(cls, text: str, exists: Callable[[str], bool] = os.path.exists) -> Spec:
        """An existing path wins over every separator it holds."""
        hub = rows = None
        subsets: tuple[str, ...] = ()
        if not exists(text) and "::" in text:
            head, _, rest = text.partition("::")
            if head in ("hf", "ms"):
                hub, text = head, rest
        if not exists(text) and "#" in text:
            text, _, n = text.rpartition("#")
            rows = int(n)
        if not exists(text) and ":" in text:
            text, _, names = text.partition(":")
            subsets = tuple(names.split("/"))
        return cls(text, hub, subsets, rows)


@dataclass
class Dataset:
    """A registered dataset: where it lies, its subsets, and how a row is normalised."""

    name: str
    path: str
    subsets: dict[str, str] = field(default_factory=dict)
    weak: frozenset[str] = frozenset()
    columns: dict[str, str] = field(default_factory=dict)
    transform: Callable[[DataFrame], DataFrame] | None = None
    tags: tuple[str, ...] = ()

    def choose(self, wanted: tuple[str, ...]) -> list[str]:
        """None asked: the only one, else ``default``; ``all``: all but weak; unknown names pass."""
        if not wanted:
            return list(self.subsets) if len(self.subsets) <= 1 else ["default"]
        if wanted == ("all",):
            return [s for s in self.subsets if s not in self.weak]
        return list(wanted)


class Registry:
    def __init__(self) -> None:
        self._by_name: dict[str, Dataset] = {}

    def register(self, dataset: Dataset, exist_ok: bool = False) -> None:
        if dataset.name in self._by_name and not exist_ok:
            raise ValueError(f"{dataset.name} is registered already")
        self._by_name[dataset.name] = dataset

    def register_json(self, path: str) -> list[str]:
        """Registers the entries of a JSON list; relative paths start at its folder."""
        with open(path) as f:
            entries = json.load(f)
        names = []
        for e in entries:
            where = e.get("dataset_path") or e["path"]
            if "://" not in where and not os.path.isabs(where):
                where = os.path.join(os.path.dirname(os.path.abspath(path)), where)
            name = e.get("dataset_name") or e.get("name") or where
            self.register(Dataset(name, where, e.get("subsets", {}), columns=e.get("columns", {}), tags=tuple(e.get("tags", ()))), exist_ok=True)
            names.append(name)
        return names

    def find(self, name: str) -> Dataset | None:
        """By name, then by a name whose last part it is."""
        return self._by_name.get(name) or next((d for n, d in self._by_name.items() if n.split("/")[-1] == name), None)


def read_records(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Reads JSON lines, CSV, text or Parquet. Blank CSV fields stay empty strings."""
    fmt = fmt or FORMATS.get(path.rsplit(".", 1)[-1].lower(), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    return reader.text(path) if fmt == "text" else getattr(reader, fmt)(path)


def read_wrapped_json(spark: SparkSession, path: str, keys: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """A JSON array, or an object that wraps one under a known key."""
    df = spark.read.option("multiLine", True).json(path)
    for key in keys:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            return df.select(F.inline(key))
    return df


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An annotation manifest by what it holds: JSON lines, a JSON array, or an object that wraps one; CSV and Parquet by their names."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "parquet"):
        return read_records(spark, path, schema=schema if suffix == "csv" else None)
    # The first character that is not blank of the first lines decides; no more of the file is read for it.
    head = "".join(r["value"] for r in spark.read.text(path).limit(50).collect()).lstrip("\ufeff \t\r\n")
    if head[:1] == "[":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    first_line = spark.read.text(path).where("trim(value) <> ''").limit(1).select(F.try_parse_json("value").isNotNull().alias("ok")).first()
    if suffix == "jsonl" or first_line and first_line["ok"] and not any(f'"{k}"' in head for k in WRAPPERS):
        return read_json_lines(spark, path, schema)
    return read_wrapped_json(spark, path)


def with_sidecars(images: DataFrame, sidecars: DataFrame, path: str = "relative_path", json_path: str = "json_path", fields: tuple[str, ...] = ()) -> DataFrame:
    """Each image with the ``fields`` of the JSON beside it, whose path is the image's with another ending; of several the one that sorts first."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    first = F.min(F.struct(F.col(json_path), *[F.col(c) for c in fields]))
    beside = sidecars.where(F.lower(json_path).endswith(".json")).groupBy(stem(json_path).alias("__stem")).agg(first.alias("__side"))
    out = images.join(beside, stem(path) == F.col("__stem"), "left")
    return out.select(*[images[c] for c in images.columns], *[F.col(f"__side.{c}").alias(c) for c in fields])


def cached_choices(rows: DataFrame, cache: DataFrame, choice: str = "choices") -> DataFrame:
    """``rows`` with ``key`` and the ``choices`` a former sampling has for each: the lists of equal keys one after another, in the order of ``batch``; none is an empty list.

    The key is the MD5 of a row as JSON, its choices left out; ``cache`` holds ``key, batch, choices``.
    """
    from quillmark.operators.runs import row_key

    kind = dict(cache.dtypes)[choice]
    one = cache.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("batch", F.col(choice).alias("c")))).alias("found"))
    keyed = rows.drop(choice).withColumn("key", row_key(rows.columns))
    return keyed.join(one, "key", "left").withColumn(choice, F.coalesce(F.flatten(F.transform("found", lambda x: F.coalesce(x["c"], F.array().cast(kind)))), F.array().cast(kind))).drop("found")


def discover_images(spark: SparkSession, root: str) -> DataFrame:
    """``path, relative_path, length`` of the image files below a folder."""
    suffixes = "|".join(re.escape(s) for s in IMAGE_SUFFIXES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    files = files.where(F.lower("path").rlike(f"({suffixes})$"))
    return files.withColumn("relative_path", F.substring_index("path", root.rstrip("/") + "/", -1))


def load(spark: SparkSession, text: str, registry: Registry | None = None) -> DataFrame:
    """Spec to rows: subsets are united, then renamed and normalised, then cut to size."""
    from quillmark.operators import compose, normalize

    spec = Spec.parse(text)
    meta = (registry or Registry()).find(spec.name) or Dataset(spec.name, spec.name)
    if spec.hub and not os.path.exists(meta.path):
        raise FileNotFoundError(f"{spec.hub}::{spec.name}: hubs are out of reach, give a local path")
    chosen = [meta.subsets.get(s, meta.path) for s in meta.choose(spec.subsets)] or [meta.path]
    df = compose.concat([read_records(spark, p) for p in dict.fromkeys(chosen)])
    df = normalize.rename(df, meta.columns)
    df = meta.transform(df) if meta.transform else df
    return compose.sample(df, spec.rows) if spec.rows is not None else df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, blank ones left out, a byte order mark removed; a line that is no object is refused with its file and text."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("v"), F.col("_metadata.file_name").alias("f")).where("trim(v) <> ''")
    bad = F.raise_error(F.concat(F.lit("no JSON object in "), F.col("f"), F.lit(": "), F.substr("v", F.lit(1), F.lit(200))))
    good = F.col("v").rlike(r"^\s*\{") & F.try_parse_json("v").isNotNull()
    return lines.select(F.from_json(F.when(good, F.col("v")).otherwise(bad), schema).alias("r")).select("r.*")


def export_dataset(train: DataFrame, path: str, val: DataFrame | None = None) -> None:
    """Encoded rows as Parquet under ``train`` and, where there is one, ``val``."""
    train.write.mode("overwrite").parquet(f"{path}/train")
    if val is not None:
        val.write.mode("overwrite").parquet(f"{path}/val")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def exported(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    return spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/val") if exists(spark, f"{path}/val") else None


def append_new(df: DataFrame, path: str, ids: list[str]) -> None:
    """Appends the rows whose ids the table does not hold yet, so a run that broke off goes on where it was.

    A write either is committed whole or leaves nothing; of rows with the same ids one is written.
    """
    spark, df = df.sparkSession, df.dropDuplicates(ids)
    if exists(spark, path):
        known = spark.read.parquet(path).select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(ids)])
        same = F.lit(True)
        for i, c in enumerate(ids):
            same = same & df[c].eqNullSafe(known[f"__k{i}"])
        df = df.join(known, same, "left_anti")
    df.write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(*[json_safe(df.schema[c].dataType, F.col(f"`{c}`"), c).alias(c) for c in df.columns]).write.mode(mode).json(path)


def json_safe(kind: T.DataType, c: Column, name: str = "") -> Column:
    """Bytes become a mark; strings under names that hold ``_token`` become null."""
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), F.lit("<<<bytes>>>"))
    if isinstance(kind, T.StringType) and "_token" in name:
        return F.lit(None).cast("string")
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[json_safe(f.dataType, c[f.name], f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_safe(kind.elementType, x, name))
    return c
