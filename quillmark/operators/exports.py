"""Files of a selection: groups by path, copies in place, an archive a domain, cards of datasets."""

from __future__ import annotations

import os
import shutil
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators.encode import Encoder, words
from quillmark.operators.metrics import length_stats

MODES = ("copy", "symlink", "manifest_only")


def group_candidates(selection: DataFrame, annotations: DataFrame, path: str = "image_path", selected_path: str = "relative_path", most: int | None = None) -> DataFrame:
    """The annotations of all members of the selected groups: adds ``group_id, group_member_stem, relative_path, source_image_path, group_size``.

    A group is the folder of a selected path, else its stem without a view's
    number; ``most`` keeps the groups that sort first. A member's new place is
    its group's folder. A member without a group selected is left out.
    """
    groups = selection.select(text.group_of_path(F.col(selected_path))["group"].alias("__group")).where("__group <> ''").distinct()
    if most is not None:
        groups = groups.orderBy("__group").limit(most)
    member = text.path_stem(F.col(path))
    suffix = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    rows = annotations.withColumn("group_member_stem", member).withColumn("group_id", text.group_stem(member))
    rows = rows.join(groups, F.col("group_id") == F.col("__group")).drop("__group")
    sizes = rows.groupBy(F.col("group_id").alias("__id")).agg(F.count(F.lit(1)).alias("group_size"))
    out = rows.join(sizes, F.col("group_id") == F.col("__id")).drop("__id")
    return out.withColumn("source_image_path", F.col(path)).withColumn("relative_path", F.concat("group_id", F.lit("/"), "group_member_stem", suffix))


def group_members(base: DataFrame, members: DataFrame, path: str = "relative_path") -> DataFrame:
    """``base`` (``group_id`` and more) with the rows of ``members`` whose path puts them in its group: adds ``member_stem``."""
    where = text.group_of_path(F.col(path))
    rows = members.select("*", where["group"].alias("__group"), where["member"].alias("member_stem"))
    own = [c for c in rows.columns if c not in ("__group", *base.columns)]
    return base.join(rows.select("__group", *own), F.col("group_id") == F.col("__group")).drop("__group")


def _inside(root: str, relative: str) -> str:
    """A path below the root; one that leads out of it is refused."""
    out = os.path.normpath(os.path.join(root, relative))
    if not out.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"{relative} leads out of {root}")
    return out


def materialize(rows: DataFrame, root: str, mode: str = "copy", path: str = "image_path", relative: str = "relative_path") -> DataFrame:
    """``path, target, done``: brings each row's file to its place below ``root``, in all tasks at once; the caller's action runs it.

    ``root`` is a folder that all executors share. A file that is there already
    is replaced, so a task that runs again changes nothing. A missing source is
    not done. ``manifest_only`` brings none.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, place in zip(b["path"], b["relative"], strict=True):
                target = _inside(root, place)
                done = mode != "manifest_only" and os.path.exists(source)
                if done:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{os.getpid()}.part"
                    if mode == "symlink":
                        os.symlink(os.path.abspath(source), part)
                    else:
                        shutil.copy2(source, part)
                    os.replace(part, target)
                out.append((source, target, done))
            yield pd.DataFrame(out, columns=["path", "target", "done"])

    kept = rows.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.coalesce(F.col(relative), text.path_stem(F.col(path))).alias("relative")).distinct()
    return kept.mapInPandas(run, "path string, target string, done boolean")


def zip_domains(rows: DataFrame, output: str, domain: str = "domain", path: str = "image_path", relative: str = "relative_path", folder: str = "image") -> DataFrame:
    """``domain, zip_path, files``: an archive a domain with its selected files (all if none is selected), names in order.

    An archive is one file, so one task writes it; it streams through its rows
    and holds one file at a time. It gets its name when it is whole.
    """
    chosen = F.coalesce(F.col("selected"), F.lit(False)) if "selected" in rows.columns else F.lit(True)
    named = rows.where(F.col(path).isNotNull()).select(
        F.coalesce(F.nullif(F.col(domain), F.lit("")), F.lit("UNKNOWN")).alias("domain"), F.col(path).alias("path"), F.coalesce(F.col(relative), F.substring_index(path, "/", -1)).alias("relative"), chosen.alias("__on"))
    some = named.groupBy(F.col("domain").alias("__domain")).agg(F.max("__on").alias("__some"))
    kept = named.join(some, F.col("domain") == F.col("__domain")).where(~F.col("__some") | F.col("__on")).select("domain", "relative", "path").distinct()
    dealt = kept.repartition("domain").sortWithinPartitions("domain", "relative", "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(output, exist_ok=True)
        done, archive, now, files = [], None, None, 0

        def close() -> None:
            archive.close()
            os.replace(f"{output}/{now}.zip.part", f"{output}/{now}.zip")
            done.append((now, f"{output}/{now}.zip", files))

        for b in batches:
            for name, place, source in zip(b["domain"], b["relative"], b["path"], strict=True):
                if name != now:
                    if archive:
                        close()
                    now, files = name, 0
                    archive = zipfile.ZipFile(f"{_inside(output, f'{now}.zip')}.part", "w", zipfile.ZIP_DEFLATED)
                archive.write(source, f"{folder}/{place}")
                files += 1
        if archive:
            close()
        yield pd.DataFrame(done, columns=["domain", "zip_path", "files"])

    return dealt.mapInPandas(run, "domain string, zip_path string, files long")


def dataset_card(name: str, df: DataFrame, encode: Encoder = words, subsets: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> DataFrame:
    """``card``: a row of a table of datasets: name, subsets, size, token lengths of all rows, tags."""
    sizes = length_stats(df.select(F.size(encode(F.col("messages"))).alias("n")), "n")
    shown: Column = F.format_string("%.1f±%.1f, min=%d, max=%d", "mean", "std", "min", "max")
    lengths = F.when(F.col("size") > 0, shown).otherwise(F.lit("-"))
    return sizes.select(F.concat_ws("|", F.lit(""), F.lit(name), F.lit("<br>".join(subsets)), F.col("size"), lengths, F.lit(", ".join(tags) or "-"), F.lit("")).alias("card"))
