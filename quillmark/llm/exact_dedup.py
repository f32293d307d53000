"""Exact dedup by deterministic block naming.

Every normalised text is cut into blocks of a fixed size. The distinct blocks
are sorted (by their SHA-256, an order of contents that moves no text) and
numbered through, so a block becomes an integer name, which depends on the
blocks of the table alone. Adjacent names of a document are then paired, the
distinct pairs sorted and numbered in turn, and so on until one name is left. Two documents get the same last name exactly when
their texts are the same: names are given to whole blocks and whole pairs, never
to digests of them alone, so there is nothing that could collide.

Only the first round moves text, once, and equal blocks are combined before
they move. Later rounds move integers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import BLANKS, Scratch, text_or_empty
from quillmark.operators.compose import ranked

BLOCK_CHARS = 4096
#: Names of round n lie in [n << 54, (n + 1) << 54), so rounds never clash.
_ROUND_BITS = 54


def _numbered(distinct: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Sorts rows that are distinct already, over all partitions, and numbers them from 1."""
    return ranked(distinct, [F.col(k) for k in keys], "name").withColumn("name", F.col("name") + F.lit(level << _ROUND_BITS))


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: ``row, id, sha, name``; equal names mean equal texts.

    ``row`` numbers the input rows, so repeated ids stay apart. A null text
    counts as empty, and an empty text is one empty block. All columns but the
    two named are left alone, whatever they are called.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    norm = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(text_or_empty(F.col(text_col)), BLANKS, " ").alias("norm"),
    )
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length("norm") / F.lit(block_chars))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring(F.col("norm"), i * block_chars + 1, F.lit(block_chars)))
    rows = norm.select(F.monotonically_increasing_id().alias("row"), "id", F.sha2("norm", 256).alias("sha"), cut.alias("blocks"))
    rows = rows.select("row", "id", "sha", F.size("blocks").alias("left_over"), F.posexplode_outer("blocks").alias("pos", "block"))
    # No array is empty; outer explodes keep the optimizer from cutting each text
    # twice for an inferred filter. A digest only routes a block to its name. The name belongs to the block itself:
    # min and max over a digest show that all its blocks are the same.
    digest = F.unhex(F.sha2("block", 256)).alias("digest")
    rows = rows.select("row", "id", "left_over", "pos", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), digest)
    blocks = norm.select(F.explode_outer(cut).alias("block")).select(digest, "block")
    blocks = blocks.groupBy("digest").agg(F.min("block").alias("block"), F.max("block").alias("other"))
    checked = F.when(F.col("block") == F.col("other"), True).otherwise(F.raise_error(F.lit("two blocks share a digest"))).alias("checked")
    # Written before the join, so that the join can split the rows of a hot block.
    names = scratch.save(_numbered(blocks.select("digest", checked), ["digest"], 0).select("digest", "name"))
    seq = scratch.save(rows.join(names, "digest").select("row", "id", "sha", "left_over", "pos", "name"))

    done, level = [], 0
    while True:
        done.append(seq.where("left_over = 1").select("row", "id", "sha", "name"))
        longer = seq.where("left_over > 1")
        if longer.isEmpty():
            break
        level += 1
        pairs = scratch.save(longer.groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max("id").alias("id"), F.max("sha").alias("sha"), F.expr("(max(left_over) + 1) div 2").cast("int").alias("left_over"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        ))
        names = scratch.save(_numbered(pairs.select("left", "right").distinct(), ["left", "right"], level))
        seq = scratch.save(pairs.join(names, ["left", "right"]).select("row", "id", "sha", "left_over", "pos", "name"))
        scratch.drop(pairs)
    return reduce(DataFrame.unionAll, done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, a row per input row.

    Texts are equal when identical after each run of blanks became one space;
    null counts as empty, so null and empty texts form one group. The smallest
    id of a group stays. Of rows that repeat that id one stays. A null id never
    stays while the group has another; a group of null ids has a null
    ``keep_id`` and one row that stays. An empty table gives no rows.
    """
    named = name_documents(docs, id_col, text_col, block_chars)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row")))
    # Both sides are written, so that the join can split the rows of a hot name.
    scratch = Scratch(docs.sparkSession)
    named = scratch.save(named)
    groups = scratch.save(named.groupBy("name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    return named.join(groups, "name").select(
        F.col("id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
