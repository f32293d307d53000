"""Connected components of an edge table by random contraction.

In every round each node takes, of itself and its neighbours, the one that a
fresh hash puts first; edges are renamed to the chosen nodes, loops and repeats
go. The number of nodes falls by a constant factor in expectation whatever the
shape of the graph, so a long chain takes logarithmically many rounds. A hub's
edges are never gathered: its choice is a minimum, combined before the shuffle,
and the renaming joins can be split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import Scratch


def connected_components(edges: DataFrame, seed: int = 17) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two long columns).

    Nodes share a root exactly when a path joins them; the root is one of them.
    Loops, repeats and edges with a null end are ignored. No edges, no rows.
    """
    scratch = Scratch(edges.sparkSession)
    a, b = edges.columns[:2]
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    live, mapping, turn = scratch.save(live), None, 0
    while not live.isEmpty():
        both = live.unionAll(live.select("b", "a")).toDF("node", "other")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed + turn)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        chosen = both.groupBy("node").agg(F.min(rank("other")).alias("best"))
        chosen = scratch.save(chosen.select("node", F.least(rank("node"), F.col("best"))["v"].alias("to")))
        ends = [chosen.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
        nxt = live.join(ends[0], "a").join(ends[1], "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        nxt = scratch.save(nxt.where("a <> b").distinct())
        if mapping is None:
            grown = chosen.withColumnRenamed("to", "root")
        else:
            step = chosen.withColumnRenamed("node", "root")
            grown = scratch.save(mapping.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            scratch.drop(mapping, chosen)
        scratch.drop(live)
        live, mapping, turn = nxt, grown, turn + 1
    if mapping is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
