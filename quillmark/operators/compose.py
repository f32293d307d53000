"""Sampling, splitting, concatenation, interleaving, packing.

Randomness is a hash of a seed and an id, so results do not depend on how rows
are partitioned. ``order`` names the columns that number the rows.
"""

from __future__ import annotations

import bisect
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.scratch import Scratch


def uniform(seed: int, *ids: Column) -> Column:
    """Uniform in (0, 1) from an MD5, the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ids])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample(df: DataFrame, n: int, ids: tuple[str, ...] = (), seed: int = 42, shuffle: bool = True) -> DataFrame:
    """n rows: whole copies of the table, then a random (or the first) part of one.

    Without ids a hash of the whole row stands in for one, so the choice does
    not depend on partitioning. An empty table stays empty.
    """
    total = df.count()
    if not total:
        return df
    copies, rest = divmod(n, total)
    parts = [df.join(F.broadcast(df.sparkSession.range(copies).select()), how="cross")] if copies else []
    if rest or not parts:
        keys = [F.col(c) for c in ids] or [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
        parts.append(least(df, uniform(seed, *keys), keys, rest, total) if shuffle else ranked(df, keys, "__rn").where(F.col("__rn") <= rest).drop("__rn"))
    return reduce(DataFrame.unionAll, parts)


def near_cut(u: Column, k: int, n: int) -> Column:
    """A test that holds for at least the k of n rows with the least ``u``, and for few more, unless values of ``u`` repeat a lot."""
    share = k / max(n, 1)
    return u <= share + 8 * (share / max(n, 1)) ** 0.5 + 40 / max(n, 1)


def least(df: DataFrame, u: Column, ids: list[Column], k: int, n: int) -> DataFrame:
    """The k rows of least ``u``, a uniform hash; ties go by the ids. Only rows below a cut are sorted."""
    near = df.where(near_cut(u, k, n))
    if near.count() < k:
        near = df
    return ranked(near, [u, *ids], "__rn").where(F.col("__rn") <= k).drop("__rn")


#: Up to so many rows each task may pass on in a top-k.
FEW = 10_000


def largest(df: DataFrame, score: Column, ids: list[Column], k: int) -> DataFrame:
    """The k rows of the greatest score; ties go by the ids, and null scores last.

    A small k is a plain top-k, of which no task passes on more than ``FEW``
    rows. Beyond that, only rows over a cut near the k-th score are ranked, in
    range parts, so no task holds k rows more than its share.
    """
    if k <= FEW:
        return df.withColumn("__score", score).orderBy(F.col("__score").desc_nulls_last(), *ids).limit(k).drop("__score")
    rows = Scratch(df.sparkSession).save(df.withColumn("__score", score))
    n = rows.count()
    if k < n:
        share = 1 - min(1.0, 1.1 * k / n + 40 / n)
        cut = rows.agg(F.percentile_approx("__score", F.lit(share), F.lit(10_000))).first()[0]
        near = rows.where(F.col("__score") >= cut) if cut is not None else rows
        rows = near if near.count() >= k else rows
    return ranked(rows, [F.col("__score").isNull(), -F.col("__score"), *ids], "__rn").where(F.col("__rn") <= k).drop("__rn", "__score")


def range_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in the shared folder, with ``__part`` and ``__at``: sorting by both gives the order.

    Rows are range-partitioned, sorted and written once. All that is counted or
    numbered later is read from what was written: each job that partitions by
    range draws bounds of its own, so two jobs need not agree.
    """
    keys = [f"__key{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return Scratch(df.sparkSession).save(rows.select("*", F.spark_partition_id().alias("__part"), place.alias("__at")).drop(*keys))


def before_parts(parts: DataFrame, **sums: Column) -> DataFrame:
    """``__part`` and, for each aggregate, its sum over the parts before; one row a part, so small."""
    got = parts.groupBy("__part").agg(*[c.alias(k) for k, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    return F.broadcast(got.select("__part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums], *[F.sum(k).over(whole).alias(f"{k}_total") for k in sums]))


def ranked(df: DataFrame, order: list[Column], name: str = "rn", total: str | None = None) -> DataFrame:
    """Numbers all rows from 1 in an order, without one task that sees them all.

    ``total`` names a column for the number of rows. Rows that tie in ``order``
    are numbered in an arbitrary order of their own.
    """
    parts = range_parts(df, order)
    out = parts.join(before_parts(parts, __before=F.count(F.lit(1))), "__part")
    out = out.withColumn(name, (F.col("__before") + F.col("__at") + 1).cast("long"))
    if total:
        out = out.withColumn(total, F.col("__before_total"))
    return out.drop("__part", "__at", "__before", "__before_total")


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, in an order of all rows."""
    parts = range_parts(df.withColumn("__v", value), order)
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn(name, F.coalesce(F.sum("__v").over(inside), F.lit(0))).join(before_parts(parts, __before=F.sum("__v")), "__part")
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__at", "__v", "__before", "__before_total")


def ranked_within(df: DataFrame, group: list[str], order: list[Column], name: str = "rn", total: str | None = None) -> DataFrame:
    """Numbers the rows of each group from 1, also where one group holds most rows.

    All rows are numbered by group and order; a group's first number is taken off.
    """
    r = ranked(df, [*[F.col(g) for g in group], *order], "__pos")
    first = r.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias(total or "__n"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)])
    out = r.join(first, same).withColumn(name, F.col("__pos") - F.col("__first") + 1)
    return out.drop("__pos", "__first", "__n", *[f"__g{i}" for i in range(len(group))])


def medians(df: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    """The exact median of each group; nulls are left out.

    Equal values are counted first, so that a value that most rows share is one
    row; running totals of the counts then find the two middle values.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    upto = running_total(rows, [*[F.col(g) for g in group], F.col("__x")], F.col("__c"), "__upto")
    ends = upto.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.min("__upto").alias("__first"), F.sum("__c").alias("__m"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], F.lit(True))
    at = upto.join(ends, same).withColumn("__lo", F.col("__upto") - F.col("__first")).withColumn("__hi", F.col("__lo") + F.col("__c"))
    holds = lambda k: (F.col("__lo") < k) & (k <= F.col("__hi"))
    low, high = F.floor((F.col("__m") + 1) / 2), F.floor(F.col("__m") / 2) + 1
    middle = at.where(holds(low) | holds(high))
    return middle.groupBy(*group).agg(F.avg("__x").alias(name))


def first(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of an order."""
    return ranked(df, order, "__rn").where(F.col("__rn") <= n).drop("__rn")


def after(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """All but the first n rows of an order."""
    return ranked(df, order, "__rn").where(F.col("__rn") > n).drop("__rn")


def shards(df: DataFrame, n: int, order: list[Column], contiguous: bool = True, name: str = "shard") -> DataFrame:
    """Numbers n shards from 0: stretches of the order whose sizes differ by one at most, the longer ones first, or every n-th row."""
    r = ranked(df, order, "__rn", "__m")
    at = F.col("__rn") - 1
    size, longer = F.floor(F.col("__m") / n), F.col("__m") % n
    edge = longer * (size + 1)
    # Without rows in the shorter shards nothing is beyond the edge.
    stretch = F.when(at < edge, F.floor(at / (size + 1))).otherwise(longer + F.floor((at - edge) / F.greatest(size, F.lit(1))))
    return r.withColumn(name, (stretch if contiguous else at % n).cast("long")).drop("__rn", "__m")


def list_split(df: DataFrame, n: int, order: list[Column], name: str = "shard") -> DataFrame:
    """Numbers n stretches of the order from 0, stretch i from row floor(i * rows / n) on."""
    r = ranked(df, order, "__rn", "__m")
    return r.withColumn(name, F.expr(f"(__rn * {n} - 1) div __m")).drop("__rn", "__m")


def pieces(df: DataFrame, n: int, order: list[Column], name: str = "piece") -> DataFrame:
    """n pieces of equal size; the rows that are left over go."""
    r = ranked(df, order, "__rn", "__m")
    size = F.floor(F.col("__m") / n)
    return r.where(F.col("__rn") <= size * n).withColumn(name, F.floor((F.col("__rn") - 1) / F.greatest(size, F.lit(1))).cast("long")).drop("__rn", "__m")


def sample_ratio(df: DataFrame, ratio: float, ids: tuple[str, ...], seed: int = 42) -> DataFrame:
    """int(n * ratio) rows, one at least; a ratio over 1 repeats the table, one of 0 gives none."""
    return sample(df, max(1, int(df.count() * ratio)), ids, seed) if ratio > 0 else df.limit(0)


def by_median(df: DataFrame, group: str, value: str, name: str = "bucket") -> DataFrame:
    """``high`` from the group's median on, else ``low``."""
    mid = medians(df, [group], value, "__median").withColumnRenamed(group, "__group")
    out = df.join(mid, F.col(group).eqNullSafe(F.col("__group")), "left")
    return out.withColumn(name, F.when(F.col(value) >= F.col("__median"), "high").otherwise("low")).drop("__median", "__group")


def split(df: DataFrame, ratio: float, ids: tuple[str, ...], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and validation: max(int(n * ratio), 1) rows of the smallest hashes validate.

    The hash and ids of the last validating row bound the two sides, so either
    is a filter; rows that repeat an id stay on one side.
    """
    if ratio <= 0:
        return df, df.limit(0)
    if ratio >= 1:
        return df.limit(0), df
    n = df.count()
    k, u, keys = max(int(n * ratio), 1), uniform(seed, *[F.col(c) for c in ids]), [F.col(c) for c in ids]
    if not n:
        return df, df
    hashes = df.select(u.alias("__u"), *keys)
    near = hashes.where(near_cut(F.col("__u"), k, n))
    if near.count() < k:
        near = hashes
    last = ranked(near, [F.col("__u"), *keys], "__rn").where(F.col("__rn") == k).first()
    kinds = dict(df.dtypes)
    edge = F.struct(F.lit(last["__u"]).alias("__u"), *[F.lit(last[c]).cast(kinds[c]).alias(c) for c in ids])
    own = F.struct(u.alias("__u"), *keys)
    return df.where(own > edge), df.where(own <= edge)


def round_robin(df: DataFrame, domain: str, weights: dict[str, int], order: list[Column]) -> DataFrame:
    """Cycles through the domains, taking up to a domain's weight of rows each time.

    ``position`` gives the order. An exhausted domain is skipped. A row's round
    follows from its rank in its own domain; the rows that each domain gives in
    each round are counted, and a running total over rounds and domains gives
    the place at which a domain's turn starts.
    """
    known = df.sparkSession.createDataFrame([(n, w, i) for i, (n, w) in enumerate(weights.items())], "__name string, __w long, __d long")
    r = ranked_within(df.where(F.col(domain).isNotNull()), [domain], order, "__rn")
    r = r.join(F.broadcast(known), F.col(domain) == F.col("__name")).drop("__name")  # one row for each given weight
    r = r.withColumn("round", F.floor((F.col("__rn") - 1) / F.col("__w")))
    turns = r.groupBy(F.col("round").alias("__t"), F.col("__d").alias("__e")).agg(F.count(F.lit(1)).alias("__c"))
    starts = running_total(turns, [F.col("__t"), F.col("__e")], F.col("__c"), "__start").drop("__c")
    out = r.join(starts, (F.col("round") == F.col("__t")) & (F.col("__d") == F.col("__e")))
    place = F.col("__start") + F.col("__rn") - F.col("round") * F.col("__w")
    return out.withColumn("position", place.cast("long")).drop("__rn", "__w", "__d", "__t", "__e", "__start")


def interleave(frames: list[DataFrame], probabilities: list[float], order: list[str], seed: int = 42, stop: str = "first_exhausted") -> DataFrame:
    """Draws a source per step by probability; ``position`` gives the order.

    Step s takes the next row of the source that a hash of s chooses. The draw
    of a source's k-th row is found from the running count of its steps. So
    many steps are laid out that the last one needed is missed by a chance
    under 1e-15.
    """
    spark = frames[0].sparkSession
    sizes = [f.count() for f in frames]
    if not all(sizes):
        raise ValueError("an empty source cannot be interleaved")
    reach = [n / p + 12 * (n * (1 - p)) ** 0.5 / p + 40 / p for n, p in zip(sizes, probabilities, strict=True) if p > 0]
    steps = int(min(reach) if stop == "first_exhausted" else max(reach))
    cuts = [sum(probabilities[: i + 1]) for i in range(len(frames))]
    u = uniform(seed, F.col("id"))
    source = F.coalesce(*[F.when(u < c, i) for i, c in enumerate(cuts)], F.lit(len(frames) - 1))
    draws = ranked_within(spark.range(steps).select(F.col("id").alias("position"), source.alias("source")), ["source"], [F.col("position")], "k")
    n_of = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col("source") + 1)
    ends = [r[0] for r in draws.where(F.col("k") - 1 == n_of).select("position").collect()]  # at most one row a source
    known = ends + [steps] * (sum(p > 0 for p in probabilities) - len(ends))
    last = min(known) if stop == "first_exhausted" else max(known)
    # The row's number is worked out on the draws' side, so that both conditions are keys of the join.
    turn = draws.where(F.col("position") < last).select("position", F.col("source").alias("__s"), (F.pmod(F.col("k") - 1, n_of) + 1).cast("long").alias("__turn"))
    rows = concat([ranked(f, [F.col(c) for c in order], "__k").withColumn("source", F.lit(i)) for i, f in enumerate(frames)])
    return rows.join(turn, (F.col("source") == F.col("__s")) & (F.col("__k") == F.col("__turn"))).drop("__s", "__k", "__turn")


def curriculum(df: DataFrame, bucket: str, ids: tuple[str, ...], mix: list[dict[str, float]] | None = None, seed: int = 42) -> DataFrame:
    """Order of training rows: each bucket's rows are dealt to phases by the phases' weights."""
    mix = mix or [{"low": 0.7, "mid": 0.2, "high": 0.1}, {"low": 0.2, "mid": 0.6, "high": 0.2}, {"low": 0.1, "mid": 0.2, "high": 0.7}]
    u, ids_ = uniform(seed, *[F.col(c) for c in ids]), [F.col(c) for c in ids]
    phase = F.lit(len(mix) - 1)
    for b in {k for m in mix for k in m}:
        w = [m.get(b, 0.0) for m in mix]
        at = F.coalesce(*[F.when(u < sum(w[: i + 1]) / sum(w), i) for i in range(len(w))], F.lit(len(mix) - 1))
        phase = F.when(F.col(bucket) == b, at).otherwise(phase)
    df = df.withColumn("phase", phase)
    return ranked(df, [F.col("phase"), uniform(seed + 1, *ids_), *ids_], "position")


def staged(df: DataFrame, limits: list[float], value: str, ids: tuple[str, ...], seed: int = 42) -> DataFrame:
    """Stages by value (stage k below ``limits[k]``, the last one beyond all) one after another, each in random order; adds ``stage, position``."""
    stage = F.lit(len(limits))
    for k, limit in reversed(list(enumerate(limits))):
        stage = F.when(F.col(value) < limit, k).otherwise(stage)
    keys = [F.col(c) for c in ids]
    return ranked(df.withColumn("stage", stage), [F.col("stage"), uniform(seed, *keys), *keys], "position")


def fullest_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each item: the longest first, each into the fullest bin that has room, else into a new one.

    Of items as long the first goes first, of bins as full the oldest is taken.
    Bins are numbered as they are opened; an item longer than the capacity gets
    one of its own. Open bins stand sorted by their room, so each is found by bisection.
    """
    rooms: list[tuple[int, int]] = []
    out, n = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect.bisect_left(rooms, (lengths[i], -1))
        if at < len(rooms):
            room, out[i] = rooms.pop(at)
        else:
            room, out[i], n = capacity, n, n + 1
        if room > lengths[i]:
            bisect.insort(rooms, (room - lengths[i], out[i]))
    return out


def _chunked(rows: DataFrame, capacity: int, chunk: int) -> DataFrame:
    """Rows ``at, length`` packed by chunks of ``at``: adds ``chunk, bin`` and, for the bin that was opened last, ``open``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        bins = fullest_fit(pdf["length"].tolist(), capacity)
        return pdf.assign(bin=bins, open=[b == max(bins) for b in bins])

    rows = rows.withColumn("chunk", F.floor(F.col("at") / F.lit(chunk)).cast("long"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("chunk").applyInPandas(one, f"{fields}, bin long, open boolean")


def pack(df: DataFrame, id_col: str, length_col: str, capacity: int, chunk: int = 1000) -> DataFrame:
    """``round, chunk, bin, id, length``: rows packed to a capacity; the three first columns name a bin.

    Rows are numbered by id and packed within chunks of a fixed size, as in
    ``fullest_fit``. The bin a chunk opened last is carried on: as one item of
    its length it is packed, a round later, with those of the next chunks, until
    one chunk is left. So no more than one bin stays open, and a round's rows
    are a ``chunk``-th of those before. Rows without a length are left out.
    """
    if chunk < 2:
        raise ValueError("a chunk needs two rows at least")
    scratch = Scratch(df.sparkSession)
    rows = ranked(df.select(F.col(id_col).alias("id"), F.col(length_col).cast("long").alias("length")).where("length IS NOT NULL"), [F.col("id")])
    first = scratch.save(_chunked(rows.select((F.col("rn") - 1).alias("at"), "id", "length"), capacity, chunk))
    closed = [first.where("NOT open").select(F.lit(0).alias("round"), "chunk", "bin", "id", "length")]
    # ``node`` is the bin that the rows of a chunk's open bin are in by now.
    carried = scratch.save(first.where("open").select("id", "length", F.col("chunk").alias("node")))
    level = 0
    while True:
        units = carried.groupBy("node").agg(F.sum("length").alias("length")).select(F.col("node").alias("at"), "length")
        level += 1
        made = scratch.save(_chunked(units, capacity, chunk))
        last = made.agg(F.max("chunk")).first()[0]
        placed = carried.join(made.select(F.col("at").alias("node"), "chunk", "bin", "open"), "node")
        if not last:  # one chunk is left, or none: its bins are final
            closed.append(placed.select(F.lit(level).alias("round"), "chunk", "bin", "id", "length"))
            return reduce(DataFrame.unionAll, closed)
        closed.append(placed.where("NOT open").select(F.lit(level).alias("round"), "chunk", "bin", "id", "length"))
        carried = scratch.save(placed.where("open").select("id", "length", F.col("chunk").alias("node")))


def buckets(df: DataFrame, value: str, order: list[str], n: int) -> DataFrame:
    """Equal-count buckets: bucket i holds rows [i m / n, (i + 1) m / n) of m rows."""
    r = ranked(df, [F.col(value), *[F.col(c) for c in order]], "__rn", "__m")
    return r.withColumn("bucket", F.floor((F.col("__rn") * n - 1) / F.col("__m"))).drop("__rn", "__m")
