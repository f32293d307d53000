"""Per-item statistics, values, probabilities, ranks, advantages, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.compose import largest, ranked, running_total, uniform

EPS = 1e-6


def item_stats(samples: DataFrame, key: str, reward: str, items: DataFrame | None = None) -> DataFrame:
    """Count, mean, population deviation, least and greatest reward per item; zeros for no sample."""
    r = F.col(reward).cast("double")
    stats = samples.groupBy(key).agg(F.count(r).alias("num_samples"), *[F.coalesce(f(r), F.lit(0.0)).alias(f"reward_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
    if items is None:
        return stats
    return items.select(key).join(stats, key, "left").fillna(0)


def value_probability(
    stats: DataFrame, tau_mu: float = 1.0, tau_sigma: float = 1.0, target: float | None = None, eps: float = EPS, variance: str = "exp_std", order: tuple[str, ...] = (),
) -> DataFrame:
    """Adds ``s_mid, s_var, value, probability``; the three global numbers are one broadcast row.

    ``s_var`` grows with the deviation as 1 - exp(-deviation / scale), or is
    (``variance="percentile"``) its percentile, ties in the given order.
    """
    if variance not in ("exp_std", "percentile"):
        raise ValueError(f"unknown variance {variance!r}")
    g = stats.agg(F.avg("reward_mean").alias("__m"), F.stddev_pop("reward_mean").alias("__sm"), F.stddev_pop("reward_std").alias("__ss"))
    m = F.lit(target) if target is not None else F.col("__m")
    mid = F.exp(-F.pow(F.col("reward_mean") - m, 2) / (2 * F.pow(tau_mu * F.col("__sm"), 2) + eps))
    var = 1 - F.exp(-F.col("reward_std") / (tau_sigma * F.col("__ss") + eps))
    if variance == "percentile":
        stats, var = ordinal_percentile(stats, "reward_std", list(order), "__p"), F.col("__p")
    out = stats.join(F.broadcast(g)).withColumn("s_mid", mid).withColumn("s_var", var).withColumn("value", F.col("s_mid") * F.col("s_var"))
    out = out.drop("__m", "__sm", "__ss", "__p")
    return normalize_probability(out, "value")


def normalize_probability(df: DataFrame, value: str, out: str = "probability") -> DataFrame:
    """Shares of the total, or equal shares if the total is not positive."""
    g = df.agg(F.sum(value).alias("__t"), F.count(F.lit(1)).alias("__n"))
    return df.join(F.broadcast(g)).withColumn(out, F.when(F.col("__t") > 0, F.col(value) / F.col("__t")).otherwise(1.0 / F.col("__n"))).drop("__t", "__n")


def with_group(df: DataFrame, group: str, **aggregates: Column) -> DataFrame:
    """Adds aggregates of each row's group.

    They are combined before the shuffle and joined back, so a group that holds
    a third of all rows is never gathered. Null is a group.
    """
    g = df.groupBy(F.col(group).alias("__group")).agg(*[c.alias(k) for k, c in aggregates.items()])
    return df.join(g, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def group_probability(df: DataFrame, group: str, deviation: str, eps: float = EPS) -> DataFrame:
    x = F.col(deviation) + eps
    return with_group(df, group, __sum=F.sum(x)).withColumn("probability", x / F.col("__sum")).drop("__sum")


def gumbel_topk(df: DataFrame, probability: str, k: int, ids: tuple[str, ...], seed: int = 42) -> DataFrame:
    """Weighted sample without replacement: the k largest log p + Gumbel noise."""
    u = uniform(seed, *[F.col(c) for c in ids])
    score = F.log(F.greatest(F.col(probability), F.lit(1e-12))) - F.log(-F.log(u))
    return largest(df.withColumn("gumbel", score), F.col("gumbel"), [F.col(c) for c in ids], k)


def group_topk(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Each task passes on k rows a group at most (the optimizer's group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def ordinal_percentile(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """(position - 1) / max(1, n - 1); ties stand in the given order."""
    r = ranked(df, [F.col(value), *[F.col(c) for c in order]], "__rn", "__total")
    return r.withColumn(out, (F.col("__rn") - 1) / F.greatest(F.lit(1), F.col("__total") - 1).cast("double")).drop("__rn", "__total")


def postprocess_score(df: DataFrame, order: list[str], weights: dict[str, float], gates: dict[str, float] | None = None, mode: str = "product") -> DataFrame:
    """Product of percentile ranks to their weights, or their weighted mean, zero where a gate is missed."""
    if mode not in ("product", "mean"):
        raise ValueError(f"unknown mode {mode!r}")
    score = F.lit(1.0 if mode == "product" else 0.0)
    for c, w in weights.items():
        df = ordinal_percentile(df, c, order, f"p_{c}")
        p = F.col(f"p_{c}")
        score = score * F.pow(p, F.lit(w)) if mode == "product" else score + p * w
    if mode == "mean":
        total = sum(weights.values())
        score = score / total if total > 0 else F.lit(0.0)
    for c, least in (gates or {}).items():
        score = F.when(F.col(c) < least, 0.0).otherwise(score)
    return df.withColumn("score", score)


def overlap(runs: DataFrame, run: str, item: str) -> DataFrame:
    """Every pair of runs: sizes, shared items, and the shares of union and of either run."""
    sel = runs.select(F.col(run).alias("run"), F.col(item).alias("item")).distinct()
    sizes = sel.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    a, b = sel.toDF("run_a", "item"), sel.toDF("run_b", "item")
    both = a.join(b, "item").where("run_a < run_b").groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("shared"))
    s = lambda x: sizes.toDF(f"run_{x}", f"n_{x}")
    pairs = s("a").join(s("b"), F.col("run_a") < F.col("run_b"))
    out = pairs.join(both, ["run_a", "run_b"], "left").fillna(0, ["shared"])
    return out.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))


def selection_auc(df: DataFrame, score: str, selected: str) -> DataFrame:
    """P(selected scores higher), ties half: from counts per distinct score."""
    by = df.groupBy(score).agg(F.sum(F.col(selected).cast("long")).alias("pos"), F.sum((~F.col(selected)).cast("long")).alias("neg"))
    acc = running_total(by, [F.col(score)], F.col("neg"), "below")
    return acc.agg((F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins, the last one closed; one bin if all values are equal."""
    g = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0)
    return df.join(F.broadcast(g)).where(F.col(value).isNotNull()).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def advantages(df: DataFrame, group: str, reward: str, estimator: str = "grpo", scale: str = "group", eps: float = 1e-4) -> DataFrame:
    """Group-relative advantages; a null reward counts as zero.

    grpo: minus the group's mean. rloo: minus the mean of the others.
    reinforce_plus_plus: minus the group's mean, then divided by a deviation of
    the differences themselves. ``scale`` names the sample deviation to divide
    by: none, group or batch; a deviation of one row is zero.
    """
    if scale not in ("none", "group", "batch"):
        raise ValueError(f"unknown scale {scale!r}")
    df = with_group(df.withColumn("__r", F.coalesce(F.col(reward).cast("double"), F.lit(0.0))), group, __m=F.avg("__r"), __c=F.count(F.lit(1)), __gs=F.stddev_samp("__r"))
    centred = F.col("__r") - F.col("__m")
    if estimator == "rloo":
        centred = F.when(F.col("__c") > 1, centred * F.col("__c") / (F.col("__c") - 1)).otherwise(0.0)
    df = df.withColumn("advantage", centred)
    if scale == "batch":
        of = "advantage" if estimator == "reinforce_plus_plus" else "__r"
        g = df.agg(F.coalesce(F.stddev_samp(of), F.lit(0.0)).alias("__s"))
        df = df.join(F.broadcast(g)).withColumn("advantage", F.col("advantage") / (F.col("__s") + eps)).drop("__s")
    elif scale == "group":
        # Taking off the mean of a group leaves its deviation as it is.
        df = df.withColumn("advantage", F.col("advantage") / (F.coalesce(F.col("__gs"), F.lit(0.0)) + eps))
    return df.drop("__r", "__m", "__c", "__gs")


def weighted_reward(rewards: dict[str, float]) -> Column:
    """Weighted sum of reward columns; a reward that is null or nan adds nothing."""
    total = F.lit(0.0)
    for c, w in rewards.items():
        total = total + F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) * w, F.lit(0.0))
    return total


def gdpo_advantages(df: DataFrame, group: str, rewards: dict[str, float], eps: float = 1e-8) -> DataFrame:
    """Each reward whitened within its group, weighted and summed, and the sums whitened over the batch.

    Null and nan rewards, and rewards of a group with one of them, count as zero.
    """
    own = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in rewards}
    sums: dict[str, Column] = {}
    for i, c in enumerate(rewards):
        sums |= {f"__m{i}": F.avg(own[c]), f"__s{i}": F.stddev_samp(own[c])}
    df = with_group(df, group, **sums)
    total = F.lit(0.0)
    for i, (c, w) in enumerate(rewards.items()):
        total = total + w * F.coalesce((own[c] - F.col(f"__m{i}")) / (F.col(f"__s{i}") + eps), F.lit(0.0))
    df = df.withColumn("advantage", total).drop(*sums)
    g = df.agg(F.avg("advantage").alias("__m"), F.coalesce(F.stddev_samp("advantage"), F.lit(0.0)).alias("__s"))
    return df.join(F.broadcast(g)).withColumn("advantage", (F.col("advantage") - F.col("__m")) / (F.col("__s") + eps)).drop("__m", "__s")


def varied_groups(df: DataFrame, group: str, reward: str, size: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Keeps the groups whose rewards differ; with ``size``, the first so many of their rows in an order, as sampling stops there."""
    keep = df.groupBy(group).agg(F.stddev_samp(reward).alias("__s")).where("__s > 0").select(group)
    out = df.join(keep, group, "left_semi")
    return out if size is None else ranked(out, [F.col(c) for c in order or [group]], "__rn").where(F.col("__rn") <= size).drop("__rn")


def minmax(df: DataFrame, value: str, group: str) -> DataFrame:
    """(x - min) / (max - min + 1e-5) in a group; constant groups give min(1, x)."""
    df, lo, hi = with_group(df, group, __lo=F.min(value), __hi=F.max(value)), F.col("__lo"), F.col("__hi")
    scaled = F.when(hi > lo, (F.col(value) - lo) / (hi - lo + 1e-5)).otherwise(F.least(F.lit(1.0), F.col(value)))
    return df.withColumn("scaled", scaled).drop("__lo", "__hi")


def dedup(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order (descending columns keep the last).

    Each task passes on one row a key (the optimizer's group limit).
    """
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def fill_first_wins(df: DataFrame, meta: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """Fills null and empty fields from the first metadata row of the key."""
    m = dedup(meta.where(F.col(key).isNotNull()), key, order).select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    out = df.join(m, key, "left")
    for c in fields:
        mine = F.when(F.col(c).cast("string") != "", F.col(c)) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(mine, F.col(f"__{c}"))).drop(f"__{c}")
    return out


def best_of_n(df: DataFrame, query: str, choice: str, score: str, keep: int = 1) -> DataFrame:
    """The best choices of each query, each paired with its single worst choice; a query's only choice has no pair.

    The worst is an aggregate and the best pass a group limit, so no query is gathered.
    """
    r = with_group(df, query, rejected=F.min_by(choice, F.struct(F.col(score), F.col(choice))), __n=F.count(F.lit(1)))
    return group_topk(r, query, [F.desc(score), F.col(choice)], keep).where(F.col("rank") < F.col("__n")).drop("__n")


def best_of_n_scored(
    df: DataFrame, query: str, choice: str, orm: str, prm: str | None = None, orm_least: float | None = None, prm_least: float | None = None,
    keep: int = 1, returned: int | None = None, easy: float | None = None,
) -> DataFrame:
    """``query, choice, rejected, score``: the best choices of a query that pass, each with the query's worst.

    A choice scores ten times its outcome reward and its process reward, both
    scaled to 0 to 1 within the query. It passes if its raw rewards are over
    their least values. A query of which no choice passes goes, and so does an
    easy one: over ``returned * easy`` choices but one have some outcome
    reward. Of equal scores the greater choice comes first.
    """
    scaled = minmax(df, orm, query).withColumnRenamed("scaled", "__o")
    scaled = minmax(scaled, prm, query).withColumnRenamed("scaled", "__p") if prm else scaled.withColumn("__p", F.lit(1.0))
    passes = F.lit(True)
    for c, at_least in ((orm, orm_least), (prm, prm_least)):
        if c and at_least is not None:
            passes = passes & F.coalesce(F.col(c) > at_least, F.lit(False))
    rows = scaled.withColumn("score", F.col("__p") + 10 * F.col("__o")).withColumn("__ok", passes)
    rows = with_group(rows, query, __any=F.max("__ok"), __worst=F.min_by(choice, F.struct("score", choice)), __some=F.count_if(F.col("__o") > 0)).where("__any")
    if easy is not None and returned:
        rows = rows.where(F.col("__some") - 1 < int(returned * easy))
    top = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.desc(choice)))).where(F.col("__rn") <= keep)
    return top.where(F.col("__ok") & (F.col(choice) != F.col("__worst"))).select(query, choice, F.col("__worst").alias("rejected"), "score")


def marker_sessions(df: DataFrame, key: str | None, order: list[str], marker: Column) -> DataFrame:
    """Adds ``session``: each marked row starts one; rows before the first marker join the first session.

    Sessions are numbered within ``key``, or over all rows, by a running total
    in range parts, so neither a hot key nor the whole table is one sort.
    """
    keys = [key] if key else []
    upto = running_total(df, [F.col(c) for c in (*keys, *order)], F.coalesce(marker, F.lit(False)).cast("long"), "__upto")
    upto = upto.withColumn("__upto", F.col("__upto") + F.coalesce(marker, F.lit(False)).cast("long"))
    if not key:
        return upto.withColumn("session", F.greatest(F.lit(1), F.col("__upto"))).drop("__upto")
    first = F.min(F.col("__upto") - F.coalesce(marker, F.lit(False)).cast("long")).alias("__first")
    firsts = upto.groupBy(F.col(key).alias("__key")).agg(first)
    out = upto.join(firsts, F.col(key).eqNullSafe(F.col("__key")))
    return out.withColumn("session", F.greatest(F.lit(1), F.col("__upto") - F.col("__first"))).drop("__upto", "__key", "__first")


def session_messages(df: DataFrame, order: list[str], marker: Column, query: str, response: str, task: str | None = None, media: str | None = None, key: str | None = None) -> DataFrame:
    """``session, messages`` (and ``media``): the rows of each session folded into one conversation, in order.

    A row is a user's and an assistant's message; the query that opens a session
    by its marker has the task on a line of its own below. A null text is empty.
    One conversation is one row, as its messages must be; no more is gathered.
    """
    rows = marker_sessions(df.withColumn("__mark", F.coalesce(marker, F.lit(False))), key, order, F.col("__mark"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    asked = F.when(F.col("__mark"), F.concat(text(query), F.lit("\n"), text(task))).otherwise(text(query)) if task else text(query)
    said = F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")), F.struct(F.lit("assistant").alias("role"), text(response).alias("content")))
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], said.alias("said"), *([F.col(media).alias("media")] if media else []))
    by = [key, "session"] if key else ["session"]
    folded = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    shown = [F.transform("rows", lambda r: r["media"]).alias(media)] if media else []
    return folded.select(*by, F.flatten(F.transform("rows", lambda r: r["said"])).alias("messages"), *shown)


def kto_shift(df: DataFrame, batch: str, order: list[str], response: str) -> DataFrame:
    """Each row's ``rejected_response`` is the response before it in its batch, cyclic."""
    w = Window.partitionBy(batch).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("rejected_response", F.coalesce(F.lag(response).over(w), F.last(response).over(whole)))


def importance_weights(df: DataFrame, sequence: str, log_ratio: str, level: str = "token", mode: str = "truncate", threshold: float = 2.0) -> DataFrame:
    """Weights of tokens from clamped log ratios; sequences use the geometric mean."""
    r = F.greatest(F.least(F.col(log_ratio), F.lit(20.0)), F.lit(-20.0))
    if level != "token":
        df, r = with_group(df, sequence, __mean=F.avg(r)), F.col("__mean")
    rho = F.exp(r)
    out = df.withColumn("weight", F.least(rho, F.lit(threshold)) if mode == "truncate" else F.when(rho <= threshold, rho).otherwise(0.0))
    return out.drop("__mean")
