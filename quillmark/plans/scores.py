"""Registered queries of policy metrics, selection scores and rewards in all their variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import metrics, stats
from quillmark.plans.catalogue import query, r6, rounded, t

# --- policy metrics over masked tokens ------------------------------------------------

#: Line items as tokens of their orders: old and new log-probabilities, the mask, the ratio and two weights.
_TOKENS = """
    k AS (SELECT l_orderkey AS s, l_linenumber % 3 <> 0 AS m, -(l_quantity::DOUBLE / 50) AS o, -(l_quantity::DOUBLE / 50) + (l_discount::DOUBLE - 0.05) * 12 AS n FROM lineitem),
    w AS (SELECT *, n - o AS r, least(exp(n - o), 1.5) AS cut, CASE WHEN exp(n - o) <= 1.5 THEN exp(n - o) ELSE 0 END AS masked FROM k)"""


def _tokens(spark, sf_dir) -> DataFrame:
    old = -(F.col("l_quantity").cast("double") / 50)
    new = old + (F.col("l_discount").cast("double") - 0.05) * 12
    k = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), (F.col("l_linenumber") % 3 != 0).alias("m"), old.alias("o"), new.alias("n")).withColumn("r", F.col("n") - F.col("o"))
    k = stats.importance_weights(k, "s", "r", "token", "truncate", 1.5).withColumnRenamed("weight", "cut")
    return stats.importance_weights(k, "s", "r", "token", "mask", 1.5).withColumnRenamed("weight", "masked")


@query(f"""
    WITH {_TOKENS},
    q AS (SELECT s, coalesce(avg(n) FILTER (m), 0) AS mn, coalesce(avg(o) FILTER (m), 0) AS mo, coalesce(avg(r) FILTER (m), 0) AS mr, sum(-r) FILTER (m) AS kl, sum(exp(r) - 1 - r) FILTER (m) AS k3,
                 sum(exp(2 * r) - 1) FILTER (m) AS chi, count(*) FILTER (m) AS c FROM w GROUP BY s)
    SELECT round(sum(kl) / sum(c), 6) AS kl, round(sum(k3) / sum(c), 6) AS k3_kl, round(sum(chi) / sum(c), 6) AS chi2_token, round(avg(exp(2 * mr) - 1), 6) AS chi2_seq,
           round(avg(exp(-mn)), 6) AS training_ppl, round(avg(exp(-mo)), 6) AS rollout_ppl, round(avg(-mn), 6) AS training_log_ppl, round(avg(-mo), 6) AS rollout_log_ppl, round(avg(mo - mn), 6) AS log_ppl_diff,
           round(avg(abs(mo - mn)), 6) AS log_ppl_abs_diff, round(max(mo - mn), 6) AS log_ppl_diff_max, round(min(mo - mn), 6) AS log_ppl_diff_min, round(avg(exp(mo - mn)), 6) AS ppl_ratio FROM q""")
def off_policy_masked(spark, sf_dir):
    return rounded(metrics.off_policy(_tokens(spark, sf_dir), "s", "o", "n", "m"))


def _correction(weight: str, clipped: str) -> str:
    w = f"greatest(least({weight}, 1.5), 1 / 1.5)"
    return f"""
        (SELECT avg({weight}) AS mean, 1 / greatest(avg({w} * {w}) / pow(avg({w}) + 1e-8, 2), 1e-10) AS ess, {clipped} AS clipped FROM w WHERE m)"""


@query(f"""
    WITH {_TOKENS}, g AS (SELECT avg((exp(x) > 1.5)::INT::DOUBLE) AS clipped FROM (SELECT s, avg(r) AS x FROM w WHERE m GROUP BY s))
    SELECT mode, round(mean, 6) AS is_weight_mean, round(ess, 6) AS ess, round(clipped, 6) AS clipped_frac FROM (
        SELECT 'token_truncate' AS mode, * FROM {_correction("cut", "avg((exp(r) > 1.5)::INT::DOUBLE)")}
        UNION ALL SELECT 'token_mask', * FROM {_correction("masked", "avg((masked = 0)::INT::DOUBLE)")}
        UNION ALL SELECT 'sequence_mask', * FROM {_correction("masked", "(SELECT clipped FROM g)")})""")
def importance_corrections(spark, sf_dir):
    k, out = _tokens(spark, sf_dir), None
    for mode, weight in (("token_truncate", "cut"), ("token_mask", "masked"), ("sequence_mask", "masked")):
        one = rounded(metrics.importance_correction(k, "s", "r", weight, mode, 1.5, "m")).select(F.lit(mode).alias("mode"), "is_weight_mean", "ess", "clipped_frac")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    WITH r AS (SELECT CASE WHEN event_id % 7 <> 0 THEN value::DOUBLE END AS a, CASE WHEN event_id % 5 <> 0 THEN value::DOUBLE * 2 END AS b FROM events)
    SELECT 'a' AS name, round(avg(a), 4) AS mean, round(stddev_samp(a), 4) AS std, count(a) AS n FROM r UNION ALL SELECT 'b', round(avg(b), 4), round(stddev_samp(b), 4), count(b) FROM r""")
def rewards_by_function(spark, sf_dir):
    """Every seventh value is null, every fifth is not a number."""
    v = F.col("value").cast("double")
    e = t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, v).alias("a"), F.when(F.col("event_id") % 5 != 0, v * 2).otherwise(float("nan")).alias("b"))
    return metrics.rewards_by_function(e, ["a", "b"]).select("name", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query("""
    WITH g AS (SELECT greatest(count(*) FILTER (toxic = 0), 1) AS d, greatest(count(*) FILTER (toxic = 1), 1) AS u, count(*) FILTER (toxic = 0) AS dn, count(*) FILTER (toxic = 1) AS un FROM labels)
    SELECT dn AS desirable, un AS undesirable, round(u * 0.5 / d, 6) AS desirable_low, round(u * 0.5 * 1.33 / d, 6) AS desirable_high, round(d * 2 / (u * 1.33), 6) AS undesirable_low, round(d * 2.0 / u, 6) AS undesirable_high FROM g""")
def kto_weighted_bounds(spark, sf_dir):
    return rounded(metrics.kto_bounds(t(spark, sf_dir, "labels").select((F.col("toxic") == 0).alias("good")), "good", 2.0, 0.5))


# --- selection scores -----------------------------------------------------------------


def _items(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_discount").cast("double").alias("reward"))
    # Rounded, so that values that are equal but for their last bits tie in any engine.
    s = stats.item_stats(li, "item", "reward")
    return s.withColumn("reward_mean", F.round("reward_mean", 9)).withColumn("reward_std", F.round("reward_std", 9))


_STATS = """
    s AS (SELECT l_orderkey AS item, round(avg(l_discount::DOUBLE), 9) AS reward_mean, round(stddev_pop(l_discount::DOUBLE), 9) AS reward_std, max(l_discount::DOUBLE) AS reward_max FROM lineitem GROUP BY l_orderkey),
    g AS (SELECT avg(reward_mean) AS m, stddev_pop(reward_mean) AS sm, count(*) AS n FROM s)"""


@query(f"""
    WITH {_STATS},
    v AS (SELECT item, exp(-pow(reward_mean - m, 2) / (2 * pow(sm, 2) + 1e-6)) AS s_mid, (row_number() OVER (ORDER BY reward_std, item) - 1) / greatest(1, n - 1) AS s_var FROM s, g)
    SELECT item, round(s_mid, 6) AS s_mid, round(s_var, 6) AS s_var, round(s_mid * s_var / sum(s_mid * s_var) OVER (), 9) AS probability FROM v""")
def value_by_percentile(spark, sf_dir):
    v = stats.value_probability(_items(spark, sf_dir), variance="percentile", order=("item",))
    return v.select("item", r6("s_mid").alias("s_mid"), r6("s_var").alias("s_var"), F.round("probability", 9).alias("probability"))


@query(f"""
    WITH {_STATS},
    p AS (SELECT item, reward_max, (row_number() OVER (ORDER BY reward_mean, item) - 1) / greatest(1, n - 1) AS a, (row_number() OVER (ORDER BY reward_std, item) - 1) / greatest(1, n - 1) AS b FROM s, g)
    SELECT item, round(CASE WHEN reward_max < 0.05 THEN 0 ELSE (a * 1 + b * 3) / 4 END, 6) AS score FROM p""")
def postprocess_mean(spark, sf_dir):
    return stats.postprocess_score(_items(spark, sf_dir), ["item"], {"reward_mean": 1.0, "reward_std": 3.0}, {"reward_max": 0.05}, mode="mean").select("item", r6("score").alias("score"))


@query("""
    WITH k AS (SELECT user_id FROM events GROUP BY user_id HAVING stddev_samp(value::DOUBLE) > 0)
    SELECT event_id, user_id FROM events SEMI JOIN k USING (user_id) ORDER BY event_id LIMIT 500""")
def dynamic_batch(spark, sf_dir):
    """Groups without variance go, and the batch is full at 500 rows."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").cast("double").alias("value"))
    return stats.varied_groups(e, "user_id", "value", 500, ["event_id"]).select("event_id", "user_id")
