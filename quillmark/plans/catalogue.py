"""The registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import geo, rewards, text, toolcall
from quillmark.operators import chat, compose, encode, metrics, normalize, runs, states, stats
from quillmark.scratch import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_file_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with ``place``, by which its rows stand as in its files: where an order leaves ties open, the earlier row comes first."""
    return t(spark, sf_dir, name).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages``, in the order of turns."""
    c = t(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content")))).alias("m"))
    return g.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.lit(None).cast("double").alias("loss"))).alias("messages"))


def u(seed: int, c: str) -> str:
    """SQL of ``compose.uniform``."""
    return f"((('0x' || substr(md5('{seed}|' || {c}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


# --- conversations -----------------------------------------------------------------

@query("""
    SELECT conv_id, count(*) AS n_messages, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS rendered
    FROM conversations GROUP BY conv_id""")
def conv_to_messages(spark, sf_dir):
    c = normalize.normalize(conversations(spark, sf_dir), keep=("conv_id",))
    return c.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("rendered"))


@query("""
    SELECT conv_id, bool_and(role IN ('system','user','tool_call','tool_response','tool','assistant') AND text IS NOT NULL) AS valid
    FROM conversations GROUP BY conv_id""")
def conv_valid_roles(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", normalize.valid_messages(F.col("messages")).alias("valid"))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, coalesce(max(CASE WHEN role = 'user' THEN i END), -1) AS last_user,
           max(CASE WHEN i = n - 1 AND role = 'assistant' THEN text END) AS response,
           max(n) - max(CASE WHEN i = n - 1 AND role = 'assistant' THEN 1 ELSE 0 END) AS n_left
    FROM r GROUP BY conv_id""")
def conv_remove_response(spark, sf_dir):
    left, response = normalize.remove_response(F.col("messages"))
    return conversations(spark, sf_dir).select("conv_id", normalize.last_user_round(F.col("messages")).cast("long").alias("last_user"), response.alias("response"), F.size(left).cast("long").alias("n_left"))


@query("""
    WITH r AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
               FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, text AS query, CASE WHEN next_role = 'assistant' THEN next_text END AS response FROM r WHERE role = 'user'""")
def conv_history_pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf_dir, "conversations").withColumn("nr", F.lead("role").over(w)).withColumn("nt", F.lead("text").over(w))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), F.when(F.col("nr") == "assistant", F.col("nt")).alias("response"))


@query("""
    SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars
    FROM conversations GROUP BY conv_id""")
def chatml_render(spark, sf_dir):
    m = F.col("messages")
    weighed = F.zip_with(m, chat.loss_spans(m), lambda x, w: F.length(x["content"]) * w)
    return conversations(spark, sf_dir).select("conv_id", chat.chatml(m).alias("rendered"), F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x).cast("long").alias("loss_chars"))


@query("""
    WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, text) AS rk, count(*) OVER (PARTITION BY conv_id) AS n,
          first_value(text) OVER (PARTITION BY conv_id ORDER BY length(text), text) AS rejected FROM a)
    SELECT conv_id, text AS chosen, rejected FROM r WHERE rk <= 1 AND rk < n""")
def rejected_pairs(spark, sf_dir):
    a = t(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("score", F.length("text"))
    return stats.best_of_n(a, "conv_id", "text", "score").select("conv_id", F.col("text").alias("chosen"), "rejected")


@query("""
    WITH a AS (SELECT conv_id, turn, text, conv_id // 8 AS batch FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, coalesce(lag(text) OVER w, last_value(text) OVER (PARTITION BY batch ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS rejected_response
    FROM a WINDOW w AS (PARTITION BY batch ORDER BY conv_id, turn)""")
def kto_shift(spark, sf_dir):
    a = t(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("batch", F.floor(F.col("conv_id") / 8))
    return stats.kto_shift(a, "batch", ["conv_id", "turn"], "text").select("conv_id", "turn", "rejected_response")


@query("""
    SELECT conv_id, turn, repeat('<image>', CAST(greatest(turn % 3 - (length(text) - length(replace(text, '<image>', ''))) // 7, 0) AS INTEGER)) || text AS topped FROM conversations""")
def media_tag_topup(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", text.media_top_up(F.col("text"), (F.col("turn") % 3).cast("int")).alias("topped"))


@query("""
    SELECT conv_id, turn, trim(list_extract(string_split('<think>' || role || '</think> ' || text, '</think>'), -1), ' ') AS said,
           CASE WHEN starts_with(text, '<think>') THEN text ELSE '<think></think>' || text END AS prefixed FROM conversations""")
def think_strip(spark, sf_dir):
    thought = F.concat(F.lit("<think>"), F.col("role"), F.lit("</think> "), F.col("text"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", text.without_thoughts(thought).alias("said"), text.prefixed(F.col("text"), "<think></think>").alias("prefixed"))


# --- composition -------------------------------------------------------------------

@query("""
    WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT doc_id FROM documents),
    s AS (SELECT doc_id, row_number() OVER (ORDER BY %s, doc_id) AS rn FROM d)
    SELECT doc_id, CAST(2 + (CASE WHEN rn <= n.n // 2 THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM s, n""" % u(42, "doc_id"))
def sample_repeat(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    return compose.sample(d, 2 * n + n // 2, ("doc_id",)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))


@query("""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY %s, doc_id) AS rn, count(*) OVER () AS n FROM documents)
    SELECT doc_id, rn <= greatest(CAST(floor(n * 0.1) AS BIGINT), 1) AS validation FROM r""" % u(42, "doc_id"))
def train_val_split(spark, sf_dir):
    train, val = compose.split(t(spark, sf_dir, "documents").select("doc_id"), 0.1, ("doc_id",))
    return train.withColumn("validation", F.lit(False)).unionByName(val.withColumn("validation", F.lit(True)))


@query("""
    SELECT doc_id, item_id, length(text) AS chars, lang FROM (
        SELECT doc_id, NULL::BIGINT AS item_id, text, lang FROM documents UNION ALL SELECT NULL, item_id, text, NULL FROM benchmark)""")
def concat_union(spark, sf_dir):
    both = compose.concat([t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), t(spark, sf_dir, "benchmark")])
    return both.select("doc_id", "item_id", F.length("text").alias("chars"), "lang")


@query("""
    WITH names AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS d FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
    r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, d, d % 3 + 1 AS w FROM documents JOIN names USING (source))
    SELECT doc_id, source, row_number() OVER (ORDER BY (rn - 1) // w, d, rn) AS position FROM r""")
def round_robin_sources(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source")
    names = [r[0] for r in d.where("source IS NOT NULL").select("source").distinct().orderBy("source").collect()]  # one row a source
    return compose.round_robin(d, "source", {n: i % 3 + 1 for i, n in enumerate(names)}, [F.col("doc_id")]).select("doc_id", "source", "position")


@query("""
    WITH m AS (SELECT source, median(n_chars) AS med FROM documents GROUP BY source)
    SELECT doc_id, source, CASE WHEN n_chars >= med THEN 'high' ELSE 'low' END AS bucket FROM documents JOIN m USING (source)""")
def domain_medians_bucket(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return compose.by_median(d, "source", "n_chars", "bucket").select("doc_id", "source", "bucket")


@query("""
    WITH src AS (SELECT 0 AS s, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents WHERE lang = 'en'
                 UNION ALL SELECT 1, doc_id, row_number() OVER (ORDER BY doc_id) - 1, count(*) OVER () FROM documents WHERE lang <> 'en'),
    draws AS (SELECT i AS position, CASE WHEN %s < 0.5 THEN 0 ELSE 1 END AS s FROM range((SELECT 4 * count(*) + 2000 FROM documents)) r(i)),
    turns AS (SELECT position, s, row_number() OVER (PARTITION BY s ORDER BY position) - 1 AS k FROM draws),
    sizes AS (SELECT s, max(n) AS n FROM src GROUP BY s),
    last AS (SELECT min(position) AS p FROM turns JOIN sizes USING (s) WHERE k = n)
    SELECT doc_id, CAST(s AS INTEGER) AS source, position FROM turns JOIN src USING (s, k) WHERE position < (SELECT p FROM last)""" % u(42, "i"))
def interleave_languages(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    return compose.interleave([d.where("lang = 'en'"), d.where("lang <> 'en'")], [0.5, 0.5], ["doc_id"]).select("doc_id", "source", "position")


_PHASES = {"low": (0.7, 0.2, 0.1), "mid": (0.2, 0.6, 0.2), "high": (0.1, 0.2, 0.7)}


@query("""
    WITH b AS (SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'low' WHEN n_chars < 4000 THEN 'mid' ELSE 'high' END AS bucket, %s AS u, %s AS v FROM documents),
    p AS (SELECT *, CASE bucket %s END AS phase FROM b)
    SELECT doc_id, bucket, CAST(phase AS INTEGER) AS phase, row_number() OVER (ORDER BY phase, v, doc_id) AS position FROM p""" % (
    u(42, "doc_id"), u(43, "doc_id"), " ".join(f"WHEN '{k}' THEN CASE WHEN u < {w[0] / sum(w)!r}::DOUBLE THEN 0 WHEN u < {sum(w[:2]) / sum(w)!r}::DOUBLE THEN 1 ELSE 2 END" for k, w in _PHASES.items())))
def curriculum_order(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 1000, "low").when(F.col("n_chars") < 4000, "mid").otherwise("high").alias("bucket"))
    return compose.curriculum(d, "bucket", ("doc_id",))


@query()
def bin_pack(spark, sf_dir):
    return compose.pack(t(spark, sf_dir, "documents"), "doc_id", "n_chars", 8192)


# --- item statistics and selection -------------------------------------------------

def _items(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_discount").cast("double").alias("reward"))
    return stats.item_stats(li, "item", "reward")


_STATS = """s AS (SELECT l_orderkey AS item, count(*) AS num_samples, avg(l_discount::DOUBLE) AS reward_mean, stddev_pop(l_discount::DOUBLE) AS reward_std,
                  min(l_discount::DOUBLE) AS reward_min, max(l_discount::DOUBLE) AS reward_max FROM lineitem GROUP BY l_orderkey)"""
_VALUE = _STATS + """,
    g AS (SELECT avg(reward_mean) AS m, stddev_pop(reward_mean) AS sm, stddev_pop(reward_std) AS ss FROM s),
    v AS (SELECT s.*, exp(-((reward_mean - m) ** 2) / (2 * sm ** 2 + 1e-6)) AS s_mid, 1 - exp(-reward_std / (ss + 1e-6)) AS s_var FROM s, g),
    p AS (SELECT *, s_mid * s_var AS value, s_mid * s_var / sum(s_mid * s_var) OVER () AS probability FROM v)"""


@query(f"WITH {_STATS} SELECT item, num_samples, round(reward_mean, 6) AS reward_mean, round(reward_std, 6) AS reward_std, round(reward_min, 6) AS reward_min, round(reward_max, 6) AS reward_max FROM s")
def item_stats(spark, sf_dir):
    return rounded(_items(spark, sf_dir))


@query(f"WITH {_VALUE} SELECT item, round(s_mid, 6) AS s_mid, round(s_var, 6) AS s_var, round(value, 6) AS value, round(probability, 9) AS probability FROM p")
def value_probability(spark, sf_dir):
    v = stats.value_probability(_items(spark, sf_dir))
    return v.select("item", r6("s_mid").alias("s_mid"), r6("s_var").alias("s_var"), r6("value").alias("value"), F.round("probability", 9).alias("probability"))


@query(f"""WITH {_VALUE}, k AS (SELECT item, ln(greatest(probability, 1e-12)) - ln(-ln({u(42, "item")})) AS g FROM p)
    SELECT item, round(g, 6) AS gumbel FROM k ORDER BY g DESC, item LIMIT 100""")
def select_gumbel(spark, sf_dir):
    v = stats.value_probability(_items(spark, sf_dir))
    return stats.gumbel_topk(v, "probability", 100, ("item",)).select("item", r6("gumbel").alias("gumbel"))


@query(f"WITH {_VALUE} SELECT item FROM p ORDER BY round(value, 9) DESC, item DESC LIMIT 100")
def select_topk(spark, sf_dir):
    v = stats.value_probability(_items(spark, sf_dir))
    return compose.largest(v, F.round("value", 9), [-F.col("item")], 100).select("item")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3""")
def group_topk(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    top = stats.group_topk(li, "l_suppkey", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_STATS} SELECT item, round((reward_std + 1e-6) / sum(reward_std + 1e-6) OVER (PARTITION BY item % 10), 8) AS probability FROM s")
def group_probability(spark, sf_dir):
    s = _items(spark, sf_dir).withColumn("grp", F.col("item") % 10)
    return stats.group_probability(s, "grp", "reward_std").select("item", F.round("probability", 8).alias("probability"))


_RANKS = _STATS + """, r AS (SELECT *, (row_number() OVER (ORDER BY round(reward_mean, 9), item) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE AS pm,
    (row_number() OVER (ORDER BY round(reward_std, 9), item) - 1) / greatest(count(*) OVER () - 1, 1)::DOUBLE AS ps FROM s)"""


@query(f"WITH {_RANKS} SELECT item, round(pm, 9) AS p_mean, round(ps, 9) AS p_std FROM r")
def percentile_ranks(spark, sf_dir):
    s = _items(spark, sf_dir).withColumn("m", F.round("reward_mean", 9)).withColumn("d", F.round("reward_std", 9))
    s = stats.ordinal_percentile(stats.ordinal_percentile(s, "m", ["item"], "p_mean"), "d", ["item"], "p_std")
    return s.select("item", F.round("p_mean", 9).alias("p_mean"), F.round("p_std", 9).alias("p_std"))


@query(f"WITH {_RANKS} SELECT item, round(CASE WHEN reward_max < 0.02 THEN 0 ELSE sqrt(pm) * ps END, 6) AS score FROM r")
def postprocess_score(spark, sf_dir):
    s = _items(spark, sf_dir).withColumn("m", F.round("reward_mean", 9)).withColumn("d", F.round("reward_std", 9))
    return stats.postprocess_score(s, ["item"], {"m": 0.5, "d": 1.0}, {"reward_max": 0.02}).select("item", r6("score").alias("score"))


@query("""
    WITH runs AS (SELECT DISTINCT l_shipmode AS run, l_partkey AS item FROM (SELECT CAST(l_linenumber AS VARCHAR) AS l_shipmode, l_partkey FROM lineitem)),
    s AS (SELECT run, count(*) AS n FROM runs GROUP BY run)
    SELECT a.run AS run_a, b.run AS run_b, a.n AS n_a, b.n AS n_b, coalesce(x.shared, 0) AS shared, round(coalesce(x.shared, 0) / (a.n + b.n - coalesce(x.shared, 0)), 6) AS jaccard
    FROM s a JOIN s b ON a.run < b.run LEFT JOIN (SELECT p.run AS ra, q.run AS rb, count(*) AS shared FROM runs p JOIN runs q ON p.item = q.item AND p.run < q.run GROUP BY 1, 2) x ON x.ra = a.run AND x.rb = b.run""")
def selection_overlap(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("run"), F.col("l_partkey").alias("item"))
    return rounded(stats.overlap(li, "run", "item"))


@query("""
    WITH o AS (SELECT round(o_totalprice::DOUBLE, 0) AS score, o_orderkey % 3 = 0 AS sel FROM orders),
    b AS (SELECT score, sum(sel::INT) AS pos, sum((NOT sel)::INT) AS neg FROM o GROUP BY score),
    c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
    SELECT round(CAST(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS DOUBLE), 6) AS auc FROM c""")
def prob_selection_auc(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice").cast("double"), 0).alias("score"), (F.col("o_orderkey") % 3 == 0).alias("sel"))
    return rounded(stats.selection_auc(o, "score", "sel"))


@query("""
    WITH r AS (SELECT o_totalprice::DOUBLE AS v, row_number() OVER (ORDER BY o_totalprice::DOUBLE, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
    SELECT CAST((rn * 10 - 1) // n AS BIGINT) AS bucket, count(*) AS n, round(avg(v), 4) AS mean FROM r GROUP BY 1""")
def equal_count_buckets(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("v"), "o_orderkey")
    return compose.buckets(o, "v", ["o_orderkey"], 10).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("""
    WITH g AS (SELECT min(o_totalprice::DOUBLE) AS lo, max(o_totalprice::DOUBLE) AS hi FROM orders)
    SELECT CAST(least(floor((o_totalprice::DOUBLE - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM orders, g GROUP BY 1""")
def value_histogram(spark, sf_dir):
    return stats.histogram(t(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("v")), "v", 20)


@query("""
    SELECT CASE WHEN event_type = 'view' THEN 'generation_error' WHEN value IS NULL THEN 'judge_error' WHEN value < 10 THEN 'low' ELSE 'ok' END AS issue,
           count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def issue_counts(spark, sf_dir):
    issue = F.when(F.col("event_type") == "view", "generation_error").when(F.col("value").isNull(), "judge_error").when(F.col("value") < 10, "low").otherwise("ok")
    return t(spark, sf_dir, "events").groupBy(issue.alias("issue")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


# --- rewards to advantages ---------------------------------------------------------

def _adv(name: str, expr: str, **kw) -> None:
    # The small number keeps exact halves from being rounded either way by the last bit of a sum.
    def run(spark, sf_dir):
        e = t(spark, sf_dir, "events").select("event_id", "user_id", "value")
        return stats.advantages(e, "user_id", "value", **kw).select("event_id", F.round(F.col("advantage") + 1e-9, 6).alias("advantage"))

    run.__name__ = name
    query(f"""
        WITH e AS (SELECT event_id, user_id, coalesce(value, 0.0) AS r FROM events),
        w AS (SELECT *, avg(r) OVER (PARTITION BY user_id) AS m, coalesce(stddev_samp(r) OVER (PARTITION BY user_id), 0.0) AS sd, count(*) OVER (PARTITION BY user_id) AS n,
              coalesce(stddev_samp(r) OVER (), 0.0) AS bsd FROM e)
        SELECT event_id, round({expr} + 1e-9, 6) AS advantage FROM w""")(run)


_adv("advantage_grpo", "(r - m) / (sd + 1e-4)")
_adv("advantage_batch", "(r - m) / (bsd + 1e-4)", scale="batch")
_adv("advantage_unscaled", "r - m", scale="none")
_adv("advantage_rloo", "CASE WHEN n > 1 THEN (r - m) * n / (n - 1) ELSE 0.0 END", estimator="rloo", scale="none")
_adv("advantage_rpp", "(r - m) / (coalesce(stddev_samp(r - m) OVER (), 0.0) + 1e-4)", estimator="reinforce_plus_plus", scale="batch")
_adv("advantage_rpp_group", "(r - m) / (coalesce(stddev_samp(r - m) OVER (PARTITION BY user_id), 0.0) + 1e-4)", estimator="reinforce_plus_plus")
_adv("advantage_rpp_unscaled", "r - m", estimator="reinforce_plus_plus", scale="none")
_adv("advantage_rloo_group", "CASE WHEN n > 1 THEN (r - m) * n / (n - 1) ELSE 0.0 END / (sd + 1e-4)", estimator="rloo")


@query("""
    SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING stddev_samp(value) > 0)""")
def zero_std_groups(spark, sf_dir):
    return stats.varied_groups(t(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", "user_id")


@query("""
    WITH w AS (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)
    SELECT event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo + 1e-5) ELSE greatest(0.0, least(1.0, value)) END, 6) AS scaled FROM w""")
def minmax_normalise(spark, sf_dir):
    return rounded(stats.minmax(t(spark, sf_dir, "events"), "value", "user_id").select("event_id", "scaled"))


@query("""
    SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def dedup_last_request(spark, sf_dir):
    return stats.dedup(t(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


@query("""
    SELECT event_id, greatest(1, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM events""")
def marker_sessions(spark, sf_dir):
    e = stats.marker_sessions(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup")
    return e.select("event_id", F.col("session").cast("long").alias("session"))


_LOGP = "SELECT l_orderkey AS s, -(l_quantity::DOUBLE / 50) AS o, -(l_quantity::DOUBLE / 50) + (l_discount::DOUBLE - 0.05) AS n FROM lineitem"


def _logp(spark, sf_dir) -> DataFrame:
    old = -(F.col("l_quantity").cast("double") / 50)
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("ln"), old.alias("o"), (old + (F.col("l_discount").cast("double") - 0.05)).alias("n"))


@query(f"""
    WITH t AS (SELECT *, greatest(least(n - o, 20), -20) AS r FROM ({_LOGP})),
    q AS (SELECT s, avg(r) AS mr, avg(o) AS mo, avg(n) AS mn, sum(exp(r) - 1 - r) AS k3, sum(-r) AS kl, sum(exp(2 * r) - 1) AS chi, count(*) AS c FROM t GROUP BY s)
    SELECT round(sum(kl) / sum(c), 6) AS kl, round(sum(k3) / sum(c), 6) AS k3_kl, round(sum(chi) / sum(c), 6) AS chi2_token, round(avg(exp(2 * mr) - 1), 6) AS chi2_seq,
           round(avg(exp(-mn)), 6) AS training_ppl, round(avg(exp(-mo)), 6) AS rollout_ppl, round(avg(mo - mn), 6) AS log_ppl_diff, round(avg(abs(mo - mn)), 6) AS log_ppl_abs_diff, round(avg(exp(mo - mn)), 6) AS ppl_ratio
    FROM q""")
def offpolicy_kl_k3(spark, sf_dir):
    every = metrics.off_policy(_logp(spark, sf_dir), "s", "o", "n")
    return rounded(every.drop("training_log_ppl", "rollout_log_ppl", "log_ppl_diff_max", "log_ppl_diff_min"))


@query("""
    WITH t AS (SELECT l_orderkey AS s, l_linenumber AS ln, (l_discount::DOUBLE - 0.05) * 20 AS r FROM lineitem),
    w AS (SELECT s, ln, least(exp(r), 2.0) AS truncated, exp(avg(r) OVER (PARTITION BY s)) AS q FROM t)
    SELECT s, ln, round(truncated, 6) AS token_truncated, round(CASE WHEN q <= 2.0 THEN q ELSE 0.0 END, 6) AS sequence_masked FROM w""")
def importance_weights(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("ln"), ((F.col("l_discount").cast("double") - 0.05) * 20).alias("r"))
    a = stats.importance_weights(li, "s", "r").withColumnRenamed("weight", "token_truncated")
    return rounded(stats.importance_weights(a, "s", "r", "sequence", "mask").withColumnRenamed("weight", "sequence_masked").drop("r"))


# --- text rewards and extractors ---------------------------------------------------

@query("""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(lower(text), ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, len(w) - 2 AS total, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM w)
    SELECT doc_id, round(CASE WHEN total > 0 THEN (1 - len(list_distinct(g)) / total) * -1.0 ELSE 0.0 END, 6) AS penalty FROM g""")
def repetition_penalty(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", r6(rewards.repetition(F.col("text"))).alias("penalty"))


@query("SELECT doc_id, round(least(-(n_chars - 3000) / 1000.0, 0.0), 6) AS reward FROM documents")
def soft_overlong(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", r6(rewards.soft_overlong(F.col("n_chars"), 4000, 1000)).alias("reward"))


@query("""
    SELECT doc_id, round(CASE WHEN quality = 1 THEN 0.5 + 0.25 * (1 + cos(n_chars * pi() / 20000)) ELSE 0.0 - 0.25 * (1 + cos(n_chars * pi() / 20000)) END, 6) AS reward
    FROM documents JOIN labels USING (doc_id)""")
def cosine_len(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", r6(rewards.cosine_length(F.col("quality") == 1, F.col("n_chars"), 20000)).alias("reward"))


def _tagged(d: DataFrame) -> DataFrame:
    """Texts in the shape of model outputs, made from ids."""
    i = F.col("doc_id")
    place = F.concat(F.lit("City"), i.cast("string"), F.when(i % 3 == 0, "; Region; Land").when(i % 3 == 1, "; Unknown; Land").otherwise("; Land"))
    answer = F.concat(F.lit('{"FinalAnswer": "'), place, F.lit('"}'))
    return d.select("doc_id", "lang", F.concat(F.lit("<think>"), F.col("lang"), F.lit("</think> <answer>"), answer, F.when(i % 5 == 0, "</answer> tail").otherwise("</answer>")).alias("out"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 1.0 END AS format, CASE WHEN doc_id % 3 = 2 THEN 0.0 ELSE 1.0 END AS geo_format, CASE WHEN doc_id % 3 = 1 THEN 0.0 ELSE 1.0 END AS no_unknown FROM documents")
def answer_format(spark, sf_dir):
    o = F.col("out")
    return _tagged(t(spark, sf_dir, "documents")).select("doc_id", rewards.format_ok(o).alias("format"), rewards.geo_format(o).alias("geo_format"), rewards.geo_no_unknown(o).alias("no_unknown"))


@query("""
    WITH x AS (SELECT doc_id, (doc_id % 170) - 85 + 0.5 AS la, (doc_id % 350) - 175 + 0.25 AS lo FROM documents)
    SELECT doc_id, round(CAST(la AS DOUBLE), 6) AS lat, round(CAST(lo AS DOUBLE), 6) AS lon FROM x""")
def extract_latlon(spark, sf_dir):
    i = F.col("doc_id")
    la, lo = (i % 170 - 85 + 0.5).cast("string"), (i % 350 - 175 + 0.25).cast("string")
    said = F.when(i % 2 == 0, F.concat(F.lit('{"latitude": '), la, F.lit(', "longitude": '), lo, F.lit("}"))).otherwise(F.concat(F.lit("near ("), la, F.lit(", "), lo, F.lit(")")))
    return t(spark, sf_dir, "documents").select("doc_id", text.latlon(said).alias("p")).select("doc_id", r6("p.lat").alias("lat"), r6("p.lon").alias("lon"))


@query("""
    SELECT doc_id, 'search' AS name, '{"q":"' || lang || '"}' AS arguments FROM documents""")
def toolcall_hermes(spark, sf_dir):
    said = F.concat(F.lit('ok <tool_call>{"name": "search", "arguments": {"q": "'), F.col("lang"), F.lit('"}}</tool_call>'))
    d = t(spark, sf_dir, "documents").select("doc_id", toolcall.PARSERS["hermes"](said).alias("c"))
    return d.select("doc_id", F.inline("c"))


@query("""SELECT doc_id, 'find ' || source AS name, lang AS arguments FROM documents""")
def toolcall_react(spark, sf_dir):
    said = F.concat(F.lit("Thought: x\nAction: find "), F.col("source"), F.lit("\nAction Input: "), F.col("lang"), F.lit("\nObservation: none"))
    d = t(spark, sf_dir, "documents").select("doc_id", toolcall.PARSERS["hermes"](said).alias("c"))
    return d.select("doc_id", F.inline("c"))


# --- geography ---------------------------------------------------------------------

def _points(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey").cast("double")
    c = t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), "c_nationkey", (k % 160 - 80).alias("lat1"), (k % 340 - 170).alias("lon1"),
        (k % 160 - 80 + (k % 7) * (k % 7) * 0.2).alias("lat2"), (k % 340 - 170 + (k % 11) * 0.01).alias("lon2"), (F.col("c_custkey") % 9 - 1).cast("int").alias("s"))
    c = c.withColumn("status", F.when(F.col("s") == -1, -1).when(F.col("s") == 0, 0).otherwise(1))
    return c.withColumn("distance", geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))


_POINTS = """p AS (SELECT c_custkey AS id, c_nationkey, c_custkey::DOUBLE AS k, CASE WHEN c_custkey % 9 = 0 THEN -1 WHEN c_custkey % 9 = 1 THEN 0 ELSE 1 END AS status FROM customer),
    q AS (SELECT *, k % 160 - 80 AS lat1, k % 340 - 170 AS lon1, k % 160 - 80 + (k % 7) * (k % 7) * 0.2 AS lat2, k % 340 - 170 + (k % 11) * 0.01 AS lon2 FROM p),
    d AS (SELECT *, 2 * 6371.0 * asin(least(1.0, sqrt(sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2))) AS distance FROM q)"""


@query(f"WITH {_POINTS} SELECT id, round(distance, 6) AS distance, round(CASE WHEN distance >= 2000 THEN 0.0 ELSE exp(-10 * distance / 2000) END, 6) AS reward, round(5000 * exp(-10 * distance / 18050), 4) AS score FROM d")
def haversine_geoscore(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("id", r6("distance").alias("distance"), r6(geo.reward_geoscore(F.col("distance"))).alias("reward"), F.round(geo.report_geoscore(F.col("distance")), 4).alias("score"))


_ACC = ", ".join(f"round(count(*) FILTER (dd <= {k}) / count(*), 6) AS acc_{k}km" for k in geo.THRESHOLDS_KM)


@query(f"""
    WITH {_POINTS}, e AS (SELECT d.*, n.n_name AS nation, r.r_name AS continent, CASE WHEN status = 1 THEN distance END AS dd FROM d JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey),
    f AS (SELECT *, coalesce(5000 * exp(-10 * dd / 18050), 0.0) AS sc FROM e)
    SELECT CASE WHEN GROUPING(continent) = 0 THEN 'continent' WHEN GROUPING(nation) = 0 THEN 'nation' ELSE 'overall' END AS group_kind,
           CASE WHEN GROUPING(continent) = 0 THEN continent WHEN GROUPING(nation) = 0 THEN nation ELSE 'all' END AS group_key,
           count(*) AS rows, count(*) FILTER (status = 1) AS ok, count(*) FILTER (status = 0) AS unparsed, count(*) FILTER (status = -1) AS failed, {_ACC},
           round(avg(dd), 4) AS distance_mean, round(median(dd), 4) AS distance_median, round(avg(sc), 4) AS geoscore_mean, round(median(sc), 4) AS geoscore_median
    FROM f GROUP BY GROUPING SETS ((), (nation), (continent))""")
def geo_eval_report(spark, sf_dir):
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("continent"))
    rep = metrics.geo_report(_points(spark, sf_dir).join(n, F.col("c_nationkey") == F.col("n_nationkey")), ("nation", "continent"))
    return rep.select(*[F.round(c, 6 if c.startswith("acc") else 4).alias(c) if k == "double" else F.col(c) for c, k in rep.dtypes])


@query("""
    WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE r_name END AS hit, c_custkey % 2 AS pos
               FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT id, lower(hit) AS matched, CAST(pos AS BIGINT) AS pos FROM a""")
def geocode_cascade(spark, sf_dir):
    """"Region; Nation; Street" falls back to shorter prefixes until the cache has one."""
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    # Even ids ask for "NATION; x1" (known at once by its second prefix), odd ones for "REGION; x; y".
    asked = F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.col("r_name"), F.lit("; nowhere")))
    cache = n.select(text.geocode_key(F.col("n_name")).alias("key")).union(n.select(text.geocode_key(F.col("r_name")))).distinct()
    tried = c.select(F.col("c_custkey").alias("id"), F.posexplode(text.geocode_candidates(asked)).alias("pos", "candidate"))
    hit = tried.withColumn("key", text.geocode_key(F.col("candidate"))).join(cache, "key")
    return hit.groupBy("id").agg(F.min_by("key", "pos").alias("matched"), F.min("pos").cast("long").alias("pos"))


# --- joins, metrics ----------------------------------------------------------------

@query("""
    WITH m AS (SELECT * FROM (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem) WHERE rn = 1)
    SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END, p) AS part FROM orders LEFT JOIN m ON o_orderkey = m.k""")
def metadata_patch_first_wins(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).alias("part"))
    m = in_file_order(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_partkey").alias("part"), "place")
    return stats.fill_first_wins(o, m, "k", [F.col("l_linenumber"), F.col("place")], ["part"])


@query("""
    WITH m AS (SELECT * FROM (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1)
    SELECT o_orderkey AS k, p AS part FROM orders LEFT JOIN m ON o_orderkey = m.k""")
def annotations_last_wins(spark, sf_dir):
    m = in_file_order(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_partkey").alias("part"), "place")
    m = stats.dedup(m, "k", [F.desc("l_linenumber"), F.col("place")])
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(m.select("k", "part"), "k", "left")


@query("""
    SELECT round(avg((quality = 1 - toxic)::INT), 6) AS accuracy, count(*) AS n FROM labels""")
def exact_match_acc(spark, sf_dir):
    m = states.accuracy("quality", "clean")
    found = states.compute(m, states.update(m, t(spark, sf_dir, "labels").withColumn("clean", 1 - F.col("toxic"))))
    return found.select(r6("acc").alias("accuracy"), "n")


@query("SELECT round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS min, max(n_chars) AS max, count(n_chars) AS size FROM documents")
def length_stats(spark, sf_dir):
    return rounded(metrics.length_stats(t(spark, sf_dir, "documents"), "n_chars"))


@query("""
    WITH e AS (SELECT vec_id, vec_id // 100 AS part, (label % 2 = 0)::INT AS lab, round(CAST(embedding[1] AS DOUBLE), 6) AS score FROM embeddings),
    g AS (SELECT *, sum(lab) OVER (PARTITION BY part ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS grp FROM e),
    h AS (SELECT *, count(*) OVER (PARTITION BY part, grp) AS n FROM g WHERE grp > 0),
    i AS (SELECT *, row_number() OVER (PARTITION BY part, grp ORDER BY score DESC, vec_id) AS pos, row_number() OVER (PARTITION BY part, grp ORDER BY lab DESC, vec_id) AS ideal FROM h WHERE n >= 2),
    p AS (SELECT part, grp, max(CASE WHEN lab = 1 THEN 1.0 / pos ELSE 0 END) AS rr, sum((2 ** lab - 1) / log2(pos + 1)) / sum((2 ** lab - 1) / log2(ideal + 1)) AS ndcg FROM i GROUP BY part, grp)
    SELECT count(*) AS lists, round(avg(CAST(rr AS DOUBLE)), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM p""")
def reranker_mrr_ndcg(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 100).alias("part"), (F.col("label") % 2 == 0).cast("int").alias("lab"), r6(F.get("embedding", F.lit(0)).cast("double")).alias("score"))
    return rounded(metrics.ranking(e, "vec_id", "lab", "score"))


@query("""
    WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id WHERE a.vec_id % 2 = 0)
    SELECT vec_id, round(list_cosine_similarity(x, y), 5) AS cosine, round(list_dot_product(x, y), 5) AS dot, round(-list_distance(x, y), 5) AS neg_l2,
           round(-list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))), 4) AS neg_l1 FROM p""")
def paired_similarities(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    pairs = e.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("x")).join(e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    s = metrics.similarities(pairs, "x", "y")
    return s.select("vec_id", *[F.round(c, 4 if c == "neg_l1" else 5).alias(c) for c in ("cosine", "dot", "neg_l2", "neg_l1")])


@query("""
    WITH g AS (SELECT count(*) FILTER (toxic = 0) AS desirable, count(*) FILTER (toxic <> 0) AS undesirable FROM labels),
    h AS (SELECT *, greatest(desirable, 1) AS d, greatest(undesirable, 1) AS u FROM g)
    SELECT desirable, undesirable, round(u / d, 6) AS desirable_low, round(u * 1.33::DOUBLE / d, 6) AS desirable_high, round(d / (u * 1.33::DOUBLE), 6) AS undesirable_low, round(d / u, 6) AS undesirable_high FROM h""")
def kto_class_balance(spark, sf_dir):
    return rounded(metrics.kto_bounds(t(spark, sf_dir, "labels").select((F.col("toxic") == 0).alias("good")), "good"))


def _graded(spark, sf_dir) -> DataFrame:
    """Every document as a hypothesis for one of the benchmark's items."""
    b = t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref"))
    n = b.agg(F.max("item_id") + 1).first()[0]
    return t(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("item_id")).join(b, "item_id")


@query()
def rouge_lite(spark, sf_dir):
    return metrics.rouge_bleu_rows(_graded(spark, sf_dir), "doc_id", "text", "ref")


def _rouge_sql(n: int) -> str:
    words = lambda c: f"list_filter(regexp_split_to_array(trim({c}, ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
    shifted = lambda w: ", ".join(f"{w}[{k + 1}:len({w}) - {n - 1 - k}]" for k in range(n))
    grams = lambda w: w if n == 1 else f"[{' || chr(32) || '.join(f'x[{k + 1}]' for k in range(n))} FOR x IN list_zip({shifted(w)})]"
    return f"""
        WITH p AS MATERIALIZED (SELECT doc_id, {words("d.text")} AS h, {words("b.text")} AS r FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id),
        g AS (SELECT doc_id, unnest({grams("h")}) AS g, 1 AS a, 0 AS b FROM p UNION ALL SELECT doc_id, unnest({grams("r")}), 0, 1 FROM p),
        c AS (SELECT doc_id, g, sum(a) AS a, sum(b) AS b FROM g GROUP BY 1, 2),
        s AS (SELECT doc_id, sum(least(a, b)) AS hits, sum(a) AS a, sum(b) AS b FROM c GROUP BY 1)
        SELECT doc_id, round(CASE WHEN a > 0 AND b > 0 THEN 200.0::DOUBLE * hits / (a + b) ELSE 0 END, 6) AS rouge_{n} FROM p LEFT JOIN s USING (doc_id)"""


def _rouge(n: int) -> None:
    def run(spark, sf_dir):
        pairs = _graded(spark, sf_dir)
        return rounded(metrics.rouge_n(pairs, "doc_id", rewards.words(F.col("text")), rewards.words(F.col("ref")), n))

    run.__name__ = f"rouge_{n}"
    query(_rouge_sql(n))(run)


_rouge(1)
_rouge(2)


@query("""
    WITH p AS (SELECT vec_id, vec_id // 20 AS batch, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS s FROM p a JOIN p b USING (batch))
    SELECT round(avg(s) FILTER (i = j), 5) AS mean_pos, round(avg(s) FILTER (i <> j), 5) AS mean_neg, round(avg(s) FILTER (i = j) - avg(s) FILTER (i <> j), 5) AS margin FROM s""")
def infonce_margin(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 20))
    m = metrics.infonce(e, "batch", "vec_id", "embedding", "embedding")
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


@query("""
    WITH w AS (SELECT exp((l_discount::DOUBLE - 0.05) * 20) AS w FROM lineitem), c AS (SELECT w, least(greatest(w, 0.5), 2.0) AS k FROM w)
    SELECT round(avg(w), 6) AS is_weight_mean, round(1 / greatest(avg(k * k) / (avg(k) + 1e-8) ** 2, 1e-10), 6) AS ess FROM c""")
def importance_ess(spark, sf_dir):
    w = t(spark, sf_dir, "lineitem").select(F.exp((F.col("l_discount").cast("double") - 0.05) * 20).alias("w"))
    return rounded(metrics.effective_sample_size(w, "w"))


@query(f"""
    WITH t AS (SELECT s, o, n, s % 3 - 1 AS adv FROM ({_LOGP})), g AS (SELECT s, avg(o - n) AS off, max(adv) AS a FROM t GROUP BY s)
    SELECT s FROM g WHERE NOT (round(off, 9) > 0.01 AND a < 0)""")
def offpolicy_sequence_mask(spark, sf_dir):
    rows = _logp(spark, sf_dir).withColumn("adv", F.col("s") % 3 - 1)
    g = metrics.sequence_mask(rows.withColumn("o", F.round("o", 9)).withColumn("n", F.round("n", 9)), "s", "o", "n", "adv", 0.01 + 1e-10)
    return g.select("s")


@query("""
    WITH g AS (SELECT user_id, coalesce(stddev_samp(value), 0) AS s FROM events GROUP BY user_id)
    SELECT round((SELECT avg(value) FROM events), 6) AS reward, round((SELECT stddev_samp(value) FROM events), 6) AS reward_std, round(avg((s = 0)::INT), 6) AS frac_zero_std FROM g""")
def reward_metrics(spark, sf_dir):
    return rounded(metrics.reward_metrics(t(spark, sf_dir, "events"), "user_id", "value"))


@query(f"""
    WITH {_POINTS}, r AS (SELECT distance, row_number() OVER (ORDER BY distance) AS rn, count(*) OVER () AS n FROM d)
    SELECT count(*) AS n, round(avg(distance), 4) AS mean, round(median(distance), 4) AS median, round(max(CASE WHEN rn = least(n - 1, greatest(0, CAST(floor(0.9 * n) AS BIGINT) - 1)) + 1 THEN distance END), 4) AS p90 FROM r""")
def distance_summary(spark, sf_dir):
    s = metrics.distance_summary(_points(spark, sf_dir), "distance")
    return s.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p90")])


@query("""
    SELECT l_orderkey AS item_id, CAST(i AS BIGINT) AS sample_index FROM (SELECT DISTINCT l_orderkey FROM lineitem) CROSS JOIN range(4) r(i)""")
def expand_samples(spark, sf_dir):
    items = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id")).distinct()
    return runs.expand_samples(items, 4).select("item_id", F.col("sample_index").cast("long").alias("sample_index"))


@query("""
    WITH g AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS item_id FROM orders LEFT JOIN g ON o_orderkey = k WHERE NOT coalesce(n = 3 AND d = 3 AND lo = 0 AND hi = 2, false)""")
def incomplete_generations(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("int").alias("sample_index"))
    return runs.incomplete(s, t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")), 3)


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system'),
    p AS (SELECT conv_id, i // 2 AS k, max(CASE WHEN i % 2 = 0 THEN text END) AS q, max(CASE WHEN i % 2 = 1 THEN text END) AS a FROM r GROUP BY 1, 2),
    x AS (SELECT *, max(k) OVER (PARTITION BY conv_id) AS last FROM p)
    SELECT c.conv_id, coalesce(max(last), 0) AS n_history, max(CASE WHEN k = last THEN q END) AS query, max(CASE WHEN k = last THEN a END) AS response
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN x ON c.conv_id = x.conv_id GROUP BY c.conv_id""")
def messages_to_history(spark, sf_dir):
    h, q, a = normalize.messages_to_history(F.col("messages"))
    return conversations(spark, sf_dir).select("conv_id", F.size(h).cast("long").alias("n_history"), q.alias("query"), a.alias("response"))


@query("""
    SELECT doc_id, n_chars, CAST(n_words AS BIGINT) AS n_words FROM (
        SELECT doc_id, n_chars, len(list_filter(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n_words FROM documents) WHERE n_words <= 512""")
def length_filter(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars", F.array(normalize.message("assistant", F.col("text"))).alias("messages"))
    return encode.add_length(d, max_length=512).select("doc_id", "n_chars", F.get("lengths", F.lit(0)).cast("long").alias("n_words"))


@query("""
    WITH b AS (SELECT doc_id, CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 3000 THEN 1 WHEN n_chars < 8000 THEN 2 ELSE 3 END AS stage FROM documents)
    SELECT doc_id, stage, row_number() OVER (ORDER BY stage, %s, doc_id) AS position FROM b""" % u(42, "doc_id"))
def four_stage_order(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return compose.staged(d, [1000, 3000, 8000], "n_chars", ("doc_id",)).drop("n_chars")
