"""More registered queries: extractors and rewards over varied outputs, runs, encodings, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import geo, rewards, spans, text, toolcall
from quillmark.operators import chat, compose, encode, metrics, normalize, runs, stats
from quillmark.plans.catalogue import in_file_order, query, r6, rounded, t, u
from quillmark.scratch import shared_dir
from quillmark.sources import spec

# --- outputs in varied shapes, made from ids ----------------------------------------

def ident() -> Column:
    return F.col("doc_id")


def shaped(spark, sf_dir, shapes: list[Column]) -> DataFrame:
    """``doc_id, lang, out``: documents in turn get each shape."""
    out = F.lit(None).cast("string")
    for k, s in enumerate(shapes):
        out = F.when(ident() % len(shapes) == k, s).otherwise(out)
    return t(spark, sf_dir, "documents").select("doc_id", "lang", out.alias("out"))


def cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def by_shape(n: int, values: list[str]) -> str:
    return f"CASE doc_id % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@query(f"""SELECT doc_id, {by_shape(8, ["'City' || doc_id || '; R; L'", "'City' || doc_id || '; R; L'", "'City' || doc_id", "'City' || doc_id", "NULL", "'quoted ' || doc_id", "'{{\"FinalAnswer\": ' || doc_id || '} tail'", "NULL"]).replace("{{", "{")} AS answer FROM documents""")
def answer_texts(spark, sf_dir):
    place = cat("City", ident())
    shapes = [
        cat('<think>t</think><answer>{"FinalAnswer": "', place, '; R; L"}</answer>'), cat("<ANSWER> ", place, "; R; L </ANSWER> <answer>b</answer>"), cat('so ```json\n{"FinalAnswer": " ', place, ' "}\n```'),
        cat("FinalAnswer: ", place, ", more"), cat("<b>no ", place, "</b>"), cat(' "quoted ', ident(), '" '), cat('{"FinalAnswer": ', ident(), "} tail"), F.lit("<answer> </answer>"),
    ]
    return shaped(spark, sf_dir, shapes).select("doc_id", text.answer_text(F.col("out")).alias("answer"))


@query("""
    WITH x AS (SELECT doc_id, doc_id % 8 AS k, doc_id % 80 + 0.5 AS la, doc_id % 170 + 0.25 AS lo FROM documents)
    SELECT doc_id, CAST(CASE WHEN k = 1 THEN la + 95 WHEN k = 4 THEN -la WHEN k IN (6, 7) THEN NULL ELSE la END AS DOUBLE) AS lat, CAST(CASE WHEN k IN (6, 7) THEN NULL WHEN k = 4 THEN -lo ELSE lo END AS DOUBLE) AS lon FROM x""")
def latlon_forms(spark, sf_dir):
    la, lo = (ident() % 80 + F.lit(0.5)).cast("double"), (ident() % 170 + F.lit(0.25)).cast("double")
    shapes = [
        cat('<answer>{"lat": "', la, '", "lng": ', lo, "}</answer>"), cat('text {"latitude": ', la + 95, ', "longitude": ', lo, "}"), cat("lat: ", la, ", lon = ", lo), cat("near (", la, ", ", lo, ") 3 4"),
        cat("<answer>-", la, ", -", lo, "</answer>"), cat(la, " N, roughly ", lo), cat("lat 99", ident(), ", then 1"), F.lit("nothing here"),
    ]
    d = shaped(spark, sf_dir, shapes).select("doc_id", text.latlon(F.col("out")).alias("p"))
    return d.select("doc_id", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


@query("""
    SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 4 THEN 0.5 ELSE 0.0 END::DOUBLE AS reward,
           CASE WHEN doc_id % 7 IN (3, 5) THEN 'judge_json_parse_failed' WHEN doc_id % 7 = 6 THEN 'missing_parsed_answer' END AS error, doc_id % 7 IN (2, 3, 4, 5) AS truncated FROM documents""")
def llm_judge_rewards(spark, sf_dir):
    shapes = [
        cat('{"score": 0.25, "verdict": "near", "reason": "r', ident(), '"}'), cat('```json\n{"score": "7", "verdict": "v", "reason": "r"}\n``` {"score": 1.5, "verdict": "same", "reason": "r", "more": ', ident(), "}"),
        cat('{"score": 0.1, "verdict": "a", "reason": "b"} then {"score": 0.75, "verdict": "c", "reason": "d"} {"score": 0.9, "verdict": "...", "reason": "..."} done'),
        cat('{"score": 0.9, "verdict": "..., ', ident()), cat("score: 0.5, verdict: near, reason: because ", ident()), cat('{"verdict": "v", "score": ', ident(), "."), cat('{"score": 1, "verdict": "v", "reason": "r"}'),
    ]
    d = shaped(spark, sf_dir, shapes).withColumn("gt_text", F.lit("x")).withColumn("parsed_answer", F.when(ident() % 7 == 6, "").otherwise("y"))
    return runs.judge_rewards(d, "out").select("doc_id", "reward", "error", "truncated")


@query("""
    WITH k AS (SELECT doc_id, doc_id % 9 AS k FROM documents)
    SELECT doc_id, (k NOT IN (1, 2, 5))::INT::DOUBLE AS no_unknown, (k IN (0, 8))::INT::DOUBLE AS strict, (k IN (6, 7))::INT::DOUBLE AS json_strict FROM k""")
def geo_reward_forms(spark, sf_dir):
    think = cat('<think>{"Clues": ["c', ident(), '"], "Reasoning": "r"}</think>')
    final = lambda x: cat('<answer>{"FinalAnswer": "', x, '"}</answer>')
    shapes = [
        cat(think, final("a; b；c"), "<|im_end|>"), cat(think, final("unspecified; a; b")), cat("I cannot really identify the place. ", final("a; b; c")), cat("no answer ", ident()), cat(think, final("a; b")),
        cat(think, final("a; b; c"), " there is insufficient visual evidence"), cat('{"Clues": ["c"], "Reasoning": "r", "FinalAnswer": "a; b; c', ident(), '"}'),
        cat('<think>\n</think>\n{"FinalAnswer": "a; b; c", "Clues": ["c", "d"], "Reasoning": "r', ident(), '"}<|im_end|>'), cat("<THINK>", '{"Reasoning": "r', ident(), '", "Clues": ["c"]}', "</THINK>\n<Answer> ", '{"FinalAnswer": "a; b; c"}', " </Answer>"),
    ]
    o = F.col("out")
    return shaped(spark, sf_dir, shapes).select("doc_id", rewards.geo_no_unknown(o).alias("no_unknown"), rewards.geo_strict_format(o).alias("strict"), rewards.geo_json_strict_format(o).alias("json_strict"))


@query("SELECT doc_id, (doc_id % 7 IN (0, 1, 5))::INT::DOUBLE AS reward FROM documents")
def toolbench_reward(spark, sf_dir):
    truth = cat('Thought: t\nAction: find\nAction Input: {"q": "', F.col("lang"), '", "n": [1, {"a": ', ident(), "}]}")
    shapes = [
        cat("Action: find\nAction Input: ", '{"n": [1, {"a": ', ident(), '}], "q": "', F.col("lang"), '"}'), cat("Action: other\nAction Input: {}\nAction: find\nAction Input: ", '{"q": "', F.col("lang"), '", "n": [1, {"a": ', ident(), "}]}<|im_end|>"),
        cat("Action: find\nAction Input: ", '{"q": "', F.col("lang"), '"}'), cat("Action: seek\nAction Input: ", '{"q": "', F.col("lang"), '", "n": [1, {"a": ', ident(), "}]}"), cat("Action: find\nAction Input: plain ", ident()),
        cat("Action: find\nAction Input: ", '{"q": "', F.col("lang"), '", "n": [1, {"a": ', ident(), "}]}\nObservation:"), cat("nothing ", ident()),
    ]
    d = shaped(spark, sf_dir, [F.regexp_replace(s, "^", "Thought: x\n") for s in shapes])
    return d.select("doc_id", rewards.toolbench(F.col("out"), truth).alias("reward"))


@query("""
    SELECT doc_id, 'mistral' AS family, 'f' || i AS name, '{"x":{"y":{"z":' || doc_id || '}}}' AS arguments FROM documents, range(2) r(i)
    UNION ALL SELECT doc_id, 'llama3', 'g', '{"a":{"b":' || doc_id || '},"c":2}' FROM documents
    UNION ALL SELECT doc_id, 'minimax_m2', 'h', '{"n":' || doc_id || ',"l":[1,2],"s":"' || lang || '","q":"say \\"so\\""}' FROM documents
    UNION ALL SELECT doc_id, 'fallback', 'find', lang FROM documents""")
def toolcall_families(spark, sf_dir):
    lang = F.col("lang")
    react = cat("Action: find\nAction Input: ", lang)
    said = {
        "mistral": ("mistral", cat('[TOOL_CALLS][{"name": "f0", "arguments": {"x": {"y": {"z": ', ident(), '}}}}\n[{"name": "f1", "arguments": {"x": {"y": {"z": ', ident(), "}}}}]]</s>")),
        "llama3": ("llama3", cat('{"name": "g", "parameters": {"a": {"b": ', ident(), '}, "c": 2}}<|eom_id|>')),
        "minimax_m2": ("minimax_m2", cat('<minimax:tool_call>\n<invoke name="h"><parameter name="s">old</parameter><parameter name="n">', ident(), '</parameter><parameter name="l">[1,2]</parameter><parameter name="s"> ', lang, ' </parameter><parameter name="q">say "so"</parameter></invoke>\n</minimax:tool_call>')),
        "fallback": ("mistral", cat("[TOOL_CALLS][none]</s> ", react)),
    }
    d = t(spark, sf_dir, "documents")
    return compose.concat([d.select("doc_id", F.lit(k).alias("family"), F.inline(toolcall.PARSERS[p](s))) for k, (p, s) in said.items()])


# --- runs ---------------------------------------------------------------------------

_SAMPLES = """s AS (SELECT event_id, user_id AS item_id, coalesce(value, 0.0) AS reward, event_type,
        CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS parsed_answer, CASE WHEN event_id % 7 = 0 THEN 'judge_json_parse_failed' WHEN event_id % 11 = 0 THEN 'pred_geocode_failed' END AS error,
        CASE WHEN event_id % 2 = 0 THEN 'llm_judge' ELSE 'latlon' END AS reward_mode, event_id % 13 = 0 AS truncated FROM events),
    k AS (SELECT *, CASE WHEN parsed_answer = '' THEN 'generation_error' WHEN error = 'judge_json_parse_failed' OR (error IS NOT NULL AND reward_mode = 'llm_judge') THEN 'judge_error'
        WHEN error IS NOT NULL THEN 'generation_error' END AS kind FROM s),
    i AS (SELECT item_id, count(*) FILTER (kind = 'generation_error') AS generation_errors, count(*) FILTER (kind = 'judge_error') AS judge_errors FROM k GROUP BY item_id)"""


def _samples(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return t(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("item_id"), F.col("value").alias("reward"), F.when(e % 5 == 0, "").otherwise(F.col("event_type")).alias("parsed_answer"),
        F.when(e % 7 == 0, "judge_json_parse_failed").when(e % 11 == 0, "pred_geocode_failed").alias("error"), F.when(e % 2 == 0, "llm_judge").otherwise("latlon").alias("reward_mode"), (e % 13 == 0).alias("truncated"))


@query(f"WITH {_SAMPLES} SELECT item_id, generation_errors, judge_errors, generation_errors + judge_errors AS errors FROM i")
def issue_totals(spark, sf_dir):
    return runs.issue_totals(_samples(spark, sf_dir))


_ITEMS = "p AS (SELECT o_orderkey AS item_id, round(o_totalprice::DOUBLE / 1000000, 6) AS probability, o_orderkey % 3 = 0 AS selected FROM orders)"


def _items(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.round(F.col("o_totalprice").cast("double") / 1000000, 6).alias("probability"), (F.col("o_orderkey") % 3 == 0).alias("selected"))


@query(f"""
    WITH {_SAMPLES}, {_ITEMS}
    SELECT a.*, b.*, c.* FROM
    (SELECT count(*) AS num_samples, round(avg(reward), 6) AS reward_mean, round(min(reward), 6) AS reward_min, round(max(reward), 6) AS reward_max, round(avg((parsed_answer <> '')::INT), 6) AS parsed_rate,
            round(avg(truncated::INT), 6) AS truncated_rate, round(avg((error IS NOT NULL)::INT), 6) AS error_rate FROM s) a,
    (SELECT count(*) AS num_items, count(*) FILTER (selected) AS num_selected, round(avg(selected::INT), 6) AS selected_rate, round(avg(probability), 6) AS probability_mean,
            round(avg(probability) FILTER (selected), 6) AS selected_probability_mean, round(avg(probability) FILTER (NOT selected), 6) AS unselected_probability_mean FROM p) b,
    (SELECT count(*) FILTER (generation_errors > 0) AS items_with_generation_error, count(*) FILTER (judge_errors > 0) AS items_with_judge_error FROM i) c""")
def run_statistics(spark, sf_dir):
    return rounded(runs.run_statistics(_samples(spark, sf_dir), _items(spark, sf_dir)))


@query(f"""
    WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (ORDER BY probability, item_id) AS rn, count(*) OVER () AS m FROM p)
    SELECT CAST((rn * 10 - 1) // m + 1 AS BIGINT) AS bin, count(*) AS n, round(min(probability), 6) AS p_min, round(max(probability), 6) AS p_max, round(avg(probability), 6) AS p_mean, round(avg(selected::INT), 6) AS select_rate FROM r GROUP BY 1""")
def selection_bins(spark, sf_dir):
    return rounded(runs.selection_bins(_items(spark, sf_dir), "probability", "selected", ["item_id"]))


@query(f"""
    WITH {_SAMPLES}, c AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 402 END AS code, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END AS message FROM orders)
    SELECT 'status' AS kind, coalesce(status, 'missing') AS key, count(*) AS n FROM c GROUP BY 2
    UNION ALL SELECT 'code', CAST(code AS VARCHAR), count(*) FROM c WHERE code IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'message', message, count(*) FROM c WHERE message <> '' GROUP BY 2
    UNION ALL SELECT 'error', coalesce(error, 'none'), count(*) FROM s GROUP BY 2
    UNION ALL SELECT 'failed_answer', parsed_answer, count(*) FROM s WHERE error = 'pred_geocode_failed' GROUP BY 2""")
def geocode_census(spark, sf_dir):
    k = F.col("o_orderkey")
    cache = t(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(k % 3 == 0, 402).alias("code"), F.when(k % 4 == 0, F.col("o_orderpriority")).otherwise("").alias("message"))
    return runs.census(cache, _samples(spark, sf_dir))


@query("""
    WITH e AS (SELECT event_id, user_id, value AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 10) / 10.0::DOUBLE END AS b FROM events),
    w AS (SELECT *, avg(a) OVER g AS ma, stddev_samp(a) OVER g AS sa, avg(b) OVER g AS mb, stddev_samp(b) OVER g AS sb FROM e WINDOW g AS (PARTITION BY user_id)),
    x AS (SELECT event_id, coalesce((a - ma) / (sa + 1e-8), 0) + 0.5 * coalesce((b - mb) / (sb + 1e-8), 0) AS adv FROM w)
    SELECT event_id, round((adv - avg(adv) OVER ()) / (stddev_samp(adv) OVER () + 1e-8), 5) AS advantage FROM x""")
def advantage_gdpo(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("a"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 10) / 10.0).alias("b"))
    return stats.gdpo_advantages(e, "user_id", {"a": 1.0, "b": 0.5}).select("event_id", F.round("advantage", 5).alias("advantage"))


@query("""
    SELECT event_id, round(coalesce(value, 0) + CASE WHEN event_id % 4 = 0 THEN 0 ELSE 0.5 * (event_id % 10) END, 6) AS reward FROM events""")
def weighted_rewards(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 10).cast("double")).otherwise(F.lit(float("nan"))).alias("b"))
    return e.select("event_id", r6(stats.weighted_reward({"value": 1.0, "b": 0.5})).alias("reward"))


@query("""
    WITH r AS (SELECT l_orderkey AS q, l_linenumber AS c, l_discount::DOUBLE AS o, l_tax::DOUBLE AS p FROM lineitem),
    m AS (SELECT *, min(o) OVER w AS olo, max(o) OVER w AS ohi, min(p) OVER w AS plo, max(p) OVER w AS phi FROM r WINDOW w AS (PARTITION BY q)),
    s AS (SELECT q, c, o > 0.02 AS ok, CASE WHEN ohi > olo THEN (o - olo) / (ohi - olo + 1e-5) ELSE least(1.0, o) END AS os, CASE WHEN phi > plo THEN (p - plo) / (phi - plo + 1e-5) ELSE least(1.0, p) END AS ps FROM m),
    k AS (SELECT *, ps + 10 * os AS score, bool_or(ok) OVER w AS any_ok, count(*) FILTER (os > 0) OVER w AS n_some FROM s WINDOW w AS (PARTITION BY q)),
    f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c DESC) AS rn, first_value(c) OVER (PARTITION BY q ORDER BY score, c) AS worst FROM k WHERE any_ok AND n_some - 1 < 5)
    SELECT q, c, worst AS rejected, round(score, 6) AS score FROM f WHERE rn <= 2 AND ok AND c <> worst""")
def best_of_n_masked(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("c"), F.col("l_discount").cast("double").alias("o"), F.col("l_tax").cast("double").alias("p"))
    return rounded(stats.best_of_n_scored(li, "q", "c", "o", "p", orm_least=0.02, keep=2, returned=6, easy=0.9))


# --- rows in parts ------------------------------------------------------------------

@query("""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS BIGINT) AS shard, i % 7 AS strided, CASE WHEN i < (n // 7) * 7 THEN i // (n // 7) END AS piece, i >= 10 AS late FROM r""")
def row_parts(spark, sf_dir):
    d, order = t(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")]
    out = compose.shards(compose.shards(d, 7, order), 7, order, contiguous=False, name="strided")
    out = out.join(compose.pieces(d, 7, order), "doc_id", "left")
    return out.join(compose.after(d, 10, order).withColumn("late", F.lit(True)), "doc_id", "left").fillna(False, ["late"])


@query("""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY %s, doc_id) AS rn, count(*) OVER () AS n FROM documents)
    SELECT doc_id FROM r WHERE rn <= CAST(floor(n * 0.3) AS BIGINT)""" % u(42, "doc_id"))
def ratio_sample(spark, sf_dir):
    return compose.sample_ratio(t(spark, sf_dir, "documents").select("doc_id"), 0.3, ("doc_id",))


@query("""
    WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY %s, doc_id) - 1 AS i FROM documents),
    s AS (SELECT doc_id, row_number() OVER (ORDER BY i // 400, n_chars DESC, doc_id) - 1 AS j FROM r)
    SELECT doc_id, CAST(j // 8 AS BIGINT) AS batch FROM s""" % u(42, "doc_id"))
def length_batches(spark, sf_dir):
    return encode.length_batches(t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ("doc_id",), 8).select("doc_id", F.col("batch").cast("long").alias("batch"))


# --- text rules ---------------------------------------------------------------------

@query("""
    WITH p AS (SELECT doc_id, 'data/' || source || '/img ' || doc_id || '_' || (doc_id % 5) || '.v1.jpg' AS path FROM documents)
    SELECT doc_id, 'img ' || doc_id || '_' || (doc_id % 5) || '.v1' AS stem, 'img_' || doc_id || '_' || (doc_id % 5) || '.v1' AS clean, 'img ' || doc_id || '_' || (doc_id % 5) || '.v1_' || substr(md5(path), 1, 12) AS item,
           'img ' || doc_id || CASE WHEN doc_id % 5 IN (1, 2, 3) THEN '' ELSE '_' || (doc_id % 5) END AS grp, 'img_' || doc_id || '_' || (doc_id % 5) || '_v1' AS slug FROM p""")
def path_fields(spark, sf_dir):
    path = cat("data/", F.col("source"), "/img ", ident(), "_", ident() % 5, ".v1.jpg")
    stem = text.path_stem(path)
    return t(spark, sf_dir, "documents").select("doc_id", stem.alias("stem"), text.sanitize_name(stem).alias("clean"), text.item_id(path).alias("item"), text.group_stem(cat("img ", ident(), "_", ident() % 5)).alias("grp"), text.slug(stem).alias("slug"))


@query(f"""SELECT doc_id, {by_shape(6, ["true", "false", "true", "false", "NULL", "false"])} AS flag,
    {by_shape(6, ["'q ' || doc_id", "'s ' || doc_id", "'\"open ' || doc_id", "''", "'\"'", "lang"])} AS bare, 'a' || doc_id || ', ' || lang || ', c' AS address, {by_shape(6, ["doc_id + 0.5", "NULL", "-1.0", "1e3", "NULL", "NULL"])}::DOUBLE AS number FROM documents""")
def small_parsers(spark, sf_dir):
    k = ident() % 6
    pick = lambda *v: F.coalesce(*[F.when(k == i, x) for i, x in enumerate(v)])
    flag = pick(*[F.lit(x) for x in ("Yes", " no", "1", "F", "maybe", "")])
    quoted = pick(cat('"q ', ident(), '" '), cat("'s ", ident(), "'"), cat('"open ', ident()), F.lit('""'), F.lit('"'), F.col("lang"))
    number = pick(cat(ident(), ".5"), F.lit("x"), F.lit(" -1 "), F.lit("1e3"), F.lit(""), F.lit("1,5"))
    said = cat("<answer> a", ident(), " ; ", F.col("lang"), ",; c </answer>")
    return t(spark, sf_dir, "documents").select("doc_id", text.to_bool(flag).alias("flag"), text.strip_quotes(quoted).alias("bare"), text.normalize_address(said).alias("address"), text.maybe_float(number).alias("number"))


@query("""
    WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
    SELECT doc_id, len(w) AS n_tokens, len(list_filter(range(1, len(w)), lambda i: w[i] = w[1] AND w[i + 1] = w[2])) AS places, len(w) // 100 + (len(w) % 100 > 0)::INT AS chunks, array_to_string(w[greatest(1, len(w) - 9):], ' ') AS last_ten FROM w""")
def token_places(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    w, n = F.col("w"), F.size("w")
    places = F.when(n > 1, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (F.get(w, i - 1) == F.get(w, F.lit(0))) & (F.get(w, i) == F.get(w, F.lit(1)))))).otherwise(0)
    return d.select("doc_id", n.cast("long").alias("n_tokens"), places.cast("long").alias("places"), F.size(chat.split_chunks(w, 100)).cast("long").alias("chunks"), F.array_join(chat.truncate(w, 10, "left"), " ").alias("last_ten"))


@query("""
    SELECT doc_id, unnest(['', '<a>', '<b>', '<a>']) AS key, unnest(['see ', ' ' || lang || ' ', 'x', CAST(doc_id AS VARCHAR)]) AS content, unnest([1.0, 0.5, 1.0, 0.5])::DOUBLE AS weight FROM documents""")
def split_and_weigh(spark, sf_dir):
    said = cat("see <a> ", F.col("lang"), " <b>x<a>", ident())
    d = t(spark, sf_dir, "documents").select("doc_id", F.inline(spans.split_column(said, ["<a>", "<b>"])))
    w = F.array_max(F.transform(spans.span_weights(F.array(F.struct(F.col("key"), F.col("content"))), {"<a>": (0.5, 0.5)}), lambda x: x["weight"]))
    return d.select("doc_id", "key", "content", w.cast("double").alias("weight"))


@query("""
    SELECT doc_id, 'at ' || doc_id || ' and ' || lang || ' or <box>' AS filled, [CAST(round_even(least(doc_id % 97, 50) / 200.0 * 1000, 0) AS INTEGER), CAST(round_even((doc_id % 31) / 100.0 * 1000, 0) AS INTEGER), CAST(round_even(greatest(doc_id % 97, 50) / 200.0 * 1000, 0) AS INTEGER), 990] AS bbox FROM documents""")
def boxes_filled(spark, sf_dir):
    box = F.array((ident() % 97).cast("double"), F.lit(99.0), F.lit(50.0), (ident() % 31).cast("double"))
    filled = spans.fill_placeholders(F.lit("at <box> and <box> or <box>"), "<box>", F.array(ident().cast("string"), F.col("lang")))
    return t(spark, sf_dir, "documents").select("doc_id", filled.alias("filled"), text.normalize_bbox(box, F.lit(200.0), F.lit(100.0)).alias("bbox"))


# --- records ------------------------------------------------------------------------

@query("""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'be ' || lang || chr(10) || source WHEN doc_id % 3 = 1 THEN 'be ' || lang ELSE source END AS query, text AS response FROM documents WHERE text IS NOT NULL""")
def alpaca_records(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.when(ident() % 3 == 2, "").otherwise(cat("be ", F.col("lang"))).alias("instruction"), F.when(ident() % 3 == 1, "").otherwise(F.col("source")).alias("input"), F.col("text").alias("output"))
    m = normalize.normalize(d, keep=("doc_id",))
    return m.select("doc_id", F.element_at("messages", 1)["content"].alias("query"), F.element_at("messages", -1)["content"].alias("response")).where("query IS NOT NULL")


@query("""
    SELECT doc_id, 6 AS n_messages, 'it''s ' || lang AS first_query, 'say "' || source || '"' AS last_answer FROM documents""")
def history_records(spark, sf_dir):
    history = cat("[[\"it's ", F.col("lang"), "\", 'a'], ['q', 'say \"", F.col("source"), "\"']]")
    d = t(spark, sf_dir, "documents").select("doc_id", history.alias("history"), F.lit("now").alias("query"), F.lit("done").alias("response"))
    m = normalize.normalize(d, keep=("doc_id",))
    return m.select("doc_id", F.size("messages").cast("int").alias("n_messages"), F.element_at("messages", 1)["content"].alias("first_query"), F.element_at("messages", 4)["content"].alias("last_answer"))


@query("""
    SELECT doc_id, 'user: ' || lang || ' | assistant: no' AS rejected FROM documents WHERE doc_id % 3 <> 0""")
def rejected_records(spark, sf_dir):
    """Rows whose rejected answer is null or the answer itself go."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("query"), F.lit("yes").alias("response"), F.when(ident() % 6 == 0, "yes").when(ident() % 3 != 0, "no").alias("rejected_response"))
    m = normalize.normalize(d, keep=("doc_id",))
    whole = normalize.expand_rejected(F.col("messages"), F.col("rejected_response"))
    return m.select("doc_id", F.array_join(F.transform(whole, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), " | ").alias("rejected"))


@query("SELECT doc_id, text, lang, source, n_chars, CAST(NULL AS VARCHAR) AS api_token, '<<<bytes>>>' AS raw FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Written as JSON lines by the sink and read back by the source; bytes and tokens are masked."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.jsonl"
    d = t(spark, sf_dir, "documents").withColumn("api_token", F.lit("secret")).withColumn("raw", F.lit("x").cast("binary"))
    spec.write_jsonl(d, path)
    kinds = "doc_id long, text string, lang string, source string, n_chars long, api_token string, raw string"
    return spec.read_records(spark, path, "json", kinds)


@query("""
    WITH d AS (SELECT doc_id, lang, source FROM documents), p AS (SELECT doc_id, lang AS before, CASE WHEN doc_id % 4 = 0 THEN 1 END AS s FROM d)
    SELECT doc_id, 'newly_selected' AS change FROM d WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'dropped' FROM d WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0""")
def selection_changes(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(ident().alias("item_id"))
    of = lambda k: d.withColumn("selected", F.col("item_id") % k == 0)
    return runs.run_changes(of(4), of(3)).select(F.col("item_id").alias("doc_id"), "change")


@query("""
    WITH a AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS rn FROM lineitem WHERE l_orderkey % 2 = 0)
    SELECT 'i/' || o_orderkey || '.jpg' AS image_path, coalesce('ann ' || p, CASE WHEN o_orderkey % 3 = 0 THEN 'side ' || o_custkey END) AS gt_text FROM orders LEFT JOIN a ON a.k = o_orderkey AND rn = 1
    WHERE p IS NOT NULL OR o_orderkey % 3 = 0""")
def build_items(spark, sf_dir):
    path = lambda c: cat("i/", F.col(c), ".jpg").alias("image_path")
    none = [F.lit(None).cast("double").alias(c) for c in ("gt_latitude", "gt_longitude")]
    o = t(spark, sf_dir, "orders")
    ann = in_file_order(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(path("l_orderkey"), F.col("l_linenumber").alias("ord"), "place", cat("ann ", F.col("l_partkey")).alias("gt_text"), *none)
    side = o.where("o_orderkey % 3 = 0").select(path("o_orderkey"), cat("side ", F.col("o_custkey")).alias("gt_text"), *none)
    return runs.build_items(o.select(path("o_orderkey")), ann, side).select("image_path", "gt_text")


@query("""
    SELECT round(100.0 * avg((k % 7 * 30 < 100)::INT) FILTER (k % 3 <> 0), 6) AS acc_100km, count(k % 7) FILTER (k % 3 <> 0) AS n FROM (SELECT c_custkey AS k FROM customer)""")
def geo_accuracy_older(spark, sf_dir):
    km = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 7 * 30)
    return t(spark, sf_dir, "customer").select(km.alias("km")).agg(r6(metrics.geo_accuracy_valid_only(F.col("km"), 100)).alias("acc_100km"), F.count("km").alias("n"))


@query("""
    WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
    p AS (SELECT len(list_filter(range(2, len(w) + 1), lambda i: length(w[i]) <> 2)) AS n, len(list_filter(range(2, len(w) + 1), lambda i: length(w[i]) <> 2 AND length(w[i]) = length(w[i - 1]))) AS h FROM w)
    SELECT round(sum(h) / sum(n), 6) AS token_acc, round(avg((h = n)::INT), 6) AS seq_acc FROM p""")
def token_accuracy(spark, sf_dir):
    """Labels are the lengths of words, two letters are ignored; predicted is the length of the word before."""
    d = t(spark, sf_dir, "documents").select(F.transform(F.split("text", " "), lambda x: F.length(x)).alias("p"))
    d = d.withColumn("l", F.transform("p", lambda x: F.when(x == 2, -100).otherwise(x)))
    return rounded(metrics.token_accuracy(d, "p", "l"))


@query()
def ellipsoidal_distances(spark, sf_dir):
    k = F.col("c_custkey").cast("double")
    return t(spark, sf_dir, "customer").select("c_custkey", r6(geo.ellipsoidal_km(k % 160 - 80, k % 340 - 170, k % 150 - 75, (k * 7) % 300 - 150)).alias("km"))
