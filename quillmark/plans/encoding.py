"""Registered queries of the encode layer: templates, loss weights, truncation, encodings of tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import compose, encode, metrics, normalize, runs, templates
from quillmark.plans.catalogue import conversations, query, rounded, t, u
from quillmark.plans.more import by_shape, cat, ident, shaped
from quillmark.scratch import shared_dir
from quillmark.sources import spec


def _turns(*said: tuple[str, Column | str]) -> Column:
    return F.array(*[normalize.message(role, F.lit(x) if isinstance(x, str) else x) for role, x in said])


def _template_sql() -> str:
    """Texts by window functions, one branch a template."""
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    out = []
    for name, x in templates.TEMPLATES.items():
        before, _, after = x.prompt.partition("{{QUERY}}")
        lead = x.prefix if "{{SYSTEM}}" in x.prefix else x.system_prefix
        opening, _, closing = lead.partition("{{SYSTEM}}")
        stops = " OR ".join(f"ends_with(text, {lit(s)})" for s in x.stop_words) or "false"
        last = "" if x.chat_sep is not None else " WHERE i >= n - 2 + (last_role <> 'assistant')::INT"
        out.append(f"""
            SELECT conv_id, '{name}' AS template, max(CASE WHEN sys IS NULL OR sys = '' THEN {lit(x.prefix.replace("{{SYSTEM}}", ""))} ELSE {lit(opening)} || sys || {lit(closing)} END)
                   || string_agg(CASE WHEN role <> 'assistant' THEN {lit(before)} || text || {lit(after)}
                        WHEN i = n - 1 THEN text || CASE WHEN {stops} THEN '' ELSE {lit(x.suffix)} END ELSE text || {lit(x.chat_sep or "")} END, '' ORDER BY i) AS rendered
            FROM r{last} GROUP BY conv_id""")
    return f"""
        WITH c AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
        s AS (SELECT *, max(CASE WHEN rn = 1 AND role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, arg_max(role, rn) OVER (PARTITION BY conv_id) AS last_role
              FROM s WHERE NOT (rn = 1 AND role = 'system')),
        x AS ({" UNION ALL ".join(out)}) SELECT conv_id, template, md5(rendered) AS md5, length(rendered)::INT AS n_chars FROM x"""


@query(_template_sql())
def template_renders(spark, sf_dir):
    """Every conversation in every template."""
    c = conversations(spark, sf_dir)
    for name in templates.TEMPLATES:
        c = templates.with_pieces(c, name, name=name).withColumn(name, templates.rendered(F.col(name)))
    c = c.select("conv_id", F.inline(F.array(*[F.struct(F.lit(name).alias("template"), F.col(name).alias("rendered")) for name in templates.TEMPLATES])))
    return c.select("conv_id", "template", F.md5(F.col("rendered").cast("binary")).alias("md5"), F.length("rendered").alias("n_chars"))


@query("""
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    l AS (SELECT *, max(CASE WHEN role = 'user' THEN i ELSE 0 END) OVER (PARTITION BY conv_id) AS last_user, max(i) OVER (PARTITION BY conv_id) AS n FROM c),
    w AS (SELECT conv_id, coalesce(sum(length(coalesce(text, ''))) FILTER (role = 'assistant'), 0) AS answers, coalesce(sum(length(coalesce(text, ''))) FILTER (role = 'assistant' AND i > last_user), 0) AS last_answers,
          count(*) FILTER (role = 'assistant' AND i = n) * 11 AS suffix FROM l GROUP BY conv_id)
    SELECT conv_id, (answers + suffix)::DOUBLE AS "default", (last_answers + suffix)::DOUBLE AS last_round FROM w""")
def loss_strategies(spark, sf_dir):
    """Weighted characters of each conversation by strategy."""
    def total(strategy: str) -> DataFrame:
        p = templates.with_pieces(conversations(spark, sf_dir), loss=strategy)
        return p.select("conv_id", F.aggregate("pieces", F.lit(0.0), lambda a, x: a + x["weight"] * F.length(x["text"])).alias(strategy))

    return total("default").join(total("last_round"), "conv_id")


@query("""
    WITH d AS (SELECT doc_id, lang, doc_id % 6 AS k, CAST(doc_id AS VARCHAR) AS i FROM documents),
    p AS (
        SELECT doc_id, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS place, unnest(['see ' || lang || ' ', 'Thought:', ' t' || i || ' ', 'Action:', ' find ', 'Action Input:', ' {}' || chr(10), 'Observation:', ' o' || i || ' ', 'Final Answer:', ' f']) AS text,
               unnest([1.0, 1, 1, 2, 2, 2, 2, 2, 0, 1, 1]) AS weight FROM d WHERE k = 0
        UNION ALL SELECT doc_id, unnest([0, 1, 2, 3]), unnest(['a ', '<tool_call>' || chr(10) || i || '</tool_call>', ' b ', '<tool_call>' || lang || '</tool_call>']), unnest([1.0, 2, 1, 2]) FROM d WHERE k = 1
        UNION ALL SELECT doc_id, unnest([0, 1]), unnest(['<think>' || chr(10) || ' </think>' || chr(10), 'so ' || i]), unnest([0.0, 1]) FROM d WHERE k = 2
        UNION ALL SELECT doc_id, unnest([0, 1, 2, 3, 4, 5]), unnest(['✿FUNCTION✿:', ' f' || i || ' ', '✿ARGS✿:', ' ' || lang || ' ', '✿RESULT✿:', ' r']), unnest([2.0, 2, 2, 2, 2, 0]) FROM d WHERE k = 3
        UNION ALL SELECT doc_id, 0, 'Action: ' || i, 3.0 FROM d WHERE k = 4
        UNION ALL SELECT doc_id, unnest([0, 1]), unnest(['Action:', ' ' || lang]), unnest([1.0, 3]) FROM d WHERE k = 5)
    SELECT doc_id, CAST(place AS INT) AS place, text, CAST(weight AS DOUBLE) AS weight FROM p""")
def loss_types(spark, sf_dir):
    """Answers in the forms that each loss type knows, in weighted pieces."""
    lang = F.col("lang")
    said = [
        ("react", "q", cat("see ", lang, " Thought: t", ident(), " Action: find Action Input: {}\nObservation: o", ident(), " Final Answer: f")), ("hermes", "q", cat("a <tool_call>\n", ident(), "</tool_call> b <tool_call>", lang, "</tool_call>")),
        ("ignore_empty_think", "q", cat("<think>\n </think>\nso ", ident())), ("qwen", "q", cat("✿FUNCTION✿: f", ident(), " ✿ARGS✿: ", lang, " ✿RESULT✿: r")),
        ("agentflan", "well: What is the value of x", cat("Action: ", ident())), ("agentflan", "q", cat("Action: ", lang)),
    ]
    d = t(spark, sf_dir, "documents")
    rows = []
    for k, (kind, asked, answer) in enumerate(said):
        m = d.where(ident() % 6 == k).select("doc_id", _turns(("user", asked), ("assistant", answer)).alias("messages"))
        p = templates.with_pieces(m, templates.Template("", "{{QUERY}}", "", ""), f"default+{kind}")
        rows.append(p.select("doc_id", F.posexplode(F.slice("pieces", 2, 1000))))
    return compose.concat(rows).select("doc_id", F.col("pos").alias("place"), "col.text", "col.weight")


@query("""
    WITH d AS (SELECT doc_id, text, length(text) AS n, list_transform(range(1, length(text) + 1), lambda i: unicode(text[i])) AS ids FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, ids, n, list_transform(list_filter(range(1, n + 1), lambda i: ids[i] <> 32), lambda i: i) AS free FROM d),
    b AS (SELECT *, greatest(40 - (n - len(free)), 0) AS room FROM s),
    k AS (SELECT doc_id, n, CASE WHEN n <= 40 THEN ids ELSE list_transform(list_filter(range(1, n + 1), lambda i: ids[i] = 32 OR (room > 0 AND i <= coalesce(free[room], n))), lambda i: ids[i]) END AS right_ids,
          CASE WHEN n <= 40 THEN ids ELSE list_transform(list_filter(range(1, n + 1), lambda i: ids[i] = 32 OR (room > 0 AND i >= free[len(free) - room + 1])), lambda i: ids[i]) END AS left_ids FROM b)
    SELECT doc_id, n::INT AS n_tokens, array_to_string(right_ids, ' ') AS "right", array_to_string(left_ids, ' ') AS "left", CASE WHEN n <= 40 THEN coalesce(left_ids[1], 0) ELSE -100 END::INT AS head FROM k""")
def protected_truncation(spark, sf_dir):
    """Texts as code points cut to 40; blanks are protected."""
    ids = encode.characters(F.col("text"))
    d = t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", ids.alias("input_ids")).withColumn("n_tokens", F.size("input_ids")).withColumn("whole", F.col("input_ids"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    # Both cuts are made in one pass over a row.
    right = encode.truncated(d, 40, "right", (32,)).select("doc_id", "n_tokens", join("input_ids").alias("right"), F.col("whole").alias("input_ids"), F.col("whole").alias("labels"))
    left = encode.truncated(right, 40, "left", (32,))
    return left.select("doc_id", "n_tokens", "right", join("input_ids").alias("left"), F.coalesce(F.get("labels", F.lit(0)), F.lit(0)).alias("head"))


@query("""
    WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 500)) AS start FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, (start // 500)::INT AS part, length(substr(text, start + 1, 500))::INT AS n_tokens, CASE WHEN length(text) > 500 THEN -100 ELSE coalesce(unicode(nullif(substr(text, 1, 1), '')), 0) END::INT AS head,
           coalesce(unicode(nullif(substr(text, start + least(500, length(text) - start)::BIGINT, 1), '')), 0)::INT AS last_token FROM d
    WHERE length(text) = 0 OR length(text) <= 500 OR length(text) - start > 1""")
def split_truncation(spark, sf_dir):
    """Texts as code points in rows of 500; parts of a single token, whose head is blank as well, are left out."""
    ids = encode.characters(F.col("text"))
    d = t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").alias("n"), ids.alias("input_ids"))
    d = d.withColumn("labels", F.col("input_ids")).withColumn("loss_scale", F.transform("input_ids", lambda x, i: i + 1.0))
    rows = encode.truncated(d, 500, "split")
    size = F.size("input_ids")
    rows = rows.where((F.col("n") <= 500) | (size > 1))
    part = F.when(size > 1, F.floor((F.get("loss_scale", F.lit(1)) - 2) / 500)).otherwise(0).cast("int")
    return rows.select("doc_id", part.alias("part"), size.alias("n_tokens"), F.coalesce(F.get("labels", F.lit(0)), F.lit(0)).alias("head"), F.coalesce(F.get("labels", size - 1), F.lit(0)).alias("last_token"))


@query("""
    SELECT doc_id, 'user: ' || lang || '|assistant: yes' AS chosen, 'user: ' || lang || '|assistant: no ' || source AS rejected FROM documents WHERE lang IS NOT NULL""")
def rejected_conversations(spark, sf_dir):
    """Rejected messages are brought to the standard form like the others."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    pair = lambda q, a: F.struct(q.alias("human"), a.alias("gpt"))
    d = t(spark, sf_dir, "documents").where("lang IS NOT NULL").select(
        "doc_id", F.array(turn("human", F.col("lang")), turn("GPT", F.lit("yes"))).alias("conversations"), F.array(pair(F.col("lang"), cat("no ", F.col("source")))).alias("rejected_messages"))
    m = normalize.normalize(d, keep=("doc_id",))
    show = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "|")
    return m.select("doc_id", show("messages").alias("chosen"), show("rejected_messages").alias("rejected"))


@query("SELECT doc_id, (doc_id % 5)::BIGINT AS label, lang AS query FROM documents WHERE doc_id % 7 <> 0 AND lang IS NOT NULL")
def class_records(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("query"), F.when(ident() % 7 == 0, "none").otherwise((ident() % 5).cast("string")).alias("label"))
    return normalize.classes(d, keep=("doc_id",)).select("doc_id", "label", F.element_at("messages", 1)["content"].alias("query"))


def _prompts(name: str) -> str:
    return "[" + ", ".join(f"'{q}'" for q, _ in normalize.GROUNDING["grounding", name]) + "]"


@query(f"""
    SELECT doc_id, CASE WHEN {u(7, 'doc_id')} < 0.8 THEN ({_prompts("en")})[1 + floor({u(8, 'doc_id')} * 11)::INT] ELSE ({_prompts("zh")})[1 + floor({u(8, 'doc_id')} * 7)::INT] END AS query, '<bbox>' AS response FROM documents""")
def grounding_prompts(spark, sf_dir):
    p = normalize.grounding_prompt(compose.uniform(7, ident()), compose.uniform(8, ident()), "grounding")
    return t(spark, sf_dir, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.query", "p.response")


@query("""
    SELECT doc_id, source || ' ' || lang AS chosen, CASE WHEN doc_id % 3 <> 0 THEN source || ' no' END AS rejected, coalesce(doc_id % 4 = 1, false) AS label FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def kto_encoding(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(
        _turns(("user", F.col("source")), ("assistant", F.col("lang"))).alias("messages"), F.when(ident() % 3 != 0, "no").alias("rejected_response"),
        F.when(ident() % 4 != 2, ident() % 4 == 1).alias("label"), ident().alias("margin"))
    k = encode.dispatch(d, mode="kto")
    return k.select(F.col("margin").alias("doc_id"), F.array_join("chosen_input_ids", " ").alias("chosen"), F.array_join("rejected_input_ids", " ").alias("rejected"), "label")


@query("""
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS m FROM orders)
    SELECT o_orderkey, ((rn * 7 - 1) // m)::BIGINT AS shard FROM r""")
def list_shards(spark, sf_dir):
    return compose.list_split(t(spark, sf_dir, "orders").select("o_orderkey"), 7, [F.col("o_orderkey")])


@query("""
    WITH l AS (SELECT l_quantity::DOUBLE AS y, l_extendedprice::DOUBLE AS a, -l_discount::DOUBLE AS b FROM lineitem),
    k AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
          rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM l)
    SELECT 'price' AS name, round(corr(a, y), 6) AS pearson, round(corr(ra, ry), 6) AS spearman FROM k UNION ALL SELECT 'less', round(corr(b, y), 6), round(corr(rb, ry), 6) FROM k""")
def label_correlations(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("y"), F.col("l_extendedprice").alias("price"), (-F.col("l_discount")).alias("less"))
    return rounded(metrics.label_correlations(d, ["price", "less"], "y"))


# --- extraction, losses, files --------------------------------------------------------

@query(f"""SELECT doc_id, {by_shape(9, ["'City ' || doc_id || '; R'", "'low ' || doc_id", "'say \"' || doc_id || '\"'", "NULL", "'in ' || doc_id", "NULL", "NULL", "'F ' || doc_id", "'b' || doc_id"])} AS answer FROM documents""")
def eval_answers(spark, sf_dir):
    i = ident()
    shapes = [
        cat('<think>t</think><answer> {"FinalAnswer": " City  ', i, ';\n R "} </answer>'), cat('{"FinalAnswer": "", "final_answer": "low ', i, '"}'), cat('so "finalanswer" : "say \\"', i, '\\"" there'), cat("FinalAnswer: City", i),
        cat('<answer>```json\n{"FinalAnswer": "in ', i, '"}\n```</answer>'), F.lit("  "), cat('{"FinalAnswer": ', i, "}"), cat('<answer>none</answer> {"FinalAnswer": "F ', i, '"}'), cat('<answer>{"FinalAnswer": "b', i, '"} tail</answer>'),
    ]
    return shaped(spark, sf_dir, shapes).select("doc_id", text.eval_answer(F.col("out")).alias("answer"))


@query("""
    WITH x AS (SELECT doc_id, doc_id % 8 AS k, doc_id % 80 + 0.5 AS la, doc_id % 170 + 0.25 AS lo FROM documents)
    SELECT doc_id, CAST(CASE WHEN k IN (0, 1, 2, 6) THEN la END AS DOUBLE) AS lat, CAST(CASE WHEN k IN (0, 1, 2, 6) THEN lo END AS DOUBLE) AS lon FROM x""")
def reward_points(spark, sf_dir):
    la, lo = (ident() % 80 + F.lit(0.5)).cast("double"), (ident() % 170 + F.lit(0.25)).cast("double")
    shapes = [
        cat('<answer>{"lat": "', la, '", "lng": ', lo, "}</answer>"), cat('text {"latitude": ', la, ', "longitude": ', lo, "} more"), cat('<answer>{"lat": 95, "lon": 1}</answer> <answer>at {"lat": ', la, ', "lon": ', lo, "}</answer>"),
        cat('{"latitude": ', la + 95, ', "longitude": ', lo, "}"), cat("(", la, ", ", lo, ")"), cat('{"latitude": null, "lat": ', la, ', "lon": ', lo, "}"), cat('{"a": 1, "lat": ', la, ', "longitude": ', lo, ', "b": {"c": 2}}'), F.lit(None).cast("string"),
    ]
    d = shaped(spark, sf_dir, shapes).select("doc_id", text.reward_point(F.col("out")).alias("p"))
    return d.select("doc_id", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


@query("""SELECT doc_id, 'q|' || lang || '|r|<think>b</think>' || source AS said FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def old_thoughts(spark, sf_dir):
    d = t(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    d = d.select("doc_id", _turns(("user", "q"), ("assistant", cat("<think>a</think>\n", F.col("lang"), " ")), ("user", "r"), ("assistant", cat("<think>b</think>", F.col("source")))).alias("messages"))
    return normalize.without_old_thoughts(d).select("doc_id", F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("said"))


@query("""
    WITH r AS (SELECT l_orderkey % 500 AS b, l_discount::DOUBLE * 10 AS s, (l_linenumber % 2)::DOUBLE AS y FROM lineitem),
    l AS (SELECT *, 1 - s AS d, CASE WHEN sum(y) OVER w > 1 THEN max(1 - s) FILTER (y = 1) OVER w ELSE avg(1 - s) FILTER (y = 0) OVER w END AS below,
          CASE WHEN sum(1 - y) OVER w > 1 THEN min(1 - s) FILTER (y = 0) OVER w ELSE avg(1 - s) FILTER (y = 1) OVER w END AS above FROM r WINDOW w AS (PARTITION BY b))
    SELECT 'cosine_similarity' AS name, round(avg((s - y) ** 2), 6) AS loss FROM l
    UNION ALL SELECT 'online_contrastive', round(sum(CASE WHEN y = 1 AND d > above THEN d * d WHEN y = 0 AND d < below THEN greatest(0, 0.5 - d) ** 2 ELSE 0 END), 6) FROM l""")
def embedding_losses(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("b"), (F.col("l_discount").cast("double") * 10).alias("s"), (F.col("l_linenumber") % 2).cast("double").alias("y"))
    named = lambda name, x: x.select(F.lit(name).alias("name"), "loss")
    return rounded(compose.concat([named("cosine_similarity", metrics.cosine_loss(d, "s", "y")), named("online_contrastive", metrics.online_contrastive(d, "s", "y", "b").agg(F.sum("loss").alias("loss")))]))


@query("""
    WITH r AS (SELECT l_orderkey AS g, l_quantity::DOUBLE / 10 AS x, (l_linenumber = 1)::INT AS y, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    q AS (SELECT ln(sum(exp(x))) - max(x) FILTER (y = 1) AS loss FROM r WHERE n >= 2 GROUP BY g)
    SELECT 'pointwise_reranker' AS name, round(avg(ln(1 + exp(x)) - x * y), 6) AS loss FROM r UNION ALL SELECT 'listwise_reranker', round(avg(loss), 6) FROM q""")
def rerank_losses(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_quantity").cast("double") / 10).alias("x"), (F.col("l_linenumber") == 1).cast("int").alias("y"))
    named = lambda name, x: x.select(F.lit(name).alias("name"), "loss")
    return rounded(compose.concat([named("pointwise_reranker", metrics.pointwise_loss(d, "x", "y")), named("listwise_reranker", metrics.listwise_loss(d, "x", "y", "g"))]))


@query("""
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN 'Known' WHEN 2 THEN 'f' || doc_id || '.x' END AS domain, md5('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS key FROM documents WHERE lang IS NOT NULL""")
def path_domains(spark, sf_dir):
    k = ident() % 4
    path = F.when(k == 0, cat("/r/", F.col("lang"), "/a/b.jsonl")).when(k == 1, F.lit("/r/Known_Metadata.jsonl")).when(k == 2, cat("/r/f", ident(), ".x.json")).otherwise(F.lit("/other/b.json"))
    d = t(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang", F.when(k == 2, F.lit("")).cast("string").alias("domain"))
    d = runs.with_domain(d, text.domain_of(path, "/r", {"known_metadata": "Known"}))
    return d.select("doc_id", "domain", runs.row_key(["lang", "doc_id", "choices"]).alias("key"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM documents")
def resumed_append(spark, sf_dir):
    """A run that wrote a third of the rows is taken up again."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    spec.append_new(d.where(ident() % 3 == 0).withColumn("run", F.lit(1)), path, ["doc_id"])
    spec.append_new(d.withColumn("run", F.lit(2)), path, ["doc_id"])
    return spark.read.parquet(path)
