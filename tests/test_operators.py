"""Table-driven tests of operators and functions, and invariants where order is free."""

import json

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import geo, rewards, text, toolcall
from quillmark.operators import chat, compose, metrics, normalize, stats
from quillmark.sources import spec
from quillmark.streaming import stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- specs and readers


@pytest.mark.parametrize(("text_", "want"), [
    ("a/b", spec.Spec("a/b")),
    ("hf::a/b:x/y#50", spec.Spec("a/b", "hf", ("x", "y"), 50)),
    ("a/b#7", spec.Spec("a/b", rows=7)),
    ("ms::a", spec.Spec("a", "ms")),
])
def test_spec(text_, want):
    assert spec.Spec.parse(text_, exists=lambda p: False) == want


def test_existing_path_wins():
    assert spec.Spec.parse("/x:y#1", exists=lambda p: p == "/x:y#1").name == "/x:y#1"


def test_subset_choice():
    d = spec.Dataset("n", "p", {"default": "a", "b": "b", "w": "w"}, frozenset({"w"}))
    assert d.choose(()) == ["default"]
    assert d.choose(("all",)) == ["default", "b"]
    assert d.choose(("zzz",)) == ["zzz"]


def test_registry(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "org/one", "path": "one.jsonl"}]))
    r = spec.Registry()
    r.register_json(str(tmp_path / "r.json"))
    assert r.find("one").path == str(tmp_path / "one.jsonl")
    with pytest.raises(ValueError):
        r.register(spec.Dataset("org/one", "x"))


def test_csv_blanks_stay_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text('system,query,response\n,"q, 1",r\n')
    row = spec.read_records(spark, str(tmp_path / "a.csv")).first()
    assert (row.system, row.query) == ("", "q, 1")
    m = normalize.normalize(spec.read_records(spark, str(tmp_path / "a.csv"))).first().messages
    assert [(x.role, x.content) for x in m] == [("system", ""), ("user", "q, 1"), ("assistant", "r")]


def test_wrapped_json_and_load(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"items": [{"a": 1}, {"a": 2}]}))
    assert {r.a for r in spec.read_wrapped_json(spark, str(tmp_path / "w.json")).collect()} == {1, 2}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}\n')
    assert spec.load(spark, f"{tmp_path}/l.jsonl#2").count() == 2


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", bytearray(b"z"), "secret")], "a int, b string, c binary, api_token string")
    spec.write_jsonl(df, str(tmp_path / "o"))
    row = spark.read.json(str(tmp_path / "o")).first().asDict()
    assert row == {"a": 1, "b": "x", "c": "<<<bytes>>>"}


def test_discover_images(spark, tmp_path):
    for n in ("a.jpg", "b.PNG", "c.txt"):
        (tmp_path / n).write_bytes(b"1")
    assert {r.relative_path for r in spec.discover_images(spark, str(tmp_path)).collect()} == {"a.jpg", "b.PNG"}


# --- normalisation


def rows(df):
    return [[(m.role, m.content) for m in r.messages] for r in df.collect()]


def test_shapes(spark):
    alpaca = spark.createDataFrame([("do", "this", "done"), ("do", "", "ok")], "instruction string, input string, output string")
    assert rows(normalize.normalize(alpaca)) == [[("user", "do\nthis"), ("assistant", "done")], [("user", "do"), ("assistant", "ok")]]
    chat_ = spark.createDataFrame([([("human", "a"), ("gpt", "b"), ("observation", "c")],)], "conversations array<struct<from:string,value:string>>")
    assert rows(normalize.normalize(chat_)) == [[("user", "a"), ("assistant", "b"), ("tool_response", "c")]]
    pairs = spark.createDataFrame([("s", [("q", "a")])], "system string, conversation array<struct<human:string,assistant:string>>")
    assert rows(normalize.normalize(pairs)) == [[("system", "s"), ("user", "q"), ("assistant", "a")]]
    hist = spark.createDataFrame([("q2", "a2", [["q1", "a1"]])], "query string, response string, history array<array<string>>")
    assert rows(normalize.normalize(hist)) == [[("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2")]]
    literal = spark.createDataFrame([("q2", "a2", "[['q1', 'a1']]")], "query string, response string, history string")
    assert rows(normalize.normalize(literal)) == rows(normalize.normalize(hist))


def test_alias_conflict_leaves_columns():
    assert normalize.plan_renames(["Question", "problem"], {"query": ["question", "problem"]}) == {}
    assert normalize.plan_renames(["Question"], {"query": ["question", "problem"]}) == {"Question": "query"}


def test_bad_rows(spark):
    df = spark.createDataFrame([([("user", "a")],), ([("alien", "a")],), ([("user", None)],), ([],), (None,)], "messages array<struct<role:string,content:string>>")
    assert len(rows(normalize.normalize(df))) == 1
    with pytest.raises(Exception, match="bad record"):
        normalize.normalize(df, strict=True).collect()


def test_merge_tool_calls(spark):
    m = F.array(*[normalize.message(r, F.lit(c)) for r, c in (("user", "u"), ("tool_call", "1"), ("tool_call", "2"), ("tool_response", "r"))])
    assert [(x.role, x.content) for x in value(spark, normalize.merge_tool_calls(m))] == [("user", "u"), ("assistant", "1\n2"), ("tool_response", "r")]


def test_rejected(spark):
    m = F.array(*[normalize.message(r, F.lit(c)) for r, c in (("user", "u"), ("assistant", "good"))])
    assert [x.content for x in value(spark, normalize.expand_rejected(m, F.lit("bad")))] == ["u", "bad"]
    assert value(spark, normalize.valid_rejected(m, F.lit("good"))) is False


# --- composition


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(10, 40))
def test_packing_covers_and_fits(lengths, capacity):
    bins = compose.fullest_fit(lengths, capacity)
    assert len(bins) == len(lengths)
    for b in set(bins):
        held = [n for n, x in zip(lengths, bins, strict=True) if x == b]
        assert sum(held) <= capacity or len(held) == 1


def test_pack_covers_all(spark):
    df = spark.range(50).select("id", (F.col("id") % 7 + 1).alias("n"))
    got = compose.pack(df, "id", "n", 10, chunk=20)
    assert sorted(r.id for r in got.collect()) == list(range(50))
    assert got.groupBy("round", "chunk", "bin").agg(F.sum("length").alias("s")).where("s > 10").count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_ranked_is_total(spark, parts):
    df = spark.range(101).repartition(parts)
    got = compose.ranked(df, [F.col("id") % 10, F.col("id")]).collect()
    want = sorted(range(101), key=lambda i: (i % 10, i))
    assert [r.id for r in sorted(got, key=lambda r: r.rn)] == want


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", [1, 37, 200])
def test_ranked_beyond_one_partition(spark, adaptive, parts):
    """Every position once, in order, however many partitions the two shuffles have."""
    n, before = 300_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(n).select("id", (F.col("id") * 7919 % n).alias("v")).repartition(13)
        r = compose.ranked(df, [F.col("v"), F.col("id")], total="n")
        assert r.where((F.col("rn") != F.col("v") + 1) | (F.col("n") != n)).count() == 0
        assert r.select(F.countDistinct("rn"), F.count("rn")).first()[:] == (n, n)
        b = compose.buckets(df, "v", ["id"], 10).groupBy("bucket").count().collect()
        assert sorted((x.bucket, x["count"]) for x in b) == [(i, n // 10) for i in range(10)]
        w = compose.ranked_within(df.withColumn("g", F.when(F.col("v") % 3 == 0, "hot").otherwise((F.col("v") % 50).cast("string"))), ["g"], [F.col("v")])
        got = w.groupBy("g").agg(F.max("rn").alias("top"), F.countDistinct("rn").alias("d"), F.count("rn").alias("c")).where("top <> c OR d <> c")
        assert got.count() == 0
        total = compose.running_total(df, [F.col("v")], F.lit(1), "before")
        assert total.where("before <> v").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_medians_and_null_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 1.0), ("b", 4.0), (None, 7.0), ("c", None)]
    got = {r.g: r["median"] for r in compose.medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {"a": 2.0, "b": 2.5, None: 7.0}


def test_void_column_survives_ranking(spark):
    df = spark.range(5).withColumn("nothing", F.lit(None))
    assert sorted(r.rn for r in compose.ranked(df, [F.col("id")]).collect()) == [1, 2, 3, 4, 5]


def test_pack_of_many_rows(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 7 + 1).alias("n"))
    got = compose.pack(df, "id", "n", 10)
    assert got.select(F.countDistinct("id"), F.count("id")).first()[:] == (30_000, 30_000)
    bins = got.groupBy("round", "chunk", "bin").agg(F.sum("length").alias("s"))
    assert bins.where("s > 10").count() == 0
    # The open bins of 30 chunks were packed together: one bin at most can take half as much again.
    assert bins.where("s <= 5").count() <= 1


def test_pack_matches_brute_force(spark):
    """Chunks one by one, then the bins they left open, by a plain scan of all bins."""
    rnd = random.Random(5)
    lengths = [rnd.randrange(1, 12) for _ in range(400)]

    def scan(items):
        bins = []
        for i, n in sorted(items, key=lambda x: (-x[1], x[0])):
            fit = [b for b in bins if b["sum"] + n <= 10]
            b = max(fit, key=lambda b: b["sum"]) if fit else None
            if b is None:
                bins.append(b := {"sum": 0, "ids": []})
            b["sum"] += n
            b["ids"].append(i)
        return bins

    done, left = set(), []
    for c in range(0, 400, 50):
        bins = scan([(i, lengths[i]) for i in range(c, c + 50)])
        done |= {frozenset(b["ids"]) for b in bins[:-1]}
        left.append(bins[-1])
    for b in scan([(k, b["sum"]) for k, b in enumerate(left)]):
        done.add(frozenset(i for k in b["ids"] for i in left[k]["ids"]))
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n int")
    got = compose.pack(df, "id", "n", 10, chunk=50).groupBy("round", "chunk", "bin").agg(F.collect_list("id").alias("ids")).collect()
    assert {frozenset(r.ids) for r in got} == done and len(got) == len(done)


def test_pack_rounds_and_edges(spark):
    df = spark.range(1000).select("id", F.lit(1).alias("n"))
    got = compose.pack(df, "id", "n", 10_000, chunk=3)
    assert got.select("round", "chunk", "bin").distinct().count() == 1 and got.count() == 1000
    assert compose.pack(df.limit(0), "id", "n", 10).collect() == []
    assert compose.pack(spark.createDataFrame([(1, None), (2, 50), (3, 4)], "id long, n int"), "id", "n", 10).select("id").distinct().count() == 2


def test_medians_with_a_hot_value(spark):
    """Nine tenths of the rows share a value: they are counted, not sorted."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 < 9, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert [r["median"] for r in compose.medians(df, ["g"], "v").collect()] == [0.0]
    assert [r["median"] for r in compose.medians(df.where("v > 0 OR id < 10000"), ["g"], "v").collect()] == [0.0]
    odd = spark.createDataFrame([(float(i),) for i in (3, 1, 1, 9, 7)], "v double")
    assert [r["median"] for r in compose.medians(odd.withColumn("g", F.lit(1)), ["g"], "v").collect()] == [3.0]


def test_sample_without_ids_is_repeatable(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 3)
    a, b = (sorted(r.id for r in compose.sample(d, 100).collect()) for d in (df.repartition(3), df.repartition(11)))
    assert a == b and len(a) == 100


def test_round_robin_matches_loop(spark):
    data = [("a", i) for i in range(7)] + [("b", i) for i in range(3)] + [("c", i) for i in range(5)]
    weights, left, want = {"a": 2, "b": 1, "c": 3}, {}, []
    for d, i in data:
        left.setdefault(d, []).append((d, i))
    while any(left.values()):
        for d, w in weights.items():
            want += left[d][:w]
            left[d] = left[d][w:]
    df = spark.createDataFrame(data, "d string, i int")
    got = compose.round_robin(df, "d", weights, [F.col("i")]).orderBy("position").collect()
    assert [(r.d, r.i) for r in got] == want


def test_sample_and_split(spark):
    df = spark.range(10)
    assert compose.sample(df, 25, ("id",)).groupBy("id").count().select(F.min("count"), F.max("count")).first()[:] == (2, 3)
    train, val = compose.split(df, 0.25, ("id",))
    assert (train.count(), val.count()) == (8, 2)
    assert compose.split(df, 0, ("id",))[1].count() == 0


@pytest.mark.parametrize("stop", ["first_exhausted", "all_exhausted"])
def test_interleave(spark, stop):
    a, b = spark.range(20), spark.range(100, 105)
    got = compose.interleave([a, b], [0.5, 0.5], ["id"], stop=stop).orderBy("position").collect()
    first = [r.id for r in got if r.source == 1]
    assert first[:5] == list(range(100, 105))[: len(first[:5])]
    if stop == "all_exhausted":
        assert {r.id for r in got} == set(range(20)) | set(range(100, 105))


def test_interleave_joins_by_source_and_number(spark):
    """Both are keys of the join; by the source alone every row of it would meet every draw of it."""
    got = compose.interleave([spark.range(20), spark.range(100, 105)], [0.5, 0.5], ["id"], stop="all_exhausted")
    plan = got._jdf.queryExecution().optimizedPlan()
    keys = [len(re.findall(r"\w+#\d+L? = \w+#\d+", line)) for line in plan.toString().splitlines() if "Join Inner" in line and "__turn" in line]
    assert keys == [2], plan.toString()


def test_curriculum_and_buckets(spark):
    df = spark.range(90).select("id", F.when(F.col("id") % 3 == 0, "low").when(F.col("id") % 3 == 1, "mid").otherwise("high").alias("b"))
    got = compose.curriculum(df, "b", ("id",))
    assert sorted(r.position for r in got.collect()) == list(range(1, 91))
    sizes = {r.bucket: r["count"] for r in compose.buckets(spark.range(23), "id", [], 5).groupBy("bucket").count().collect()}
    assert sizes == {i: int((i + 1) * 23 / 5) - int(i * 23 / 5) for i in range(5)}


# --- functions


@pytest.mark.parametrize(("said", "want"), [
    ("x <answer> Paris </answer> <answer>b</answer>", "Paris"), ("no tags", None), ("<ANSWER>\nA\n</ANSWER>", "A"),
])
def test_answer_block(spark, said, want):
    got = value(spark, text.answer_block(F.lit(said)))
    assert (got.strip() if got else got) == want


@pytest.mark.parametrize(("said", "want"), [
    ('{"latitude": 1.5, "longitude": -2}', (1.5, -2.0)), ("lat: 3, lon = 4", (3.0, 4.0)), ("at (10, 20)", (10.0, 20.0)),
    ('{"latitude": 99, "longitude": 0}', (99.0, 0.0)), ('<answer>48.85, 2.35</answer>', (48.85, 2.35)), ("48.85 N, roughly 2.35", (48.85, 2.35)), ("lat 99, then 1", None), ("none here", None),
])
def test_latlon(spark, said, want):
    got = value(spark, text.latlon(F.lit(said)))
    assert (tuple(got) if got else got) == want


def test_small_text_rules(spark):
    assert value(spark, text.geocode_candidates(F.lit("A; B；C"))) == ["A; B; C", "A; B", "A"]
    assert value(spark, text.geocode_key(F.lit(" A ；  B, c "))) == "a,b,c"
    assert value(spark, text.normalize_address(F.lit("<answer>a; b,, c</answer>"))) == "a, b, c"
    assert value(spark, text.strip_quotes(F.lit('"x"'))) == "x"
    assert value(spark, text.path_stem(F.lit("a/b.c/d_2.tar.gz"))) == "d_2.tar"
    assert value(spark, text.group_stem(F.lit("d_2"))) == "d" and value(spark, text.group_stem(F.lit("d_4"))) == "d_4"
    assert value(spark, text.to_bool(F.lit(" Yes "))) is True
    box = F.array(*[F.lit(float(x)) for x in (40, 10, 5, 20)])
    assert value(spark, text.normalize_bbox(box, F.lit(100.0), F.lit(200.0))) == [50, 50, 400, 100]


def test_format_rewards(spark):
    good = '<think>t</think>\n<answer>{"FinalAnswer": "a; b; c"}</answer>'
    assert value(spark, rewards.format_ok(F.lit(good))) == 1.0
    assert value(spark, rewards.format_ok(F.lit(good + " tail"))) == 0.0
    assert value(spark, rewards.geo_format(F.lit(good))) == 1.0
    assert value(spark, rewards.geo_no_unknown(F.lit(good.replace("b;", "Unknown;")))) == 0.0
    strict = '<think>{"Clues": ["x"], "Reasoning": "y"}</think><answer>{"FinalAnswer": "a; b; c"}</answer>'
    assert value(spark, rewards.geo_strict_format(F.lit(strict))) == 1.0
    assert value(spark, rewards.geo_strict_format(F.lit(good))) == 0.0
    whole = '{"Clues": ["x"], "Reasoning": "y", "FinalAnswer": "a；b；c"}<|im_end|>'
    assert value(spark, rewards.geo_json_strict_format(F.lit(whole))) == 1.0
    assert value(spark, rewards.react_ok(F.lit("<think>a</think> Action: x\nAction Input: y"))) == 1.0


@pytest.mark.parametrize(("a", "b", "want"), [
    (r"so \boxed{42}", r"\boxed{42.0}", 1.0), ("<answer>x</answer>", "x", 1.0), ("", "", 0.0), (r"<answer>2\sqrt{2}</answer>", r"\sqrt{8}", 1.0), (r"\boxed{1}", r"\boxed{2}", 0.0),
])
def test_math(spark, a, b, want):
    assert value(spark, rewards.accuracy(F.lit(a), F.lit(b))) == want


def test_length_rewards(spark):
    assert value(spark, rewards.repetition(F.lit("a b c a b c"))) == pytest.approx(-0.25)
    assert value(spark, rewards.repetition(F.lit("a b"))) == 0.0
    assert value(spark, rewards.soft_overlong(F.lit(3500), 4000, 1000)) == -0.5
    assert value(spark, rewards.cosine_length(F.lit(True), F.lit(0), 100)) == 1.0
    assert value(spark, rewards.cosine_length(F.lit(False), F.lit(100), 100)) == pytest.approx(0.0)


CALLS = {
    "hermes": '<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call>',
    "llama3": '{"name": "f", "parameters": {"x": 1}}<|eom_id|>',
    "mistral": '[TOOL_CALLS][{"name": "f", "arguments": {"x": 1}}]</s>',
    "glm4": 'f\n{"x": 1}',
    "glm4_5": "<tool_call>f\n<arg_key>x</arg_key>\n<arg_value>1</arg_value></tool_call>",
    "qwen3_coder": "<tool_call>\n<function=f>\n<parameter=x>\n1\n</parameter>\n</function>\n</tool_call>",
    "seed_oss": "<seed:tool_call><function=f><parameter=x>1</parameter></function></seed:tool_call>",
    "deepseek_v3_1": '<｜tool▁call▁begin｜>f<｜tool▁sep｜>{"x": 1}<｜tool▁call▁end｜>',
    "minimax_m2": '<minimax:tool_call><invoke name="f"><parameter name="x">1</parameter></invoke></minimax:tool_call>',
    "hunyuan_hermes": '<tool_call>f\n```json\n{"x": 1}\n```\n</tool_call>',
    "react_en": 'Action: f\nAction Input: {"x": 1}\nObservation: ok',
}


@pytest.mark.parametrize("key", sorted(CALLS))
def test_tool_calls(spark, key):
    got = value(spark, toolcall.PARSERS[key](F.lit(CALLS[key])))
    assert [(c.name, str(json.loads(c.arguments)["x"])) for c in got] == [("f", "1")]


def test_tool_fallback(spark):
    said = F.lit('Action: f\nAction Input: {"x": 1}')
    assert value(spark, toolcall.PARSERS["hermes"](said))[0].name == "f"
    assert value(spark, toolcall.PARSERS["mistral"](said)) == []


def test_geo(spark):
    d = value(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert d == pytest.approx(3.141592653589793 * 6371)
    assert value(spark, geo.reward_geoscore(F.lit(None).cast("double"))) == 0.0
    assert value(spark, geo.reward_geoscore(F.lit(2000.0))) == 0.0
    assert value(spark, geo.report_geoscore(F.lit(0.0))) == 5000.0


# --- statistics


def test_item_stats_zero_and_ties(spark):
    s = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 0.5)], "k int, r double")
    items = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    got = {r.k: r for r in stats.item_stats(s, "k", "r", items).collect()}
    assert (got[1].reward_std, got[3].num_samples, got[3].reward_mean) == (0.5, 0, 0.0)
    flat = stats.value_probability(spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, 0.0)], "k int, reward_mean double, reward_std double"))
    assert [r.probability for r in flat.collect()] == [0.5, 0.5]  # no variance: equal shares


def test_advantages_single_row_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 3.0), ("b", None)], "g string, r double")
    for est, scale in (("grpo", "group"), ("rloo", "none"), ("grpo", "batch"), ("reinforce_plus_plus", "group")):
        assert stats.advantages(df, "g", "r", est, scale).where("advantage IS NULL").count() == 0


def test_metrics(spark):
    got = metrics.rouge_bleu("a b c d".split(), "a b c d".split())
    assert got["rouge_l"] == 100 and got["bleu_4"] == pytest.approx(100)
    assert metrics.rouge_bleu([], ["a"])["bleu_4"] == 0
    km = spark.createDataFrame([(1.0,), (25.0,), (None,)], "d double")
    assert km.select(metrics.geo_accuracy_valid_only(F.col("d"), 25).alias("v")).first().v == 50.0
    rep = metrics.geo_report(spark.createDataFrame([(1, 1.0, None), (1, 25.0, "x"), (0, None, "x"), (-1, None, " ")], "status int, distance double, continent string"), ("continent",))
    by = {(r.group_kind, r.group_key): r for r in rep.collect()}
    assert by[("overall", "all")].acc_25km == 0.5 and by[("continent", "UNKNOWN")].rows == 2


def test_chat(spark):
    m = F.array(*[normalize.message(r, F.lit(c)) for r, c in (("user", "u"), ("assistant", "a"), ("user", "v"), ("assistant", "b"))])
    assert value(spark, chat.loss_spans(m)) == [0, 1, 0, 1]
    assert value(spark, chat.loss_spans(m, "last_round")) == [0, 0, 0, 1]
    assert value(spark, chat.loss_spans(m, "all")) == [1, 1, 1, 1]
    toks = F.sequence(F.lit(1), F.lit(7))
    assert value(spark, chat.split_chunks(toks, 3)) == [[1, 2, 3], [4, 5, 6], [7]]
    assert value(spark, chat.truncate(toks, 2, "left")) == [6, 7]


# --- streaming


def test_stream_split_needs_a_share(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    s = stream.read(spark, str(tmp_path / "in"), "id long")
    with pytest.raises(ValueError):
        stream.split(s, ["id"], None)


def test_largest_rows_both_ways(spark, monkeypatch):
    df = spark.range(500).select("id", F.when(F.col("id") % 11 != 0, F.col("id") * 37 % 50).alias("v"))
    want = sorted(((r.v is None, -(r.v or 0), r.id) for r in df.collect()))
    for few in (10_000, 0):
        monkeypatch.setattr(compose, "FEW", few)
        for k in (0, 7, 120, 470, 500, 900):
            got = compose.largest(df, F.col("v"), [F.col("id")], k).collect()
            assert len(got) == min(k, 500)
            assert {r.id for r in got} == {i for *_, i in want[:k]}


def test_rouge_n_shuffles_nothing(spark):
    d = spark.createDataFrame([(1, "a b a b c", "a b a"), (2, "", "a"), (3, None, "a b"), (4, "a", "a")], "k long, h string, r string")
    words = lambda c: F.array_remove(F.split(c, " "), "")
    out = metrics.rouge_n(d, "k", words(F.col("h")), words(F.col("r")), 2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.rouge_2 for r in out.collect()} == {1: pytest.approx(200 * 2 / 6), 2: 0, 3: 0, 4: 0}
