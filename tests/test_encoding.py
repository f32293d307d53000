"""Templates, loss weights, truncation and encodings of tasks on small rows."""

import os

import pytest
from pyspark.sql import functions as F

from quillmark.functions import rewards
from quillmark.operators import compose, encode, metrics, normalize, templates
from quillmark.scratch import Scratch

SCHEMA = f"messages {normalize.MESSAGES}"


def pieces(spark, messages, template="chatml", loss="default", **more):
    rows = None if messages is None else [(r, c, w[0] if w else None) for r, c, *w in messages]
    d = templates.with_pieces(spark.createDataFrame([(rows,)], SCHEMA), template, loss, **more)
    p = d.first()["pieces"]
    return None if p is None else [(x["text"], x["weight"]) for x in p]


def text(*args, **more):
    return "".join(t for t, _ in pieces(*args, **more))


def test_rounds_of_a_template(spark):
    m = [("system", "S"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert text(spark, m, "llama3") == (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|><|start_header_id|>user<|end_header_id|>\n\na<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
        "b<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nc<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nd<|eot_id|>")
    assert text(spark, m, "skywork") == "<s>S</s><s>[USER]c[SEP][BOT]d[SEP]</s>"
    assert text(spark, m[1:], "orion", default_system="D") == "<s>DHuman: a\n\nAssistant: </s>b</s>Human: c\n\nAssistant: </s>d</s>"
    assert text(spark, [("system", ""), *m[1:3]], "zephyr") == "<|user|>\na</s>\n<|assistant|>\nb</s>"


def test_tool_turns_stop_words_and_open_ends(spark):
    m = [("user", "a"), ("assistant", "call"), ("tool", "<|observation|>\nx<|assistant|>\n"), ("assistant", "b<|user|>")]
    assert text(spark, m, "chatglm4") == "<|user|>\na<|assistant|>\ncall<|observation|>\nx<|assistant|>\nb<|user|>"
    assert text(spark, [("user", "a")], "chatml") == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n"
    assert text(spark, [("user", "a"), ("assistant", "b"), ("user", "c")], "skywork") == "<s></s><s>[USER]c[SEP][BOT]"


def test_nulls_and_nothing(spark):
    assert pieces(spark, None) is None
    assert pieces(spark, []) == []
    assert pieces(spark, [], "llama3") == [("<|begin_of_text|>", 0.0)]
    assert text(spark, [("user", None), ("assistant", None)], "sus") == "### Human: \n\n### Assistant: <|endoftext|>"


def test_own_loss_goes_before_the_strategy(spark):
    m = [("user", "a"), ("assistant", "b", 0.0), ("user", "c"), ("assistant", "d")]
    weights = lambda loss, m=m: [w for t, w in pieces(spark, m, "sus", loss) if t in ("b", "d")]
    assert weights("default") == [0, 1] and weights("all") == [0, 1] and weights("last_round") == [0, 1]
    assert weights("last_round", [("user", "a"), ("assistant", "b", 1.0), ("user", "c"), ("assistant", "d", 0.0)]) == [1, 0]


@pytest.mark.parametrize(("kind", "said", "want"), [
    ("react", "Action: x", [("Action:", 2), (" x", 2)]),
    ("react", "none", [("none", 1)]),
    ("react", "Observation:", [("Observation:", 2)]),
    ("alpha_umi", "Next: Observation: o", [("Next: ", 1), ("Observation:", 2), (" o", 0)]),
    ("hermes", "<tool_call>a\nb</tool_call><tool_call>c</tool_call>", [("<tool_call>a\nb</tool_call>", 2), ("<tool_call>c</tool_call>", 2)]),
    ("hermes", "<tool_call></tool_call>", [("<tool_call></tool_call>", 1)]),
    ("ignore_empty_think", "</think>\n\na <think></think>", [("</think>\n\n", 0), ("a <think></think>", 1)]),
    ("ignore_empty_think", "<think>x</think>", [("<think>x</think>", 1)]),
])
def test_weighted_pieces(spark, kind, said, want):
    got = spark.range(1).select(templates.weighted(F.lit(said), kind).alias("p")).first()["p"]
    assert [(x["text"], x["weight"]) for x in got if x["text"]] == want


def test_query_rules_and_specifications(spark):
    got = spark.range(1).select(templates.weighted(F.lit("Action: x"), "agentflan", F.lit("now What is the value of y")).alias("p")).first()["p"]
    assert [(x["text"], x["weight"]) for x in got] == [("Action: x", 3.0)]
    assert templates.parse_loss("react") == ("default", "react") and templates.parse_loss("last_round+qwen") == ("last_round", "qwen") and templates.parse_loss("all") == ("all", "base")
    assert templates.is_binary("default") and templates.is_binary("ignore_empty_think") and not templates.is_binary("all+react") and not templates.is_binary("agentflan")
    for wrong in ("none", "default+none", "some+react"):
        with pytest.raises(ValueError):
            templates.parse_loss(wrong)


def cut(spark, ids, n, strategy, protected=()):
    d = spark.createDataFrame([(ids, ids, None if ids is None else [1.0] * len(ids))], "input_ids array<int>, labels array<int>, loss_scale array<double>")
    return [tuple(r) for r in encode.truncated(d, n, strategy, protected).collect()]


def by_hand(ids, n, side, protected):
    if len(ids) <= n:
        return ids
    free = [i for i, t in enumerate(ids) if t not in protected]
    room = n - (len(ids) - len(free))
    kept = set() if room <= 0 else set(free[-room:] if side == "left" else free[:room])
    return [t for i, t in enumerate(ids) if t in protected or i in kept]


def test_truncation_keeps_protected_tokens(spark):
    assert cut(spark, [1, 2, 3], 3, "right") == [([1, 2, 3], [1, 2, 3], [1.0, 1.0, 1.0])]
    assert cut(spark, [9, 2, 3, 4], 2, "left", (9,)) == [([9, 4], [-100, 4], [0.0, 1.0])]
    assert cut(spark, [], 2, "left") == [([], [], [])] and cut(spark, None, 2, "right") == [(None, None, None)]
    for ids in ([9, 9, 9, 1], [1, 9, 2, 9, 3, 4], [1, 2, 3, 4, 5], [9, 1, 1, 9, 1]):
        for side in ("left", "right"):
            for n in (1, 2, 3, 4):
                for protected in ((), (9,), (1, 9)):
                    assert cut(spark, ids, n, side, protected)[0][0] == by_hand(ids, n, side, protected), (ids, side, n, protected)


def test_truncation_splits_deletes_and_refuses(spark):
    assert cut(spark, [1, 2, 3, 4, 5], 2, "split") == [([1, 2], [-100, 2], [0.0, 1.0]), ([3, 4], [-100, 4], [0.0, 1.0]), ([5], [-100], [0.0])]
    assert cut(spark, [1, 2], 2, "split") == [([1, 2], [1, 2], [1.0, 1.0])] and cut(spark, None, 2, "split") == [(None, None, None)]
    assert cut(spark, [1, 2, 3], 2, "delete") == [] and cut(spark, None, 2, "delete") == [(None, None, None)]
    with pytest.raises(Exception, match="longer than 2"):
        cut(spark, [1, 2, 3], 2, "raise")
    with pytest.raises(ValueError):
        cut(spark, [1], 2, "middle")


def test_dispatch(spark):
    m = [("user", "a", None), ("assistant", "b", None)]
    d = spark.createDataFrame([(m, "no", "1", 0.5)], SCHEMA + ", rejected_response string, label string, margin double")
    train = encode.dispatch(d, template="sus").first()
    assert bytes(train["input_ids"]).decode() == "### Human: a\n\n### Assistant: b<|endoftext|>"
    assert [t for t in train["labels"] if t != -100] == list(b"b<|endoftext|>") and "loss_scale" not in train
    assert "loss_scale" in encode.dispatch(d, loss="react").columns
    assert bytes(encode.dispatch(d, training=False, template="sus").first()["input_ids"]).decode() == "### Human: a\n\n### Assistant: "
    r = encode.dispatch(d, mode="rlhf").first()
    assert (r["chosen_input_ids"], r["rejected_input_ids"], r["margin"]) == (["a", "b"], ["a", "no"], 0.5)
    assert encode.dispatch(d, mode="kto").first()["label"] is True
    assert encode.dispatch(d.drop("rejected_response"), mode="kto").first()["rejected_input_ids"] is None
    assert encode.dispatch(d, task="seq_cls").first()["labels"] == 1
    assert encode.dispatch(d, task="embedding", training=False).first()["input_ids"] == ["a", "b"]
    assert encode.dispatch(d.limit(0)).collect() == []
    with pytest.raises(ValueError):
        encode.dispatch(d, task="none")


def test_rejected_messages_and_classes(spark):
    d = spark.sql("SELECT array(struct('user' AS role, 'q' AS content)) AS messages, CAST(NULL AS array<struct<human:string,gpt:string>>) AS rejected_messages")
    assert normalize.normalize(d).first()["rejected_messages"] is None
    c = spark.createDataFrame([("q", "2"), ("q", "x"), ("q", None)], "query string, label string")
    assert [r["label"] for r in normalize.classes(c).collect()] == [2]


@pytest.mark.parametrize(("n", "k"), [(10, 3), (2, 5), (7, 7), (0, 3)])
def test_list_split(spark, n, k):
    got = sorted((r["id"], r["shard"]) for r in compose.list_split(spark.range(n), k, [F.col("id")]).collect())
    edges = [int(n * i / k) for i in range(k + 1)]
    assert got == [(r, s) for s in range(k) for r in range(edges[s], edges[s + 1])]


def test_label_correlations_with_ties_and_nulls(spark):
    rows = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (5.0, 4.0), (None, 3.0), (3.0, None)]
    got = metrics.label_correlations(spark.createDataFrame(rows, "s double, y double"), ["s"], "y").first()
    x, y = [1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4]
    mx, my = sum(x) / 4, sum(y) / 4
    want = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert got["name"] == "s" and abs(got["spearman"] - want) < 1e-12


def test_dispatch_lengths_channels_and_modes(spark):
    m = normalize.message
    row = spark.range(1).select(
        F.array(m("user", F.lit("a b")), m("assistant", F.lit("c"))).alias("messages"), F.array(F.array(m("assistant", F.lit("p")))).alias("positive_messages"),
        F.array(F.array(m("assistant", F.lit("n")), m("assistant", F.lit("o")))).alias("negative_messages"), F.lit("x y").alias("rejected_response"), F.lit("web").alias("channel"), F.lit(1).alias("label"))
    assert encode.dispatch(row, mode="vllm", return_lengths=True).first()["channel"] == "web"
    assert encode.dispatch(row, mode="rlhf", return_lengths=True).first().asDict() | {} == {
        "chosen_input_ids": ["a", "b", "c"], "rejected_input_ids": ["a", "b", "x", "y"], "channel": "web", "lengths": [3, 4]}
    kto = encode.dispatch(row.withColumn("rejected_response", F.lit(None).cast("string")), mode="kto", return_lengths=True).first()
    assert (kto.lengths, kto.channel) == ([3], "web")
    assert encode.dispatch(row, task="embedding", return_lengths=True).first().lengths == [3, 1, 2]
    assert [(r.lengths, r.channel) for r in encode.dispatch(row, task="reranker", return_lengths=True).orderBy("position").collect()] == [([4], "web"), ([5], "web")]
    assert encode.dispatch(row, task="seq_cls", return_lengths=True).first().channel == "web"
    with pytest.raises(ValueError):
        encode.dispatch(row, mode="unknown")


def test_registered_rewards(spark):
    rewards.register("long", lambda c, least=3: F.when(c.isNotNull(), (F.length(c) >= least).cast("double")))
    try:
        df = spark.createDataFrame([("<think>a</think><answer>b</answer>",), ("ab",), (None,)], "c string")
        got = rewards.scored(df, "c", {"long": {"least": 3}, "format": {}}, {"long": 2.0}).collect()
        assert [(r.reward_long, r.reward_format, r.reward) for r in got] == [(1.0, 1.0, 3.0), (0.0, 0.0, 0.0), (None, 0.0, 0.0)]
        assert [r.reward for r in rewards.scored(df, "c", {"long": {}}).collect()] == [1.0, 0.0, None]
        with pytest.raises(ValueError):
            rewards.register("long", rewards.format_ok)
        with pytest.raises(ValueError):
            rewards.scored(df, "c", {"none": {}})
    finally:
        del rewards.REWARDS["long"]


def test_cleared_scratch(spark):
    scratch = Scratch(spark)
    kept = scratch.save(spark.range(3))
    path = scratch._paths[id(kept)][1]
    assert kept.count() == 3
    Scratch(spark).clear()
    assert path not in Scratch._made and not os.path.exists(path.removeprefix("file://"))


def test_truncations_carry_no_whole_rows(spark):
    """Parts are cut before they are exploded; both cuts of the protected query come from one pass, without a join."""
    from quillmark.plans import catalogue, encoding  # noqa: F401  (it registers its queries)

    d = spark.createDataFrame([(1, list(range(7)))], "k int, input_ids array<int>")
    plan = encode.truncated(d, 3, "split")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(CASE" in plan and "struct" in plan
    assert [r.input_ids for r in encode.truncated(d, 3, "split").collect()] == [[0, 1, 2], [3, 4, 5], [6]]
    plan = catalogue.QUERIES["protected_truncation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
