"""Agent prompts: lengths and texts of the formats, calls that parse back, lenient JSON, formulas."""

import json

import pytest
from pyspark.sql import functions as F

from quillmark.functions import agents, formulas, jsons, rewards, toolcall

SYSTEM = "You are a helpful assistant."
TOOLS = [
    {"type": "function", "function": {
        "name": "get_current_weather", "description": "Get the current weather in a given location",
        "parameters": {"type": "object", "properties": {
            "location": {"type": "string", "description": "The city and state, e.g. San Francisco, CA"}, "unit": {"type": "string", "enum": ["celsius", "fahrenheit"]}}, "required": ["location"]}}},
    {"name_for_model": "tool2", "name_for_human": "工具2", "description": "Tool2的描述"},
]
#: Lengths that the formats' own tests expect of these tools. Fixed values.
LENGTHS = {
    "react_en": 1144, "react_zh": 712, "qwen_en": 879, "qwen_zh": 577, "qwen_en_parallel": 1012, "qwen_zh_parallel": 688, "hermes": 875,
    "toolbench": 1833, "chatglm4": 846, "glm4": 769, "youtu": 883,
}


@pytest.fixture(scope="module")
def offered(spark):
    df = spark.createDataFrame([([json.dumps(t, ensure_ascii=False) for t in TOOLS], SYSTEM)], "tools array<string>, system string")
    df = df.withColumn("read", agents.read_tools("tools"))
    return df.select(*[agents.system_prompt(k, F.col("read"), F.col("system")).alias(k) for k in agents.FAMILIES], *[agents.system_prompt(k, F.col("read")).alias(f"{k}_bare") for k in agents.FAMILIES]).first()


@pytest.mark.parametrize("family", LENGTHS)
def test_prompt_lengths(offered, family):
    assert len(offered[family]) == LENGTHS[family]


def test_prompt_texts(offered):
    wrapped = json.dumps(TOOLS[0], ensure_ascii=False)
    assert offered["mistral"].startswith(f"{SYSTEM}[AVAILABLE_TOOLS]{wrapped} ") and offered["mistral_bare"].startswith("[AVAILABLE_TOOLS]")
    assert json.dumps(TOOLS[0], ensure_ascii=False, indent=4) in offered["llama3"] and offered["llama3"] == offered["llama4"]
    assert offered["glm4_5"].endswith(f"</tool_call><|system|>\n{SYSTEM}") and offered["glm4_7_bare"].startswith("\n# Tools")
    assert '<parameter>\n<name>unit</name>\n<type>string</type>\n<enum>["celsius", "fahrenheit"]</enum>\n</parameter>\n<required>["location"]</required>\n</parameters>\n</function>' in offered["qwen3_coder"]
    assert offered["qwen3_coder_bare"].startswith("You are Qwen,") and offered["qwen3_5"].endswith(SYSTEM)
    assert "def get_current_weather(location: str,unit: str):" in offered["seed_oss"] and "- location (str) [必填]: The city and state" in offered["seed_oss"]
    assert offered["deepseek_v3_1"].count("### ") == 2 and f"<tool>{json.dumps(TOOLS[0]['function'], ensure_ascii=False)}</tool>" in offered["minimax_m2"]


CALLS = [
    {"name": "weather", "arguments": {"zone": "b", "city": "São Paulo, \"SP\"", "days": 3}}, {"name": "other", "arguments": {"list": [1, {"x": None}], "ok": True}}, {"name": "none", "arguments": {}},
]


@pytest.mark.parametrize("family", agents.FAMILIES)
@pytest.mark.parametrize("n", [1, 2])
def test_calls_parse_back(spark, family, n):
    df = spark.createDataFrame([([json.dumps(c) for c in CALLS[:n]],)], "calls array<string>")
    text = df.select(agents.tool_calls(family, agents.read_calls("calls")).alias("t"))
    got = text.select(toolcall.PARSERS[family](F.col("t")).alias("c")).first().c
    assert [c.name.strip() for c in got] == [c["name"] for c in CALLS[:n]]
    texts = family in ("glm4_5", "glm4_7", "qwen3_coder", "qwen3_5", "seed_oss")  # these formats keep no kinds
    for c, want in zip(got, CALLS, strict=False):
        have = jsons.read(c.arguments, False)
        plain = {k: v if isinstance(v, str) else json.dumps(v) if family == "seed_oss" or isinstance(v, (list, dict)) and family.startswith("qwen3") else str(v) for k, v in want["arguments"].items()}
        assert have == (plain if texts else want["arguments"])


def test_calls_read_parameters_and_literals(spark):
    df = spark.createDataFrame([(["{'name': 'f', 'parameters': \"{'a': None}\"}", "no call", '{"name": "g"}'],), (None,), ([],)], "calls array<string>")
    got = [r.t for r in df.select(agents.tool_calls("hermes", agents.read_calls("calls")).alias("t")).collect()]
    assert got == ['<tool_call>\n{"name": "f", "arguments": {"a": null}}\n</tool_call>', None, ""]


def test_responses(spark):
    df = spark.createDataFrame([("Action: f\nAction Input: {}", ["1", "2\n"]), ("said", ["1", "2"])], "said string, r array<string>")
    got = df.select(*[agents.tool_responses(k, F.col("said"), F.col("r")).alias(k) for k in ("react_en", "hermes", "glm4", "minimax_m2")]).collect()
    assert got[0].react_en == got[0].hermes == "\nObservation:1\nObservation:2\n" and got[1].react_en == "12"
    assert got[1].hermes == "<|im_end|>\n<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n<|im_start|>assistant\n"
    assert got[1].glm4 == "\n1<|observation|>\n2<|assistant|>\n" and got[1].minimax_m2 == "[e~[\n]~b]tool\n<response>1</response>\n<response>2</response>[e~[\n"


REPAIRS = [
    ('{"a": 1, "b": [1, 2', {"a": 1, "b": [1, 2]}), ("{'a': 'its', 'b': None", {"a": "its", "b": None}), ('{"a": 1 "b": 2}', {"a": 1, "b": 2}), ("{a: 1, b: x y}", {"a": 1, "b": "x y"}),
    ('{"a": "say "hi" now", "b": 2}', {"a": 'say "hi" now', "b": 2}), ('[1, 2,, 3,]', [1, 2, 3]), ('text before {"a": true} after', {"a": True}), ("{“a”: “b”}", {"a": "b"}),
    ('{"a": {"b": [1, {"c": "d"', {"a": {"b": [1, {"c": "d"}]}}), ('{"a": , "b": 1}', {"a": None, "b": 1}), ('{"k": "\\u00e9\\n"', {"k": "é\n"}), ('{"a": 1]', {"a": 1}),
]


@pytest.mark.parametrize("text,want", REPAIRS)
def test_repair(text, want):
    assert jsons.read(text, True) == want


def test_written_json(spark):
    rows = ['{"b":1,"a":[1,2.5,"é"]}', "{'b': (1, 2), 'a': True}", '{"b": 1', "no", None, "", "[" * 100_000]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(jsons.parse_json(F.col("t")).alias("p"), jsons.repair_json(F.col("t")).alias("r")).collect()
    assert [r.p for r in got] == ['{"b": 1, "a": [1, 2.5, "é"]}', '{"b": [1, 2], "a": true}', None, None, None, None, None]
    assert [r.r for r in got[:6]] == ['{"b": 1, "a": [1, 2.5, "é"]}', '{"b": [1, 2], "a": true}', '{"b": 1}', None, None, None]


def test_llama_end_goes_before_the_fallback(spark):
    said = 'Action: f\nAction Input: {"a": 1}'
    df = spark.createDataFrame([(said + "<|eom_id|>", said + "<|eom|>")], "a string, b string")
    r = df.select(toolcall.PARSERS["llama3"](F.col("a")).alias("a"), toolcall.PARSERS["llama4"](F.col("b")).alias("b")).first()
    assert [tuple(x) for x in r.a] == [tuple(x) for x in r.b] == [("f", '{"a": 1}')]


def test_seed_values_stay_whole(spark):
    df = spark.createDataFrame([("<seed:tool_call><function=f><parameter=a> 1 </parameter>\n<parameter= b >x</parameter></function></seed:tool_call>",)], "t string")
    (call,) = df.select(toolcall.PARSERS["seed_oss"](F.col("t")).alias("c")).first().c
    assert json.loads(call.arguments) == {"a": " 1 ", " b ": "x"}


def test_calls_as_literals(spark):
    df = spark.createDataFrame([("<tool_call>{'name': 'f', 'arguments': {'b': None, 'a': True}}</tool_call>",)], "t string")
    (call,) = df.select(toolcall.PARSERS["hermes"](F.col("t")).alias("c")).first().c
    assert (call.name, json.loads(call.arguments)) == ("f", {"b": None, "a": True})


REFUSALS = [
    ("there are no any identifiable features", 1.0), ("there are no identifiable geographic features", 0.0), ("it lacks any identifiable place", 0.0), ("I can't quite déjà vu identify it", 0.0),
    ("cannot be determined", 0.0), ("impossible to pinpoint", 0.0), ("hard to really exactly geolocate", 0.0), ("insufficient visual clues", 0.0), ("not enough context", 0.0),
    ('<answer>{"FinalAnswer": "N/A"}</answer>', 0.0), ('<answer>{"FinalAnswer": "generic, x"}</answer>', 0.0), ('<answer>{"FinalAnswer": "Paris, France"}</answer>', 1.0), ("unclear", 1.0),
]


def test_refusals(spark):
    df = spark.createDataFrame(REFUSALS, "t string, want double")
    assert df.where(rewards.geo_no_unknown(F.col("t")) != F.col("want")).collect() == []


EQUAL = [
    ("\\frac{1}{2}", "0.5"), ("\\sqrt{8}", "2\\sqrt{2}"), ("1/\\sqrt{2}", "\\frac{\\sqrt2}{2}"), ("(x+1)^2", "x^2+2x+1"), ("x=5", "5"), ("1,000", "1000"), ("\\{1,2\\}", "\\{2,1\\}"),
    ("50\\%", "1/2"), ("\\frac12", "1/2"), ("3\\frac{1}{2}", "3.5"), ("e^{x}e", "e^{x+1}"), ("\\sin^2 x+\\cos^2 x", "1"), ("\\frac{x^2-1}{x-1}", "x+1"), ("x<3", "3>x"), ("\\log_2 8", "3"),
    ("5!", "120"), ("|{-3}|", "3"), ("y=2x+1", "2x+1=y"), ("\\sqrt[3]{-8}", "-2"), ("x \\ge 2", "2 \\leq x"), ("sqrt(12)", "2sqrt(3)"), ("-x^2", "-(x^2)"), ("10^{20}", "100000000000000000000"),
]
UNEQUAL = [("1/3", "0.333"), ("x+1", "x+2"), ("(1,2)", "(2,1)"), ("\\sqrt2", "1.414"), ("x<3", "x>3"), ("", ""), ("[0,1)", "(0,1]"), ("\\text{yes}", "\\text{no}"), ("x^2", "x^3"), ("\\frac{", "1"), ("9" * 30 + "!", "1")]


@pytest.mark.parametrize("a,b", EQUAL)
def test_equal_formulas(a, b):
    assert formulas.equal(a, b) and formulas.equal(b, a)


@pytest.mark.parametrize("a,b", UNEQUAL)
def test_unequal_formulas(a, b):
    assert not formulas.equal(a, b) and not formulas.equal(b, a)


ANSWERS = [
    ("The answer is \\boxed{42}", "\\boxed{42}", 1.0), ("After careful calculation, the final answer is \\boxed{100}", "\\boxed{100}", 1.0),
    ("Step 1: x = 2\n2. y = 3x = 6\n\nFinal answer: \\boxed{8}", "\\boxed{8}", 1.0), ("The answer is \\boxed{42}", "\\boxed{100}", 0.0), ("<answer>84</answer>", "\\boxed{84}", 1.0),
    ("<answer>\\boxed{100}</answer>", "\\boxed{100}", 1.0), ("Sum = 30\n<answer>54</answer>", "\\boxed{54}", 1.0), ("<answer>\\frac{1}{2}</answer>", "\\boxed{\\frac{1}{2}}", 1.0),
    ("<answer>84</answer>", "<answer>\\boxed{84}</answer>", 1.0), ("<answer>42</answer>", "\\boxed{100}", 0.0), ("no answer 84", "84", 0.0), (None, "1", 0.0), ("<answer>1</answer>", None, 0.0), ("\\boxed{1", "1", 0.0),
]


def test_accuracy(spark):
    df = spark.createDataFrame(ANSWERS, "c string, s string, want double")
    assert df.where(formulas.accuracy(F.col("c"), F.col("s")) != F.col("want")).collect() == []


def test_math_answers(spark):
    rows = [("work # Answer \\boxed{\\frac{2}{4}}", "# Answer 1/2", 1.0), ("x^2-1", "(x-1)(x+1)", 1.0), ("5", "6", 0.0), ("a b", "ab", 1.0), ("", "1", 0.0)]
    df = spark.createDataFrame(rows, "c string, s string, want double")
    assert df.where(formulas.math_answer(F.col("c"), F.col("s")) != F.col("want")).collect() == []
