"""Rows in, messages out, for the dataset recipes."""

import pytest

from quillmark.operators.recipes import RECIPES


def out(df):
    return [[(m.role, m.content) for m in r.messages] for r in df.collect()]


CASES = [
    ("alpaca_zh", {}, "instruction string, input string, output string", [("a", "输入：b", "c")], [[("user", "a\nb"), ("assistant", "c")]]),
    ("long_alpaca", {}, "instruction string, input string, output string", [("a", "", "Answer: c ")], [[("user", "a"), ("assistant", "c")]]),
    ("numbered_titles", {}, "title string, abs string", [("12.why", None), ("t", "u"), ("", None)], [[("assistant", "why")], [("assistant", "t，u")]]),
    ("by_kind", {"kinds": ["x"]}, "kind string, input string, target string", [("x", "a", "b"), ("y", "a", "b")], [[("user", "a"), ("assistant", "b")]]),
    ("answer_appended", {}, "input string, output string, answer string", [("q", "r", "4")], [[("user", "q"), ("assistant", "r\n\nAnswer: 4")]]),
    ("chosen_rejected", {}, "chosen string, rejected string", [("\n\nHuman: a\n\nAssistant: b", "\n\nHuman: a\n\nAssistant: c")], [[("user", "a"), ("assistant", "b")]]),
    ("marked_dialogue", {}, "instruction string, input string, output string",
     [("User: a\nAssistant: b", "User: c", "d"), ("Assistant: a User: b", "c", "d"), ("", "c", "d")],
     [[("user", " a\n"), ("assistant", " b"), ("user", "c"), ("assistant", "d")], [("user", "c"), ("assistant", "d")]]),
    ("with_context", {"lead": "L:"}, "instruction string, context string, response string", [("i", "c", "r"), ("i", "", "r")], [[("user", "L:c\ni"), ("assistant", "r")], [("user", "i"), ("assistant", "r")]]),
    ("separated_question", {}, "text1 string, text2 string", [("a [SEP] b", "q"), ("a", "q")], [[("user", "Answer: a\nContext: b"), ("assistant", "q")]]),
    ("class_prompt", {"labels": ["no", "yes"], "task": "t"}, "sentence string, label int", [("s", 1), ("s", None)], [[("user", "Task: t\nSentence: s\nCategory: no, yes\nOutput:"), ("assistant", "yes")]]),
    ("self_cognition", {"name": ("小", "Q"), "author": ("人", "A")}, "query string, response string, tag string", [("who", "{{NAME}} by {{AUTHOR}}", "en")], [[("user", "who"), ("assistant", "Q by A")]]),
    ("choice_answer", {}, "question string, choices array<string>, answer int", [("q", ["a", "b"], 1)], [[("user", "q"), ("assistant", "b")]]),
    ("prompt_template", {"prompt": "do {{QUERY}}!"}, "query string, response string", [("x", "y")], [[("user", "do x!"), ("assistant", "y")]]),
]


@pytest.mark.parametrize(("name", "options", "schema", "rows", "want"), CASES, ids=[c[0] for c in CASES])
def test_recipe(spark, name, options, schema, rows, want):
    assert out(RECIPES[name](spark.createDataFrame(rows, schema), **options)) == want


def test_two_rows_from_one(spark):
    df = spark.createDataFrame([("q", ["h"], ["c"])], "question string, human_answers array<string>, chatgpt_answers array<string>")
    got = RECIPES["human_or_machine"](df).collect()
    assert [(r.label, r.messages[1].content) for r in got] == [(0, "Human"), (1, "ChatGPT")]


def test_existing_media(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"])], "id int, images array<string>")
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.id for r in RECIPES["existing_media"](df, files).collect()] == [1]


def test_labels_and_calls(spark):
    assert RECIPES["multi_label"](spark.createDataFrame([([0, 1, 1],)], "npy array<int>")).first().label == [1, 2]
    df = spark.createDataFrame([("q", '[{"name": "f", "arguments": {"x": "1"}}]')], "query string, answers string")
    assert out(RECIPES["function_answers"](df)) == [[("user", "q"), ("tool_call", '{"name":"f","arguments":{"x":"1"}}')]]
