"""Encodings, selection runs and spans."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import geo, spans
from quillmark.operators import encode, metrics, normalize, runs

MSG = "array<struct<role:string,content:string,loss:double>>"


def msg(*turns):
    return [(r, c, None) for r, c in turns]


@pytest.mark.parametrize(("said", "delimiters", "regex", "want"), [
    ("abc<x>d<y>", ["<x>", "<y>"], False, [("", "abc"), ("<x>", "d"), ("<y>", "")]),
    ("Action: f\nInput: g", ["Action:", "Input:"], False, [("Action:", " f\n"), ("Input:", " g")]),
    ("a<t>1</t>b", ["<t>.*?</t>"], True, [("", "a"), ("<t>.*?</t>", "<t>1</t>"), ("", "b")]),
    ("plain", ["zz"], False, [("", "plain")]),
    ("", ["a"], False, []),
])
def test_split_parts(said, delimiters, regex, want):
    assert [(p["key"], p["content"]) for p in spans.split_parts(said, delimiters, regex)] == want


@given(st.text("ab<>", max_size=30))
def test_split_is_lossless(said):
    assert "".join(p["key"] + p["content"] for p in spans.split_parts(said, ["<a>", "<b>", "<"])) == said
    assert "".join(p["content"] for p in spans.split_parts(said, ["<a>", "b+"], True)) == said


def test_span_columns(spark):
    df = spark.createDataFrame([("x Action: f",), (None,)], "t string")
    got = df.select(spans.span_weights(spans.split_column(F.col("t"), ["Action:"]), {"Action:": (2, 3)}).alias("w")).collect()
    assert [(x.text, x.weight) for x in got[0].w] == [("x ", 1.0), ("Action:", 2.0), (" f", 3.0)] and got[1].w is None
    one = spark.range(1)
    assert one.select(spans.sub_positions(F.array(*[F.lit(x) for x in (1, 2, 1, 2, 1)]), [1, 2, 1])).first()[0] == [0, 2]
    assert one.select(spans.fill_placeholders(F.lit("a<b>c<b>d<b>"), "<b>", F.array(F.lit("1"), F.lit("2")))).first()[0] == "a1c2d<b>"


def test_encodings(spark):
    df = spark.createDataFrame([(msg(("user", "a b"), ("assistant", "c")), "d e", 0.5)], f"messages {MSG}, rejected_response string, margin double")
    r = encode.rlhf(df).first()
    assert (r.chosen_input_ids, r.rejected_input_ids, r.margin) == (["a", "b", "c"], ["a", "b", "d", "e"], 0.5)
    df = spark.createDataFrame([(msg(("user", "q")), [msg(("assistant", "p"))], [msg(("assistant", "n")), msg(("assistant", "m"))])], f"messages {MSG}, positive_messages array<{MSG}>, negative_messages array<{MSG}>")
    assert [(r.input_ids, r.label) for r in encode.rerank(df).orderBy("position").collect()] == [(["q", "p"], 1), (["q", "n"], 0), (["q", "m"], 0)]
    e = encode.embedding(df).first()
    assert (e.anchor_input_ids, e.positive_input_ids, e.labels) == (["q"], ["p"], [1.0, 0.0, 0.0])
    packed = encode.pack_rows(spark.createDataFrame([(0, 1, ["a", "b"]), (0, 0, ["c"])], "bin int, o int, input_ids array<string>"), ["bin"], "o").first()
    assert (packed.input_ids, packed.position_ids, packed.lengths) == (["c", "a", "b"], [0, 0, 1], [1, 2])
    batches = encode.length_batches(spark.range(25).withColumn("n", F.col("id") % 5), "n", ("id",), 4, drop_last=True)
    assert batches.count() == 24


def test_boxes_and_media(spark):
    boxes = F.array(F.array(F.lit(5), F.lit(1), F.lit(2), F.lit(9)), F.array(F.lit(1), F.lit(2)))
    one = spark.range(1)
    assert one.select(normalize.ordered_boxes(boxes)).first()[0] == [[2, 1, 5, 9], [1, 2]]
    assert one.select(normalize.valid_boxes(F.array(F.array(F.lit(1))))).first()[0] is False
    df = spark.createDataFrame([("x.jpg",)], "image string")
    assert df.select(normalize.images(F.col("image"), df.schema["image"].dataType).alias("i")).first().i[0].path == "x.jpg"


def test_selection_run(spark, tmp_path):
    images = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "image_path string")
    notes = spark.createDataFrame([("a.jpg", "old", 1.0, 2.0, 1), ("a.jpg", "new", 1.0, 2.0, 2)], "image_path string, gt_text string, gt_latitude double, gt_longitude double, ord int")
    side = spark.createDataFrame([("b.jpg", None, 3.0, 4.0), ("c.jpg", None, 3.0, None)], "image_path string, gt_text string, gt_latitude double, gt_longitude double")
    items = runs.build_items(images, notes, side)
    got = {r.image_path: r for r in items.collect()}
    assert set(got) == {"a.jpg", "b.jpg"} and got["a.jpg"].gt_text == "new"
    said = runs.expand_samples(items, 2).withColumn("raw_output", F.when(F.col("image_path") == "b.jpg", "none").otherwise(F.concat(F.lit("("), (F.col("sample_index") + 1).cast("string"), F.lit(", 2)"))))
    scored = runs.latlon_reward(said)
    assert {r.error for r in scored.where("image_path = 'b.jpg'").collect()} == {"missing_latlon"}
    picked = runs.select_run(scored, items, 1)
    assert picked.where("selected").count() == 1 and abs(sum(r.probability for r in picked.collect()) - 1) < 1e-9
    assert runs.packaged(picked).count() == 1 and runs.packaged(picked.withColumn("selected", F.lit(False))).count() == 2
    flipped = picked.withColumn("selected", ~F.col("selected"))
    assert {r.change for r in runs.run_changes(picked, flipped).collect()} == {"newly_selected", "dropped"}
    runs.write_run(str(tmp_path), samples=scored.withColumn("model_name", F.lit("m")), image_stats=picked)
    assert spark.read.json(f"{tmp_path}/samples").count() == 4
    assert runs.viewed(items, "A.JPG".lower()).count() <= 2
    assert runs.allocate(7, 3) == [3, 2, 2]


def test_geocode_reward(spark):
    s = spark.createDataFrame([("a", 0, "<answer>Paris; Mars</answer>", 48.9, 2.3), ("b", 0, "?", 0.0, 0.0), ("c", 0, "<answer>Nowhere</answer>", 0.0, 0.0)], "item_id string, sample_index int, raw_output string, gt_latitude double, gt_longitude double")
    cache = spark.createDataFrame([("paris", 48.9, 2.3, 9.0)], "key string, latitude double, longitude double, confidence double")
    got = {r.item_id: (r.reward, r.error) for r in runs.geocode_reward(s, cache).collect()}
    assert got == {"a": (1.0, None), "b": (0.0, "missing_answer"), "c": (0.0, "pred_geocode_failed")}


def test_common_fields(spark):
    got = runs.common_fields(spark.createDataFrame([("p", "t", "1.5", "x")], "path string, answer string, lat string, lng string")).first()
    assert (got.image_path, got.gt_text, got.gt_latitude, got.gt_longitude) == ("p", "t", 1.5, None)


def test_token_accuracy_and_losses(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [-100, 1, 2, 9])], "p array<int>, l array<int>")
    assert tuple(metrics.token_accuracy(df, "p", "l").first()) == (pytest.approx(2 / 3), 0.0)
    pairs = spark.createDataFrame([(1.0, 1.0), (0.2, 0.0)], "s double, y double")
    assert metrics.contrastive(pairs, "s", "y").first().loss == 0.0
    best = metrics.best_runs(spark.createDataFrame([("a", 0.5), ("a", 0.7)], "g string, m double"), "m", "g")
    assert [r.best for r in best.orderBy("m").collect()] == [False, True]


@pytest.mark.parametrize(("p", "km"), [
    ((0, 0, 0, 1), 111.319491), ((0, 0, 1, 0), 110.574389), ((-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777), 54.972271),
    ((48.8566, 2.3522, 51.5074, -0.1278), 343.923), ((10, 20, 10, 20), 0.0), ((90, 0, -90, 0), 20003.931459), ((None, 0, 0, 0), None), ((0, 0, 0, 180), None),
])
def test_ellipsoidal_distance(spark, p, km):
    """Known geodesics: a degree of the equator and of a meridian, two surveyed points, two cities, pole to pole."""
    got = spark.range(1).select(geo.ellipsoidal_km(*[F.lit(x).cast("double") for x in p]).alias("km")).first().km
    assert got == (None if km is None else pytest.approx(km, abs=2e-2 if km == 343.923 else 1e-5))


def test_common_subsequence():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert metrics.common_subsequence(a, b) == row[-1]


def test_ellipsoidal_terms_are_computed_once(spark):
    """The plan holds each coordinate once; nested turns repeated every term wherever it is used."""
    d = spark.range(200_000).select(*[(F.col("id") % m - m / 2).alias(c) for c, m in (("a", 170), ("b", 350), ("c", 160), ("d", 300))])
    df = d.select(geo.ellipsoidal_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 5000
    assert df.where("km IS NOT NULL").count() > 190_000
    assert spark.range(1).select(geo.ellipsoidal_km(F.lit(None).cast("double"), *[F.lit(1.0)] * 3).alias("km")).first().km is None


def test_tied_annotations_go_by_place(spark):
    images = spark.createDataFrame([("a",)], "image_path string")
    rows = [("a", 2, i, f"t{i}", None, None) for i in range(50, 0, -1)] + [("a", 1, 0, "older", None, None)]
    notes = spark.createDataFrame(rows, "image_path string, ord int, place int, gt_text string, gt_latitude double, gt_longitude double").repartition(7)
    assert runs.build_items(images, notes).first().gt_text == "t1"
