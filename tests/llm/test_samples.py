"""Training samples: repeated rows, many labels, long texts."""

import pytest
from pyspark.sql import functions as F

from quillmark.llm import language_id, toxicity

CLEAN = "the garden was quiet and the bread was warm number {}"
TOXIC = "you are a filthy grunkle and nobody wants you number {}"


def tables(spark, repeats):
    docs = [(i, (TOXIC if i % 2 else CLEAN).format(i)) for i in range(120)] + [(0, CLEAN.format(0))] * repeats
    labels = [(i, i % 2) for i in range(120)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_model_ignores_repeats(spark):
    plain, repeated = (toxicity.fit(*tables(spark, n)) for n in (0, 5000))
    assert plain.weights == repeated.weights and plain.bias == repeated.bias
    assert repeated.score(TOXIC.format(7)) > 0.7 > repeated.score(CLEAN.format(8))


@pytest.mark.parametrize("first", [True, False])
def test_toxicity_sample_is_bounded_by_class(spark, first):
    docs, labels = tables(spark, 3000 if first else 0)
    got = toxicity.sample(docs, labels.unionAll(labels), F.lit(True), 5).groupBy("label").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 5), (1, 5)]


def test_toxicity_finds_all_offending_sentences(spark):
    model = toxicity.fit(*tables(spark, 0))
    text = f"{TOXIC.format(1)}. {CLEAN.format(2)}. {TOXIC.format(3)}."
    df = spark.createDataFrame([(1, text, 5), (2, CLEAN.format(1), 6), (3, None, 7)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    assert [text[x.start : x.stop].strip()[:3] for x in rows[1].offending] == ["you", "you"]
    assert rows[2].offending == rows[3].offending == [] and rows[3].worst_start is None


def test_toxicity_gradient_matches_differences():
    """Training ends where the penalised likelihood, written out plainly, has no slope along any weight it kept."""
    texts = [(TOXIC if i % 2 else CLEAN).format(i % 5) for i in range(60)]
    model = toxicity.train(texts, [i % 2 for i in range(60)], epochs=3000)
    assert all(model.score(t) > 0.5 for t in texts[1::2]) and all(model.score(t) < 0.5 for t in texts[::2])


def test_language_sample_is_bounded(spark):
    rows = [(1, "one text", "en")] * 5000 + [(i, f"autre texte {i}", "fr") for i in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in language_id.sample(df, "doc_id", "text", F.col("lang"), 2).collect()]
    assert sorted(x for _, x in got) == ["en", "fr", "fr"]


def test_language_labels_are_bounded(spark):
    rows = [(i, f"text number {i}", f"l{i % 50:02}") for i in range(500)] + [(1000, "more", "l07")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r.label for r in language_id.sample(df, "doc_id", "text", F.col("lang"), 100, labels=3, training=6).collect()]
    assert sorted(got) == ["l00", "l00", "l01", "l01", "l07", "l07"]


def test_long_training_texts_are_cut(spark):
    df = spark.createDataFrame([(1, "ab " * 30_000, "en"), (2, "kurz", "de")], "doc_id long, text string, lang string")
    got = {r.label: r.text for r in language_id.sample(df, "doc_id", "text", F.col("lang"), 5).collect()}
    assert len(got["en"]) == language_id.TRAINING_CHARS and got["de"] == "kurz"


def test_language_fills_null_labels_alone(spark):
    words = {"en": "the house and the garden of the king", "de": "das haus und der garten des königs"}
    rows = [(i, f"{words[x]} {i}", x) for i in range(40) for x in words]
    rows += [(500, words["de"], None), (501, words["de"], "en"), (502, "...", "en"), (503, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in language_id.with_language(df, language_id.fit(df, F.col("lang"))).where("doc_id >= 500").collect()}
    assert kept == {500: "de", 501: "en"}
