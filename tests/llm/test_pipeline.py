"""The pipeline's stages, one by one, on planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quillmark.llm import simhash_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choice(["the", "ing", "er", "tion", "ed"]) + rnd.choice(["s", "th", "on", ""]) + f"{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(n))
    rows = [(i, text(120), "en", f"s{i % 3}", 0) for i in range(60)]
    item = text(30)
    rows += [(100, rows[0][1].replace(" ", "  ", 5), "en", "s0", 0), (101, rows[1][1] + " tail", "en", "s0", 0)]
    rows += [(102, text(60) + " " + item + " " + text(40), "en", "s1", 0), (103, None, "en", "s1", 0), (104, "12 34 !!", "en", None, 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    gone = {"language": {103, 104}, "exact_dedup": {100}, "near_dedup": {101}, "decontamination": {102}}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert before - after == gone[name], name
        docs = out
    mixed = pipeline.STAGES[-1][1](spark, docs, planted)
    assert {r.doc_id for r in mixed.collect()} <= set(range(60))
    assert {r.doc_id for r in pipeline.run(spark, planted).collect()} == {r.doc_id for r in mixed.collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0


def test_repeated_rows(spark):
    rows = [(1, "some words here", "en", "a"), (1, "some words here", "en", "a"), (2, "some  words here", "en", "a"), (None, "others", "en", "b"), (None, "others", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id, r.text) for r in pipeline.exact(spark, docs, SF).where("doc_id IS NOT NULL").collect()) == [(1, "some words here")]
    assert pipeline.exact(spark, docs, SF).where("doc_id IS NULL").count() == 1


def test_rows_without_ids(spark, tmp_path):
    rnd = random.Random(4)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    item, a, b, alone = words(30), words(100), words(100), words(100)
    texts = {"copy of 1": a + " tail", "pair": b, "its copy": b + " tail", "leak": words(40) + " " + item + " " + words(40), "alone": alone}
    rows = [(1, a, "en", "s"), *((None, t, "en", "s") for t in texts.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = lambda out: {r.text for r in out.collect()}
    kept = left(pipeline.near(spark, docs, str(tmp_path)))
    assert len(kept & {b, b + " tail"}) == 1 and kept - {b, b + " tail"} == {a, texts["leak"], alone}
    assert left(pipeline.benchmark(spark, docs, str(tmp_path))) == {t for _, t, *_ in rows} - {texts["leak"]}


def test_one_id_with_twins(spark):
    """Texts of one id that differ in blanks alone are one text."""
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (1, "a  b c", "en", "s"), (2, "x", "en", "s")], "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in pipeline.exact(spark, docs, SF).collect()) == [1, 2]


def test_no_label_empties_nothing(spark):
    rows = [(1, "some words", None, "s"), (2, "12 !!", None, "s"), (3, None, None, "s"), (4, "mots", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in pipeline.language(spark, docs, SF).collect()) == [1, 4]


def test_clashing_columns(spark, planted):
    """Columns named like those that the stages make inside are carried along."""
    docs = spark.read.parquet(f"{planted}/documents.parquet").limit(12)
    names = ["gone_id", "again_id", "gone_key", "name", "row", "text_key", "node", "pos"]
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns, name
        assert out.count() == 12 and out.select(*names).distinct().collect() == [tuple(range(len(names)))], name


def test_near_stage_goes_through_the_trie(spark, planted, monkeypatch):
    """The stage joins the fingerprints of op2 in its trie; the planted near copy is a group of them."""
    real, seen = simhash_dedup.fingerprint_groups, []

    def spy(held, scratch):
        groups = real(held, scratch)
        want = {r.fingerprint for r in simhash_dedup.simhash_groups(docs).collect()}
        assert {f"{r.f0 % 2**64:016x}" for r in held.collect()} == want
        seen.append(groups.groupBy("bucket").agg(F.count("node").alias("n")).count())
        return groups

    docs = spark.read.parquet(f"{planted}/documents.parquet").where("doc_id <> 100")
    ids = [r.component_id for r in simhash_dedup.simhash_groups(docs).collect()]
    monkeypatch.setattr(simhash_dedup, "fingerprint_groups", spy)
    pipeline.near(spark, docs, planted)
    assert seen == [sum(ids.count(i) > 1 for i in set(ids))] and seen[0] > 0
