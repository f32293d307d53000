"""Files of records, extractors and losses on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import metrics, normalize, runs
from quillmark.sources import spec


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("said", "want"), [
    ('{"FinalAnswer": "a"}', "a"), ('{"FinalAnswer": 5, "x": 1}', None), ('{"FinalAnswer": null, "final_answer": " a  b "}', "a b"), ("", None), (None, None),
    ('<answer></answer> {"FinalAnswer": "later"}', "later"), ('"FinalAnswer": "é\\u00e9"', "éé"), ('"FinalAnswer": ""', ""), ("plain", None),
])
def test_eval_answer(spark, said, want):
    assert one(spark, text.eval_answer(F.lit(said).cast("string"))) == want


@pytest.mark.parametrize(("said", "want"), [
    ('{"lat": 1, "lon": 2}', (1, 2)), ('{"lat": 91, "lon": 2}', None), ("", None), (None, None), ("[1, 2]", None),
    ('<answer>{"lat": 1}</answer><answer>{"lat": 3, "lon": 4}</answer> {"lat": 5, "lon": 6}', (3, 4)), ('{"a": {"lat": 1, "lon": 2}}', None),
])
def test_reward_point(spark, said, want):
    p = one(spark, text.reward_point(F.lit(said).cast("string")))
    assert (None if p is None else tuple(p)) == want


def test_old_thoughts_of_empty_and_null_messages(spark):
    d = spark.createDataFrame([(None,), ([],), ([("assistant", "<think>a</think>b", None), ("user", None, None), ("assistant", None, None)],)], f"messages {normalize.MESSAGES}")
    got = [r["messages"] for r in normalize.without_old_thoughts(d, "<think></think>").collect()]
    assert got[0] is None and got[1] == [] and [m["content"] for m in got[2]] == ["<think></think>b", None, None]


def test_benchmark_files(spark):
    def chosen(*paths):
        return sorted(r["path"] for r in runs.benchmark_files(spark.createDataFrame([(p,) for p in paths], "path string"), "/r").collect())

    low = ["/r/x/bench.json", "/r/x/y_500.json", "/r/shards2/bench.json", "/r/x/plain.json", "/r/x/bench_metadata.json"]
    assert chosen("/r/a/a_metadata.jsonl", "/r/a/download_a_metadata.jsonl", "/r/b.jsonl", *low) == ["/r/a/a_metadata.jsonl"]
    assert chosen("/r/b.jsonl", "/r/download_b.jsonl", "/q/c.jsonl", *low) == ["/r/b.jsonl"]
    assert chosen(*low) == ["/r/x/bench.json", "/r/x/y_500.json"]
    assert chosen("/q/a.jsonl") == [] and chosen("/r/x/plain.json") == []


def test_domains(spark):
    of = lambda p: one(spark, text.domain_of(F.lit(p), "/r/"))
    assert (of("/r/a/b/c.json"), of("/r/a.b.json"), of("/r/.hidden"), of("/x/a.json")) == ("a", "a.b", ".hidden", "UNKNOWN")
    d = spark.createDataFrame([("",), (None,), ("own",)], "domain string")
    assert [r["domain"] for r in runs.with_domain(d, F.lit("D")).collect()] == ["D", "D", "own"]
    assert [r["domain"] for r in runs.with_domain(d, F.lit("UNKNOWN")).collect()] == ["", None, "own"]


def test_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_bytes(b'\xef\xbb\xbf{"a": 1}\n\n  {"a": 2}\n')
    assert sorted(r["a"] for r in spec.read_json_lines(spark, str(good), "a int").collect()) == [1, 2]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="no JSON object in bad.jsonl"):
        spec.read_json_lines(spark, str(bad), "a int").collect()
    bad.write_text("[1]\n")
    with pytest.raises(Exception, match="no JSON object"):
        spec.read_json_lines(spark, str(bad), "a int").collect()


def test_export_and_append(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b"), (2, "c")], "id int, v string")
    spec.export_dataset(d, str(tmp_path / "e"))
    train, val = spec.exported(spark, str(tmp_path / "e"))
    assert train.count() == 4 and val is None
    spec.export_dataset(d, str(tmp_path / "e"), d.limit(0))
    assert spec.exported(spark, str(tmp_path / "e"))[1].collect() == []
    for _ in range(2):
        spec.append_new(d, str(tmp_path / "a"), ["id"])
    assert sorted(str(r["id"]) for r in spark.read.parquet(str(tmp_path / "a")).collect()) == ["1", "2", "None"]


def test_reward_mask(spark):
    d = spark.createDataFrame([(0.0,), (0.1,), (None,)], "r double")
    assert [r["m"] for r in d.select(runs.reward_mask(F.col("r"), 0.0).alias("m")).collect()] == [False, True, False]
    assert [r["m"] for r in d.select(runs.reward_mask(F.col("r"), None).alias("m")).collect()] == [True, True, True]


def test_losses(spark):
    rows = [(0, 0.9, 1), (0, 0.2, 1), (0, 0.8, 0), (0, 0.1, 0), (1, 0.5, 1), (2, 0.5, 0)]
    d = spark.createDataFrame(rows, "b int, s double, y int")
    got = {r["batch"]: r["loss"] for r in metrics.online_contrastive(d, "s", "y", "b").collect()}
    # Distances 0.1 and 0.8 against 0.2 and 0.9: the far positive and the near negative are hard.
    assert abs(got[0] - (0.8 ** 2 + 0.3 ** 2)) < 1e-12 and got[1] == 0 and got[2] == 0
    logits = spark.createDataFrame([(1, 1000.0, 1), (1, 999.0, 0), (2, 5.0, 1)], "g int, x double, y int")
    assert abs(metrics.listwise_loss(logits, "x", "y", "g").first()["loss"] - math.log(1 + math.exp(-1))) < 1e-12
    assert metrics.listwise_loss(logits.where("g = 2"), "x", "y", "g").first()["loss"] == 0
    assert abs(metrics.pointwise_loss(logits.where("g = 2"), "x", "y").first()["loss"] - math.log(1 + math.exp(-5))) < 1e-12
    assert set(metrics.LOSSES) >= {"infonce", "contrastive", "cosine_similarity"}
