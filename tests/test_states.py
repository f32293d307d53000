"""Metric states, replacement of rows, sessions, batch logs, replayed tables, segmented words."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import metrics, retries, segment, states, stats
from quillmark.sources import commits
from quillmark.streaming import stream


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


METRICS = {
    "mean": lambda: states.mean("v"), "mean_of_arrays": lambda: states.mean("a", array=True, nan_value=-1.0), "moments": lambda: states.moments("v"), "accuracy": lambda: states.accuracy("v", "w"),
    "distinct": lambda: states.distinct("v"), "infer_stats": lambda: states.infer_stats("id", "v", "w", "start", "stop"),
}


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(1)
    rows = [(i % 40, "ab"[i % 2], rnd.choice([None, 1, 2, 3, 7]), rnd.choice([None, 1, 2]), [1.0, None, float(i % 5)] if i % 3 else None, float(i), float(i) + 0.5) for i in range(90)]
    return spark.createDataFrame(rows, "id int, g string, v int, w int, a array<double>, start double, stop double")


@pytest.mark.parametrize("name", METRICS)
@pytest.mark.parametrize("group", [[], ["g"]])
def test_halves_merge_to_the_whole(spark, table, tmp_path, name, group):
    m = METRICS[name]()
    whole = rows_of(states.compute(m, states.update(m, table, group), group))
    for i, part in enumerate((table.where("id < 11"), table.where("id >= 11 AND id < 30"), table.where("id >= 30"))):
        states.save(states.update(m, part, group), str(tmp_path), f"r{i}")
    kept = states.load(spark, str(tmp_path)).drop("run")
    assert rows_of(states.compute(m, states.merge(m, [kept], group), group)) == whole
    assert rows_of(states.compute(m, kept, group)) == whole or name == "infer_stats"
    states.save(states.update(m, table.where("id < 11"), group), str(tmp_path), "r0")  # again: it replaces its former self
    assert rows_of(states.compute(m, states.merge(m, [states.load(spark, str(tmp_path)).drop("run")], group), group)) == whole
    states.reset(spark, str(tmp_path), "r0")
    assert states.load(spark, str(tmp_path)).where("run = 'r0'").count() == 0


def test_metrics_by_hand(spark, table):
    m, arrays = METRICS["mean"](), METRICS["mean_of_arrays"]()
    got = states.compute(m, states.update(m, table)).first().value
    v = [r.v for r in table.collect() if r.v is not None]
    assert got == pytest.approx(sum(v) / len(v))
    none = table.where("false")
    assert states.compute(arrays, states.update(arrays, none)).first().value == -1.0
    rows = [("a", 10, 1, 0.0, 1.0), ("b", 20, 2, 0.5, 3.0), ("a", 30, 3, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id string, prompt_tokens int, completion_tokens int, start double, stop double")
    m = states.infer_stats()
    r = states.compute(m, states.update(m, df)).first()
    assert (r.num_prompt_tokens, r.num_generated_tokens, r.num_samples, r.runtime, r.tokens_per_s) == (50, 5, 2, 2.5, 2.0)


def test_registered_metrics():
    states.register("half", lambda value: states.mean(value))
    with pytest.raises(ValueError):
        states.register("half", states.mean)
    assert "half" in states.METRICS
    del states.METRICS["half"]


def replaced_by_loop(ok, tries=10):
    n = len(ok)
    key = lambda i: (int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:8], 16), i)
    order, at, out = sorted(range(n), key=key), 0, []
    for i in range(n):
        row, used = i, 1
        while not ok[row]:
            if used == tries:
                raise ValueError
            row, at, used = order[at], (at + 1) % n, used + 1
        out.append((i + 1, row, used))
    return out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.4, 0.7])
def test_replacement_matches_loop(spark, share):
    rnd = random.Random(int(share * 10))
    ok = [rnd.random() >= share for _ in range(150)]
    df = spark.createDataFrame([(i, o) for i, o in enumerate(ok)], "id long, ok boolean").repartition(3)
    got = retries.replaced(df, F.col("ok"), ["id"], tries=60)
    assert sorted((r.place, r.id, r.tries) for r in got.collect()) == replaced_by_loop(ok, 60)


def test_replacement_stops_after_its_tries(spark):
    df = spark.createDataFrame([(i, i == 3) for i in range(40)], "id long, ok boolean")
    with pytest.raises(Exception, match="within the tries"):
        retries.replaced(df, F.col("ok"), ["id"]).collect()
    with pytest.raises(ValueError):
        retries.replaced(df.where("NOT ok"), F.col("ok"), ["id"])
    assert retries.replaced(df.where("false"), F.col("ok"), ["id"]).collect() == []


def sessions_by_loop(rows):
    out, held = [], []
    for r in rows:
        query = r["q"] or ""
        if r["i"] == "0":
            if held:
                out.append(held)
            held = []
            query += "\n" + (r["task"] or "")
        held += [("user", query), ("assistant", r["a"] or "")]
    return out + ([held] if held else [])


def test_sessions_match_loop(spark):
    rnd = random.Random(2)
    rows = [{"n": n, "i": rnd.choice(["0", "1", "2", None]), "q": rnd.choice([None, f"q{n}"]), "a": f"a{n}", "task": f"t{n}", "pic": f"p{n}"} for n in range(60)]
    rows[0]["i"] = "1"
    df = spark.createDataFrame(rows, "n int, i string, q string, a string, task string, pic string").repartition(4)
    got = stats.session_messages(df, ["n"], F.col("i") == "0", "q", "a", "task", media="pic").orderBy("session").collect()
    want = sessions_by_loop(rows)
    # Rows before the first marker stay with the first session here; the loop gives them one of their own.
    first = next(k for k, r in enumerate(rows) if r["i"] == "0")
    merged = [want[0] + want[1], *want[2:]] if first else want
    assert [[(m.role, m.content) for m in r.messages] for r in got] == merged
    assert [p for r in got for p in r.pic] == [f"p{n}" for n in range(60)]


def test_sessions_by_key(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, None), ("a", 4, True), (None, 1, True), (None, 2, True), ("b", 1, False)], "k string, n int, m boolean")
    got = sorted((str(r.k), r.n, r.session) for r in stats.marker_sessions(df, "k", ["n"], F.col("m")).collect())
    assert got == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 1, 1)]


def test_batches_go_on_where_they_broke_off(spark, tmp_path):
    df = spark.range(25).select("id", (F.col("id") % 7).alias("v"))
    made = []

    def make(rows):
        made.append(rows.count())
        if len(made) == 4:
            raise RuntimeError("broken off")
        return rows.withColumn("w", F.col("v") * 2)

    with pytest.raises(RuntimeError):
        commits.run_batches(df, str(tmp_path), [F.col("id")], 6, make)
    log = commits.BatchLog(spark, str(tmp_path))
    assert log.done() == [0, 1, 2] and log.rows().count() == 18
    # A batch that was written but never committed is not read, and is written again.
    df.where("id < 3").withColumn("w", F.lit(0)).write.parquet(str(tmp_path / "data/batch-3"))
    assert log.rows().count() == 18
    got = commits.run_batches(df, str(tmp_path), [F.col("id")], 6, make)
    assert sorted(r.id for r in got.collect()) == list(range(25)) and made == [6, 6, 6, 6, 6, 1]
    assert commits.run_batches(df, str(tmp_path), [F.col("id")], 6, make).count() == 25 and len(made) == 6
    assert commits.run_batches(df.limit(0), str(tmp_path / "empty"), [F.col("id")], 6, make) is None


def test_replayed_table(spark, tmp_path):
    stream_of = lambda: stream.cyclic(spark.range(7).select("id", (F.col("id") * 10).alias("v")), ["id"], rows_per_batch=5, epochs=3)

    def run(batches):
        out = stream_of().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        for _ in range(600):
            if (out.lastProgress or {}).get("batchId", -1) >= batches:
                break
            out.awaitTermination(0.1)
        out.stop()

    run(1)  # breaks off in the second epoch at the earliest
    run(6)
    got = sorted((r.epoch, r.row, r.id, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(e, i, i, i * 10) for e in range(3) for i in range(7)]


WORDS = {"今天": 50, "天气": 40, "很": 60, "好": 60, "今": 5, "天": 20, "气": 5, "很好": 30, "北京": 40, "北京大学": 30, "大学": 30, "生": 10, "大学生": 20}


def test_segments_are_the_cheapest():
    import math

    total = sum(WORDS.values())
    cost = {w: math.log(total / n) for w, n in WORDS.items()}
    unknown = 2 * max(cost.values()) + 1
    rnd = random.Random(7)
    for _ in range(200):
        text = "".join(rnd.choice("今天气很好北京大学生人") for _ in range(rnd.randrange(1, 9)))
        splits = [[text[a:b] for a, b in itertools.pairwise((0, *cut, len(text)))] for k in range(len(text)) for cut in itertools.combinations(range(1, len(text)), k)]
        price = lambda s: sum(cost.get(w, unknown if len(w) == 1 else math.inf) for w in s)
        assert price(segment.segment(text, cost)) == pytest.approx(min(map(price, splits)))
    assert segment.segment("今天 weather 很好, OK-2!", cost) == ["今天", "weather", "很好", ",", "OK-2", "!"]
    assert segment.segment("", cost) == [] == segment.segment("  ", {})


def test_scores_of_segmented_words(spark):
    words = spark.createDataFrame([*WORDS.items(), ("今天", 1), (None, 3)], "word string, count long")
    df = spark.createDataFrame([(1, "今天天气很好", "今天天气好"), (2, "北京大学", "北京大学"), (3, "", "x"), (4, None, None)], "id long, h string, r string")
    got = {r.id: r for r in segment.rouge_bleu_segmented(df, "id", "h", "r", words).collect()}
    assert set(got) == {1, 2} and got[2].rouge_l == 100 and got[2].rouge_1 == 100
    want = metrics.rouge_bleu(["今天", "天气", "很好"], ["今天", "天气", "好"])
    assert all(got[1][k] == pytest.approx(round(want[k], 6)) for k in want)


def test_batches_are_committed_by_stretches(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("w"))
    made = []

    def make(rows):
        made.append(rows.count())
        if len(made) == 4:
            raise RuntimeError("broken off")
        return rows

    run = lambda **k: commits.run_batches(df, str(tmp_path), [F.col("id")], 6, make, at_once=4, **k)
    assert run(batches=[5]).count() == 6
    with pytest.raises(RuntimeError):
        run()
    assert commits.BatchLog(spark, str(tmp_path)).done() == [0, 1, 2, 3, 4, 5]
    assert sorted(r.id for r in run().collect()) == list(range(100)) and made == [6, 24, 6, 24, 24, 24, 16]
