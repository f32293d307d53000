"""Folded streams against plain loops: rows in are rows out, also over restarts."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import compose
from quillmark.operators.compose import fullest_fit
from quillmark.streaming import stream
from quillmark.streaming.interleaved import Interleaved
from quillmark.streaming.lanes import hashed

FILES, PER_FILE = 4, 60


@pytest.fixture
def source(spark, tmp_path):
    """Files of rows in the order of their ids, one file a batch."""
    for i in range(FILES):
        rows = spark.range(i * PER_FILE, (i + 1) * PER_FILE).select("id", (F.col("id") * 7 % 9 + 1).alias("n"), F.lit("k").alias("k"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return lambda: stream.read(spark, str(tmp_path / "in"), "id long, n long, k string")


def length(i):
    return i * 7 % 9 + 1


def packed_by_loop(window, capacity):
    bins, held = [], []
    for f in range(FILES):
        ids = list(range(f * PER_FILE, (f + 1) * PER_FILE))
        for at in range(0, len(ids) + 1, window):
            new = ids[at : at + window]
            held += new
            if not held:
                continue
            own = fullest_fit([length(i) for i in held], capacity)
            bins += [sorted(i for i, b in zip(held, own, strict=True) if b == k) for k in range(max(own))]
            held = [i for i, b in zip(held, own, strict=True) if b == max(own)]
    return sorted([*bins, sorted(held)])


def bins_of(df):
    return sorted(sorted(r.ids) for r in df.groupBy("batch", "lane", "place").agg(F.collect_list("id").alias("ids")).collect())


def test_packing_matches_loop(spark, source, tmp_path):
    packed = stream.pack(spark, str(tmp_path / "out"), "id", "n", 20, key="k", window=16, lanes=1)
    got = packed.run(source(), str(tmp_path / "cp"))
    assert got.count() == FILES * PER_FILE and set(got.columns) == {"id", "n", "k", "lane", "place", "batch"}
    assert bins_of(got) == packed_by_loop(16, 20)


def test_packing_in_lanes_loses_nothing(spark, source, tmp_path):
    got = stream.pack(spark, str(tmp_path / "out"), "id", "n", 20, lanes=5).run(source(), str(tmp_path / "cp"))
    assert sorted(r.id for r in got.collect()) == list(range(FILES * PER_FILE))
    assert got.groupBy("batch", "lane", "place").agg(F.sum("n").alias("s")).where("s > 20").count() == 0


def test_restart_goes_on_where_it_broke_off(spark, source, tmp_path):
    class Broken(Exception):
        pass

    packed = stream.pack(spark, str(tmp_path / "out"), "id", "n", 20, key="k", window=16, lanes=1)
    write, seen = packed.tables.write, []

    def once(df, kind, batch):
        if kind == "held" and batch == 4 and not seen:  # the rows of a batch are written, what it holds is not
            seen.append(batch)
            raise Broken
        write(df, kind, batch)

    packed.tables.write = once
    with pytest.raises(Exception):  # noqa: B017
        packed.run(source(), str(tmp_path / "cp"))
    assert seen
    again = stream.pack(spark, str(tmp_path / "out"), "id", "n", 20, key="k", window=16, lanes=1)
    assert bins_of(again.run(source(), str(tmp_path / "cp"))) == packed_by_loop(16, 20)


def test_stream_goes_on_after_its_end(spark, source, tmp_path):
    packed = stream.pack(spark, str(tmp_path / "out"), "id", "n", 20)
    packed.run(source(), str(tmp_path / "cp"))
    spark.range(1000, 1010).select("id", F.lit(3).cast("long").alias("n"), F.lit("k").alias("k")).write.mode("append").parquet(str(tmp_path / "in"))
    got = packed.run(source(), str(tmp_path / "cp"))
    assert sorted(r.id for r in got.collect()) == [*range(FILES * PER_FILE), *range(1000, 1010)]
    assert packed.finish().count() == FILES * PER_FILE + 10


def test_shuffle_matches_loop(spark, source, tmp_path):
    got = stream.shuffle(spark, str(tmp_path / "out"), "id", size=20, lanes=1).run(source(), str(tmp_path / "cp"))
    order = [r.id for r in got.orderBy("batch", "lane", "place").collect()]
    key, buffer, want = hashed(42, "id"), [], []
    for i in range(FILES * PER_FILE):
        if len(buffer) < 20:
            buffer.append(i)
            continue
        slot = int(key({"id": i}) * 20)
        want.append(buffer[slot])
        buffer[slot] = i
    want += sorted(buffer, key=lambda i: key({"id": i}))
    assert order == want and sorted(order) == list(range(FILES * PER_FILE))
    assert all(i - place <= 20 for place, i in enumerate(order))  # none goes out before its turn by more than the buffer


@pytest.mark.parametrize("stop", ["first_exhausted", "all_exhausted"])
def test_interleaved_streams_match_the_batch_form(spark, tmp_path, stop):
    """Sources of different speed: 3 files of 40 rows and 5 of 10; the order is that of the whole tables."""
    sizes, probabilities = [(3, 40), (5, 10)], [0.7, 0.3]
    for i, (files, n) in enumerate(sizes):
        for f in range(files):
            spark.range(f * n, (f + 1) * n).select("id", F.lit(f"s{i}").alias("name")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    streams = [stream.read(spark, str(tmp_path / f"in{i}"), "id long, name string") for i in range(2)]
    got = Interleaved(spark, str(tmp_path / "out"), probabilities, ["id"]).run(streams, str(tmp_path / "cp"), stop)
    frames = [spark.read.parquet(str(tmp_path / f"in{i}")) for i in range(2)]
    want = compose.interleave(frames, probabilities, ["id"], stop=stop)
    pick = lambda d: sorted((r.position, r.source, r.id, r.name) for r in d.collect())
    assert pick(got) == pick(want) and len(pick(got)) == len({r[0] for r in pick(got)})


def test_interleaving_refuses_what_it_cannot_do(spark, tmp_path):
    with pytest.raises(ValueError):
        Interleaved(spark, str(tmp_path), [0.5, 0.4], ["id"])


def test_empty_stream(spark, tmp_path):
    spark.range(0).select("id", F.lit(1).cast("long").alias("n")).write.parquet(str(tmp_path / "in"))
    got = stream.pack(spark, str(tmp_path / "out"), "id", "n", 20).run(stream.read(spark, str(tmp_path / "in"), "id long, n long"), str(tmp_path / "cp"))
    assert got.collect() == []
