"""Manifests by their contents, sidecars, cached choices."""

import json

import pytest
from pyspark.sql import functions as F

from quillmark.operators.runs import row_key
from quillmark.sources import spec

ROWS = [{"id": 1, "name": "é"}, {"id": 2, "name": None}]
SHAPES = {
    "a.jsonl": "\n".join(json.dumps(r) for r in ROWS) + "\n\n", "b.json": json.dumps(ROWS), "c.json": json.dumps({"data": ROWS}), "d.json": json.dumps({"annotations": ROWS}, indent=2),
    "e.json": "\n".join(json.dumps(r) for r in ROWS), "f.json": "\ufeff\n " + json.dumps(ROWS, indent=1), "g.csv": "id,name\n1,é\n2,\n",
}


@pytest.mark.parametrize("name", SHAPES)
def test_manifest(spark, tmp_path, name):
    (tmp_path / name).write_text(SHAPES[name], encoding="utf-8")
    got = spec.read_manifest(spark, str(tmp_path / name), "id long, name string").select("id", "name").collect()
    assert sorted((r.id, r.name or None) for r in got) == [(1, "é"), (2, None)]


def test_sidecars(spark):
    images = spark.createDataFrame([("a/x.jpg", 1), ("a/y.png", 2), ("z", 3)], "relative_path string, n int")
    sides = spark.createDataFrame([("a/x.json", 0.5), ("a/y.JSON", 1.5), ("a/x.txt", 9.0), ("q.json", 3.0)], "json_path string, lat double")
    assert sorted(tuple(r) for r in spec.with_sidecars(images, sides, fields=("lat",)).collect()) == [("a/x.jpg", 1, 0.5), ("a/y.png", 2, 1.5), ("z", 3, None)]


def test_cached_choices(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, q string")
    keys = {r.id: r.key for r in rows.select("id", row_key(rows.columns).alias("key")).collect()}
    cache = spark.createDataFrame([(keys[1], 1, ["y"]), (keys[1], 0, ["x", "w"]), (keys[1], 2, None), ("other", 0, ["z"])], "key string, batch int, choices array<string>")
    got = {r.id: r.choices for r in spec.cached_choices(rows, cache).collect()}
    assert got == {1: ["x", "w", "y"], 2: []}
    assert {r.id: r.choices for r in spec.cached_choices(rows.withColumn("choices", F.array(F.lit("old"))), cache).collect()} == got
