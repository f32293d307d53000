"""Groups, files, archives, cards, text reports, viewer, small readers."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import exports, metrics, normalize, runs


@pytest.fixture
def files(tmp_path):
    for name in ("a_1.jpg", "a_2.jpg", "b.png", "c_3.jpg"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(name)
    return str(tmp_path / "in")


def test_groups_and_members(spark, files):
    selection = spark.createDataFrame([("a/a_1.jpg",), ("b.png",), ("x_2.jpg",)], "relative_path string")
    rows = spark.createDataFrame([(f"{files}/{n}", i) for i, n in enumerate(("a_1.jpg", "a_2.jpg", "b.png", "c_3.jpg"))], "image_path string, n int")
    got = {r.n: (r.group_id, r.group_member_stem, r.relative_path, r.group_size) for r in exports.group_candidates(selection, rows).collect()}
    assert got == {0: ("a", "a_1", "a/a_1.jpg", 2), 1: ("a", "a_2", "a/a_2.jpg", 2), 2: ("b", "b", "b/b.png", 1)}
    assert {r.group_id for r in exports.group_candidates(selection, rows, most=1).collect()} == {"a"}
    base = spark.createDataFrame([("a", 1.0), ("z", 2.0)], "group_id string, score double")
    members = spark.createDataFrame([("a/q.jpg", 5), ("a_3.jpg", 6), ("z/z_1.jpg", 7), (None, 8)], "relative_path string, n int")
    assert sorted(tuple(r) for r in exports.group_members(base, members).select("group_id", "score", "n", "member_stem").collect()) == [("a", 1.0, 5, "q"), ("a", 1.0, 6, "a_3"), ("z", 2.0, 7, "z_1")]


@pytest.mark.parametrize("mode", exports.MODES)
def test_files_go_to_their_places(spark, files, tmp_path, mode):
    rows = spark.createDataFrame([(f"{files}/a_1.jpg", "x/a.jpg"), (f"{files}/a_1.jpg", "x/a.jpg"), (f"{files}/gone.jpg", "y.jpg"), (None, "z")], "image_path string, relative_path string")
    root = str(tmp_path / "out")
    for _ in range(2):
        got = {os.path.basename(r.path): r.done for r in exports.materialize(rows, root, mode).collect()}
    assert got == {"a_1.jpg": mode != "manifest_only", "gone.jpg": False}
    assert os.path.exists(f"{root}/x/a.jpg") == (mode != "manifest_only") and os.path.islink(f"{root}/x/a.jpg") == (mode == "symlink")
    with pytest.raises(Exception, match="leads out"):
        exports.materialize(rows.withColumn("relative_path", F.lit("../../etc/x")), root, mode).collect()


def test_archives_by_domain(spark, files, tmp_path):
    rows = [(f"{files}/a_1.jpg", "q/a.jpg", "d", True), (f"{files}/a_2.jpg", "a.jpg", "d", False), (f"{files}/b.png", None, "e", False), (f"{files}/c_3.jpg", "c.jpg", None, None)]
    df = spark.createDataFrame(rows, "image_path string, relative_path string, domain string, selected boolean")
    got = {r.domain: (r.zip_path, r.files) for r in exports.zip_domains(df, str(tmp_path / "zips")).collect()}
    assert {k: v[1] for k, v in got.items()} == {"d": 1, "e": 1, "UNKNOWN": 1}
    with zipfile.ZipFile(got["d"][0]) as z:
        assert z.namelist() == ["image/q/a.jpg"] and z.read("image/q/a.jpg") == b"a_1.jpg"
    with zipfile.ZipFile(got["e"][0]) as z:
        assert z.namelist() == ["image/b.png"]
    assert sorted(os.listdir(tmp_path / "zips")) == ["UNKNOWN.zip", "d.zip", "e.zip"]


def test_cards(spark):
    m = F.array(normalize.message("user", F.lit("a b")), normalize.message("assistant", F.col("t")))
    df = spark.createDataFrame([("c",), ("c d e",)], "t string").select(m.alias("messages"))
    assert exports.dataset_card("set", df, subsets=("x", "y"), tags=("chat",)).first().card == "|set|x<br>y|2|4.0±1.0, min=3, max=5|chat|"
    assert exports.dataset_card("none", df.limit(0)).first().card == "|none||0|-|-|"


def test_reports_by_file(spark):
    rows = [("f1", 1, 0.5, "Asia"), ("f1", 1, 100.0, "Asia"), ("f1", -1, None, None), ("f2", 1, 3000.0, "Europe"), (None, 0, None, " ")]
    df = spark.createDataFrame(rows, "file string, status int, distance double, continent string")
    rep = metrics.geo_report_by_file(df, ("continent",))
    got = {(r.report, r.group_kind, r.group_key): (r.rows, r.ok, r.acc_1km) for r in rep.collect()}
    assert got["f1", "overall", "all"] == (3, 2, pytest.approx(1 / 3)) and got["combined", "overall", "all"] == (5, 3, 0.2) and got["combined", "continent", "UNKNOWN"][0] == 2 and ("UNKNOWN", "overall", "all") in got
    assert {r.report for r in metrics.geo_report_by_file(df.where("file = 'f1'"), ("continent",)).collect()} == {"f1"}
    texts = {r.report: r.text for r in metrics.report_text(rep, {"continent": "大洲 {key}"}).collect()}
    lines = texts["f1"].split("\n")
    assert lines[:6] == ["=" * 50, "总体评测结果:", "总样本数: 3", "有效预测数: 2", "状态统计: {1: 2, 0: 0, -1: 1}", "大洲级准确率 (2500km, 失败=0): 0.6667"]
    assert lines[16] == "大洲 Asia评测结果:" and "平均距离 (仅有效预测): 50.25 km" in lines and texts["f1"].endswith("=" * 50 + "\n")


def test_viewer(spark):
    rows = [("a", 0.2, True, 0, 1, 1), ("b", None, False, 2, 0, 2), ("c", 0.9, True, None, None, None), ("d", 0.9, False, 0, 0, 0)]
    df = spark.createDataFrame(rows, "item_id string, p double, selected boolean, generation_errors int, judge_errors int, errors int")
    ids = lambda d: sorted(r.item_id for r in d.collect())
    assert ids(runs.viewed(df, issue_kind="none")) == ["c", "d"] and ids(runs.viewed(df, issue_kind="judge_error")) == ["a"] and ids(runs.viewed(df, issue_kind="generation_error")) == ["b"]
    assert [r.item_id for r in runs.viewed(df, order="p").orderBy("place").collect()] == ["c", "d", "a", "b"]
    assert [r.item_id for r in runs.viewed(df, order="p", descending=False).orderBy("place").collect()] == ["a", "c", "d", "b"]


def test_small_readers(spark):
    df = spark.createDataFrame([(" -12.5 ", "r", "c", "so Reward: **0.5** "), ("Paris", None, "c", "Reward: 1 Reward: 2"), (None, "r", None, "none"), ("12 Main St", "", "c", "Reward: x")], "q string, r string, c string, p string")
    got = df.select(text.invalid_query(F.col("q")).alias("q"), text.distilled(F.col("c"), F.col("r")).alias("d"), text.prm_reward(F.col("p")).alias("p")).collect()
    assert [r.q for r in got] == [True, False, True, False]
    assert [r.d for r in got] == ["<think>r</think>\n\n<answer>c</answer>", "c", "<think>r</think>\n\n<answer></answer>", "<think></think>\n\n<answer>c</answer>"]
    assert [r.p for r in got] == [0.5, 1.0, 0.0, 0.0]
