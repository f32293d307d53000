"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quillmark.plans import catalogue, encoding, formats, more, scores  # noqa: F401  (they register their queries)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert got
    if name not in catalogue.ORACLE_SQL:
        return
    rel = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = [tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["annotations_last_wins", "metadata_patch_first_wins", "build_items"])
def test_ties_over_many_files(spark, tmp_path, name):
    """Where the SQL's order leaves ties open, DuckDB on one thread takes the row that stands first in the files (on more, its runs differ)."""
    n = 200_000
    (tmp_path / "lineitem.parquet").mkdir()
    c = duckdb.connect(config={"threads": 1})
    for i in range(5):
        c.sql(f"COPY (SELECT (i * 7919 + {i}) % 3000 AS l_orderkey, (i % 2)::INTEGER AS l_linenumber, (i * 31 + {i}) % 99991 AS l_partkey FROM range({n // 5}) r(i)) TO '{tmp_path}/lineitem.parquet/part-{i}.parquet' (FORMAT parquet)")
    c.sql(f"COPY (SELECT i AS o_orderkey, i % 500 AS o_custkey FROM range(3000) r(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    rel = c.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rel.fetchall(), key=str)
