"""The base columns of the licence scan against SQL over all words."""

import os

import duckdb
import pytest

from quillmark.llm import license_scan
from quillmark.llm.license_rules import BASE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def base_sql(table: str) -> str:
    """Each place at which the words of a phrase stand one after another."""
    one = " UNION ALL ".join(
        f"SELECT r, i - 1 AS place, '{label}' AS label FROM p WHERE " + " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split())) for _, phrase, label in BASE)
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}),
        p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), f AS ({one}),
        g AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY r)
        SELECT doc_id, len(w), coalesce(n, 0), a, b, coalesce(labels, '') FROM d LEFT JOIN g USING (r)"""


def test_base_columns_match_sql(spark):
    db = duckdb.connect()
    want = sorted(db.sql(base_sql(f"'{SF}/documents.parquet'")).fetchall())
    rows = license_scan.license_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    assert sum(r.n_base for r in rows) > 0
