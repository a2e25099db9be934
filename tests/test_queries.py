"""Registered core queries against their SQL on the smallest tables, where these are at hand."""

import os

import duckdb
import pytest

from termweave.plans import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["p4_hierarchy", "normalise_ids", "clean_text", "split_names", "lemma", "merge_records", "concepts_phrase", "bh_fdr", "enrich_multi", "significant", "legacy_mc", "p4_links"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plain(rows):
    cell = lambda x: "null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{FOLDER}/{t}'")
    frame = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})").fetchall()
    assert plain(frame.select(columns).collect()) == plain(wanted)


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
