"""The test of concepts: p values once per line of counts, and the same results where tables are not sent to all tasks."""

import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import enrich, spread


@pytest.fixture(scope="module")
def tables(spark):
    pick = random.Random(5)
    held = {(f"e{e}", f"k:{c}") for e in range(60) for c in (pick.randint(0, 25) for _ in range(6))} | {(f"e{e}", "k:all") for e in range(60)}
    index = spark.createDataFrame([(e, "keyword", c, c[2:]) for e, c in sorted(held)], "entity_id string, layer string, concept string, label string")
    members = {(f"s{s}", f"e{pick.randint(0, 65)}") for s in range(12) for _ in range(2 + s)}
    return index, spark.createDataFrame(sorted(members), "set_id string, entity_id string"), spark.createDataFrame([(f"e{e}",) for e in range(50)], "entity_id string")


def test_a_line_of_counts_has_its_p_value_computed_once(tables, monkeypatch):
    monkeypatch.setattr(enrich.S, "hypergeometric_tail", lambda *counts: F.rand(1))
    by_counts = {}
    for r in (rows := enrich.enrich(*tables).collect()):
        by_counts.setdefault((r.k_study, r.n_study, r.k_bg), set()).add(r.p_value)
    assert len(by_counts) < len(rows) and all(len(values) == 1 for values in by_counts.values())


def test_results_are_the_same_without_sent_tables(tables, monkeypatch):
    wanted = sorted(map(tuple, enrich.enrich(*tables).collect()))
    monkeypatch.setattr(spread, "SENT_ROWS", 0)
    monkeypatch.setattr(spread, "HOT_ROWS", 5)
    assert wanted and sorted(map(tuple, enrich.enrich(*tables).collect())) == wanted


def test_counts_against_plain_ones(tables):
    index, sets, background = (t.collect() for t in tables)
    held = {(r.entity_id, r.concept) for r in index}
    inside = {e for e, _ in held} & {r.entity_id for r in background}
    got = {(r.set_id, r.concept): (r.k_study, r.n_study, r.k_bg, r.n_bg) for r in enrich.enrich(*tables).collect()}
    study = {}
    for name, entity in sets:
        if entity in inside:
            study.setdefault(name, set()).add(entity)
    carriers = {}
    for entity, concept in held:
        if entity in inside:
            carriers.setdefault(concept, set()).add(entity)
    wanted = {(s, c): (len(m & e), len(m), len(e), len(inside)) for s, m in study.items() for c, e in carriers.items() if m & e and len(e) <= 0.25 * len(inside)}
    assert got == wanted
