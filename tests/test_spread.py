"""Joins of hot keys, places in groups and rates against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import enrich, spread


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_join_as_others(spark, monkeypatch, how):
    monkeypatch.setattr(spread, "HOT_ROWS", 20)
    pick = random.Random(1)
    left = spark.createDataFrame([("hot" if i % 3 else f"k{pick.randint(0, 9)}", i, None if i % 7 else "x") for i in range(300)] + [(None, 1, "x")], "k string, n int, part string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5)], "k string, v int")
    got = spread.spread_join(left, right, ["k"], how)
    wanted = left.join(right, ["k"], how)
    assert got.columns == wanted.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert spread.spread_join(left.where("false"), right, ["k"], how).count() == 0


def test_places_in_groups_over_many_parts(spark):
    pick = random.Random(2)
    rows = [("big" if i % 3 else f"g{i % 40}", pick.randint(0, 5), i) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, score int, id int").withColumn("part", F.lit("x")).repartition(5)
    got = {(r.g, r.id): r.place for r in spread.positions(frame, "g", [F.col("score").desc(), F.col("id")], "place").collect()}
    wanted = {}
    for g in {r[0] for r in rows}:
        for place, (_, s, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            wanted[g, i] = place
    assert got == wanted
    assert spread.positions(frame.where("false"), "g", [F.col("id")], "place").count() == 0


def test_rates_of_a_set_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT_ROWS", 50)
    pick = random.Random(3)
    rows = [("big" if i % 4 else f"s{i % 24}", pick.choice([0.5, 1.0, round(pick.random() ** 3, 3)]), i % 11 != 0) for i in range(2000)]
    rows += [(None, 0.1, True), ("s0", None, True), ("s0", 0.2, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, set_id string, p_value double, tested boolean")
    got = {r.id: r.fdr for r in enrich.false_discovery(frame).collect()}
    assert len(got) == len(rows)
    for name in {r[0] for r in rows} - {None}:
        tested = sorted((p, i) for i, (s, p, t) in enumerate(rows) if s == name and t and p is not None)
        least = 1.0
        for rank in range(len(tested), 0, -1):
            p, i = tested[rank - 1]
            last = max(r for r, (q, _) in enumerate(tested, 1) if q == p)
            least = min(least, p * len(tested) / last)
            assert abs(got[i] - least) < 1e-12
    assert all(got[i] == 1 for i, (s, p, t) in enumerate(rows) if not t or p is None or s is None)
    assert enrich.false_discovery(frame.where("false")).count() == 0
