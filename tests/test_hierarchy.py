import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import hierarchy as H
from termweave.operators import spread


def reach(edges):
    steps = {}
    for a, b in edges:
        steps.setdefault(a, set()).add(b)
    out = {}
    for start in steps:
        dist, front = 0, {start}
        while front:
            dist, front = dist + 1, {b for a in front for b in steps.get(a, ()) if (start, b) not in out}
            out.update({(start, b): dist for b in front})
    return out


def graph(spark, edges):
    return spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, dist long")


def closed(spark, edges):
    return {(r.src, r.dst): r.dist for r in H.closure(graph(spark, edges)).collect()}


@pytest.mark.parametrize("seed,nodes,density", [(1, 60, 1.2), (3, 30, 2.5)])
def test_closure_of_random_graphs_with_loops(spark, seed, nodes, density, monkeypatch):
    monkeypatch.setattr(H, "BASE_EDGES", 15)
    monkeypatch.setattr(H, "FRAGMENT_NODES", 8)
    monkeypatch.setattr(spread, "HOT_ROWS", 10)
    pick = random.Random(seed)
    edges = {(f"n{pick.randrange(nodes)}", f"n{pick.randrange(nodes)}") for _ in range(int(nodes * density))}
    assert closed(spark, edges) == reach(edges)


def test_closure_of_a_long_chain_and_a_star(spark, monkeypatch):
    monkeypatch.setattr(H, "FRAGMENT_NODES", 10)
    edges = {(f"c{i}", f"c{i + 1}") for i in range(60)} | {(f"s{i}", "c0") for i in range(80)}
    assert closed(spark, edges) == reach(edges)


def test_closure_of_nothing_and_of_nulls(spark):
    assert closed(spark, []) == {}
    assert closed(spark, [("a", None), (None, "b"), ("a", "a"), ("a", "a")]) == {("a", "a"): 1}


def test_hierarchy_names_loops_and_paths(spark):
    terms = spark.createDataFrame(
        [(" r ", None, 1), ("a", ["R", "r ", None], 1), ("b", ["a", "gone"], 1), ("c", ["b", "a"], 1), ("x", ["y"], 1), ("y", ["x"], 1), ("z", ["x", "c"], 1), (None, ["r"], 1), ("a", [], 2)],
        "id string, parents array<string>, depth int",
    )
    clean = lambda c: F.upper(F.trim(c))
    nodes, edges = H.parent_edges(terms, clean(F.col("id")), F.transform(F.coalesce("parents", F.array()), clean))
    rows = {r.node: r for r in H.hierarchy(nodes, edges).collect()}
    assert rows["C"].path == ["R", "A", "C"] and rows["C"].depth == 2 and rows["C"].roots == ["R"]
    assert rows["Z"].path == ["R", "A", "C", "Z"] and not rows["Z"].on_loop
    assert rows["X"].on_loop and rows["X"].depth is None and rows["X"].path is None and rows["X"].roots == []
    assert rows["R"].n_descendants == 4 and rows["R"].depth == 0 and rows["Z"].n_ancestors == 6
    links = {(r.src, r.dst, r.root) for r in H.path_links(nodes, edges).collect()}
    assert links == {("A", "R", "R"), ("B", "A", "R"), ("C", "B", "R"), ("C", "A", "R"), ("Z", "C", "R")}
