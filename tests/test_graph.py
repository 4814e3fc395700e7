"""Strongly connected components and cost-limited reach against plain versions."""

import heapq

import numpy as np
import pytest

from acrework.operators import graph as G
from acrework.operators import joins as J


def reach_of(edges, node):
    seen, open_ = set(), [node]
    while open_:
        for a, b in edges:
            if a == open_[0] and b not in seen:
                seen.add(b)
                open_.append(b)
        open_.pop(0)
    return seen


@pytest.mark.parametrize("seed, nodes, n", [(1, 12, 14), (2, 25, 40), (3, 9, 40)])
def test_components_equal_mutual_reach(spark, seed, nodes, n):
    edges = [tuple(map(int, e)) for e in np.random.default_rng(seed).integers(0, nodes, (n, 2))]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")
    reach = {v: reach_of(edges, v) for v in {v for e in edges for v in e}}
    found = {r["node"]: r["component"] for r in G.strongly_connected(df).collect()}
    assert set(found) == set(reach)
    for a in reach:
        for b in reach:
            assert (found[a] == found[b]) == (a == b or (a in reach[b] and b in reach[a]))
    assert {r["node"] for r in G.cycle_nodes(df).collect()} == {v for v in reach if v in reach[v]} == {r["src"] for r in G.closure(df).filter("src = dst").collect()}


def test_no_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "src string, dst string")
    assert {r["node"]: r["component"] for r in G.strongly_connected(df).collect()} == {v: v for v in "abcx"}
    assert [r["node"] for r in G.cycle_nodes(df).collect()] == ["x"]
    assert G.cycle_nodes(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [None, 3.0, 1000.0])
def test_reach_equals_plain_search(spark, width):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 40, 160), rng.integers(0, 40, 160), rng.choice([0.0, 0.5, 1.0, 2.5, 7.0, 30.0], 160))]
    df = spark.createDataFrame([*edges, (1, None, 1.0), (1, 2, None)], "src long, dst long, cost double")
    best, heap = {}, [(0.0, 3), (0.0, 7)]
    while heap:
        cost, node = heapq.heappop(heap)
        if node in best or cost > 12:
            continue
        best[node] = cost
        for a, b, c in edges:
            if a == node:
                heapq.heappush(heap, (cost + c, b))
    sources = spark.createDataFrame([(3,), (7,), (7,), (None,)], "node long")
    rows = G.reachable_within(df, sources, 12.0, width).collect()
    assert len(rows) == len(best) and {r["node"]: r["cost"] for r in rows} == best
    assert G.reachable_within(df, sources.limit(0), 12.0).count() == 0


@pytest.mark.parametrize("many", [1, 1_000])
def test_closure_is_dealt_by_rows_and_builds_no_path_twice(spark, monkeypatch, many):
    """Every pair of a tree is built once, and joins are dealt by their rows unless many paths pass one node."""
    dealt, built = [], []
    plain, cut = J.dealt_by, G.cut_lineage
    monkeypatch.setattr(J, "DEALT_FROM", 0)
    monkeypatch.setattr(J, "ROWS_EACH", 20)
    monkeypatch.setattr(G, "DEALT_FROM", 0, raising=False)
    monkeypatch.setattr(G, "MANY", many, raising=False)
    monkeypatch.setattr(G, "dealt_by", lambda keys, *sides, **kw: dealt.append(list(keys)) or plain(keys, *sides, **kw))
    monkeypatch.setattr(G, "cut_lineage", lambda df, name: (built.append(df.count()) if name == "closure-steps" else None, cut(df, name))[1])
    tree = [(i, i // 3) for i in range(1, 100)]
    got = sorted(map(tuple, G.closure(spark.createDataFrame(tree, "src long, dst long")).collect()))
    assert got == sorted((i, j) for i in range(1, 100) for j in reach_of(tree, i))
    assert (["_mid"] in dealt) == (many > 1) and ["src", "dst"] in dealt
    assert sum(built) < 2 * len(got)  # what a step finds is read twice, nothing else
    rng = np.random.default_rng(8)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 15, (24, 2))] + [(100 + i, 101 + i) for i in range(20)] + [(120, 100)]
    got = sorted(map(tuple, G.closure(spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")).collect()))
    assert got == sorted((v, w) for v in {a for a, _ in edges} for w in reach_of(edges, v))
    assert G.closure(spark.createDataFrame([], "src long, dst long")).count() == 0
