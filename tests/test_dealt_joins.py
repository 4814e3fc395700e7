"""Joins dealt to tasks by the number of their rows, and groups too large for one task."""

import numpy as np
import pytest

from acrework.operators import joins as J
from acrework.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j03_semi_and_anti", "j04_composite_key"])
def test_rows_decide_on_the_tasks(spark, monkeypatch, name):
    """Spark fills a task by compressed bytes, so that one would sort ever more keys."""
    few = QUERIES[name](spark, SF)
    monkeypatch.setattr(J, "DEALT_FROM", 1_000)
    monkeypatch.setattr(J, "ROWS_EACH", 500)
    many = QUERIES[name](spark, SF)
    assert "Repartition" in many._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_large_groups_do_not_meet_in_one_task(spark):
    """Rows of a group of more than ``many`` are joined by broadcast, and none is lost or doubled."""
    df = spark.createDataFrame([(k, i) for k, n in ((1, 9), (2, 3), (3, 1), (4, 5)) for i in range(n)], "k int, i int")
    groups = spark.createDataFrame([(1, 9, "a"), (2, 3, "b"), (4, 5, "d"), (5, 0, "e")], "k int, n long, name string")
    found = J.join_groups(df, groups, ["k"], "n", 18, many=4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.join(groups.drop("n"), "k").collect()))
    assert "Union" in found._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_within_categories(spark, seed):
    """Paths in order and in disorder, stars, repeated and self-edges, told apart by a category."""
    from acrework.operators.components import contracted_components

    order = np.random.default_rng(seed).permutation(200).tolist()
    edges = [("a", i, i + 1) for i in range(60)] + [("a", 100 + i, 100) for i in range(30)] + [("a", 300, 300)]
    edges += [("b", order[i], order[i + 1]) for i in range(120)] + [("b", order[150 + i], order[150]) for i in range(20)] * 2
    parent = {(c, n): (c, n) for c, *ends in edges for n in ends}
    for c, u, v in edges * 200:
        low = min(parent[c, u], parent[c, v])
        if parent[c, u] == parent[c, v]:
            continue
        for k in [k for k, p in parent.items() if p in (parent[c, u], parent[c, v])]:
            parent[k] = low
    df = spark.createDataFrame([*edges, ("a", None, 7), ("a", 8, None)], "cat string, src long, dst long")
    got = [(r["cat"], r["node"], r["component"]) for r in contracted_components(df, within=["cat"]).collect()]
    assert sorted(got) == sorted((*k, p[1]) for k, p in parent.items())


def test_blocks_are_found_once(spark, monkeypatch):
    """Counts and medians read the written blocks and do not find them again."""
    from acrework.operators import geometry as G

    made, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df, name: (made.append((name, df._jdf.queryExecution().executedPlan().toString())), cut(df, name))[1])
    found = QUERIES["g15_size_table"](spark, SF)
    plans = [plan for name, plan in made if name == "blocks"]
    assert len(plans) == 1 and "REPARTITION_BY_NUM" in plans[0]
    assert "part.parquet" not in found._jdf.queryExecution().executedPlan().toString()


def test_shapes_are_dealt_by_their_number(spark):
    """A small file of many shapes is one task or two, which would hold all their cells."""
    assert "Repartition" in QUERIES["g10_region_cells"](spark, SF)._jdf.queryExecution().analyzed().toString()


def test_tokens_beside_numbers_build_no_lists(spark):
    """Tokens around are looked up by their distance; no list is collected for each token."""
    from acrework.operators import text as X

    df = spark.createDataFrame([(1, "The 3 cats and 4, 5 dogs"), (2, "9"), (3, "to a 7")], "k int, text string")
    found = X.neighbourhood(X.tokens(df, "k", "text"), "k", ["the", "and", "to"], 2)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["k"], r["token"], r["unit"], tuple(r["around"])) for r in found.collect()) == [
        (1, "3", "cats", ("the", "3", "cats", "and")), (1, "4", ",", ("cats", "and", "4", ",", "5")), (3, "7", None, ("to", "a", "7"))]


@pytest.mark.parametrize("jumps, few, many", [(2, 100_000, 1_000_000), (0, 0, 3)])
def test_categories_deal_their_rows_a_fixed_number_of_times(spark, monkeypatch, jumps, few, many):
    """Only ties that are left between names are contracted, not the edges of all rows, and nulls link nothing."""
    from acrework.operators import graph as G

    rng, lines = np.random.default_rng(jumps), []
    for i in range(400):
        cat, spread = "ab"[i % 2], (40, 400)[i % 2]
        lines.append((cat, int(rng.integers(0, 150)), *(int(v) if rng.random() > 0.1 else None for v in rng.integers(0, spread, 2))))
    order = rng.permutation(80).tolist()
    lines += [("c", order[i // 2], None if i % 2 else order[i // 2] // 2, order[(i + 1) // 2]) for i in range(150)]
    lines += [("d", i, i // 2, (i + 1) // 2) for i in range(70)] + [("d", 500, None, None), ("d", 3, None, None), (None, 1, 1, 1), ("d", None, 1, 1)]
    near = {}
    for cat, item, p, s in lines:
        for column, value in (("p", p), ("s", s)):
            if None not in (cat, item, value):
                near.setdefault((cat, "i", item), set()).add((cat, column, value))
                near.setdefault((cat, column, value), set()).add((cat, "i", item))
    label, sizes = {}, {}
    for start in sorted(k for k in near if k[1] == "i"):
        if start in label:
            continue
        met, ahead = {start}, [start]
        while ahead:
            ahead = [k for k in {k for a in ahead for k in near[a]} - met]
            met.update(ahead)
        label.update({k: start[2] for k in met})
        sizes[start[0], start[2]] = (sum(k[1] == "i" for k in met), sum(k[1] == "p" for k in met))
    contracted, plain, join = [], G.contracted_components, G.join_groups
    monkeypatch.setattr(G, "JUMPS", jumps)
    monkeypatch.setattr(G, "FEW", few)
    monkeypatch.setattr(G, "join_groups", lambda *args: join(*args, many=many))
    monkeypatch.setattr(G, "contracted_components", lambda df, **kw: contracted.append(df.count()) or plain(df, **kw))
    df = spark.createDataFrame(lines, "cat string, item long, p long, s long")
    found = G.category_sizes(df, "cat", "item", ["p", "s"]).collect()
    assert len(found) == len(sizes) and {(r["cat"], r["label"]): (r["items"], r["values"]) for r in found} == sizes
    assert sum(contracted) < len(lines) / 2
    rows = G.category_components(df, "cat", "item", ["p", "s"]).collect()
    expected = [(*r, label[r[0], "i", r[1]]) for r in lines if None not in r[:2] and (r[0], "i", r[1]) in label]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    if jumps:
        one = G.category_sizes(df.filter("cat = 'a'"), "cat", "item", ["s"]).collect()
        assert sum(r["items"] for r in one) == len({r[1] for r in lines if r[0] == "a" and r[3] is not None})
        assert G.category_sizes(df.limit(0), "cat", "item", ["p", "s"]).count() == 0
