"""Queries that SQL does not express against brute force over whole tables, and geometry and quantiles against plain versions."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from acrework.operators import aggregates as A
from acrework.operators import geometry as G
from acrework.operators import text as X
from acrework.plans import QUERIES

SF = "/root/testdata/sf0.001"


def components(links):
    """The least item that each item reaches over (item, entity) links."""
    of = defaultdict(list)
    for item, entity in links:
        of[entity].append(item)
    near = defaultdict(set)
    for items in of.values():
        for i in items:
            near[i].update(items)
    found = {}
    for i in sorted(near):
        if i in found:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in found:
                found[j] = i
                stack += near[j]
    return found


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").collect()


def test_shared_members_over_the_table(spark, lines):
    found = components([(r["l_orderkey"], r["l_partkey"]) for r in lines])
    size, orders = defaultdict(int), defaultdict(set)
    for c in found.values():
        size[c] += 1
    for r in lines:
        orders[r["l_partkey"]].add(r["l_orderkey"])
    linking = defaultdict(int)
    for own in orders.values():
        if len(own) > 1:
            linking[found[next(iter(own))]] += 1
    expected = sorted((i, c, size[c], linking[c]) for i, c in found.items() if size[c] > 1)
    got = QUERIES["n01_shared_member_components"](spark, SF).collect()
    assert sorted((r["item"], r["component"], r["size"], r["linking"]) for r in got) == expected


def test_category_components_over_the_table(spark, lines):
    links = []
    for r in lines:
        node = (r["l_returnflag"], r["l_orderkey"])
        links += [(node, (r["l_returnflag"], 0, r["l_partkey"])), (node, (r["l_returnflag"], 1, r["l_suppkey"] * 1000 + r["l_linenumber"]))]
    found, cases, places = components(links), defaultdict(set), defaultdict(set)
    for r in lines:
        label = found[r["l_returnflag"], r["l_orderkey"]][1]
        cases[r["l_returnflag"], label].add(r["l_orderkey"])
        places[r["l_returnflag"], label].add(r["l_partkey"])
    got = QUERIES["n02_components_within_category"](spark, SF).collect()
    assert {(r["cat"], r["label"]): (r["cases"], r["places"]) for r in got} == {k: (len(v), len(places[k])) for k, v in cases.items()}


@pytest.fixture(scope="module")
def tokens(spark):
    docs = defaultdict(list)
    for r in X.tokens(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").collect():
        docs[r["doc_id"]].append((r["pos"], r["token"], r["kind"]))
    return {d: sorted(t) for d, t in docs.items()}


def test_neighbourhoods_over_the_table(spark, tokens):
    expected = []
    for d, own in tokens.items():
        for i, (pos, token, kind) in enumerate(own):
            around = {t.lower() for _, t, _ in own[max(0, i - 2) : i + 3]}
            if kind == "number" and around & {"the", "and", "to"}:
                expected.append((d, pos, token, own[i + 1][1] if i + 1 < len(own) else None))
    got = QUERIES["x11_temporal_neighbourhood"](spark, SF).select("doc_id", "pos", "token", "unit").collect()
    assert expected and sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_name_runs_over_the_table(spark, tokens):
    expected = []
    for d, own in tokens.items():
        run = []
        for pos, token, kind in [*own, (-1, "", "end")]:
            if kind == "word" and (token[0].isupper() and (token[0].isascii() or "À" <= token[0] <= "Þ")):
                run.append((pos, token))
                continue
            if len(run) >= 2:
                expected.append((d, run[0][0], len(run), " ".join(t for _, t in run)))
            run = []
    got = QUERIES["x12_proper_name_runs"](spark, SF).select("doc_id", "pos", "words", "name").collect()
    assert expected and sorted(map(tuple, got)) == sorted(expected)


def test_phrases_over_the_table(spark, tokens):
    expected = []
    for d, own in tokens.items():
        sentence, begin, spans = 0, 0, []
        for i, (_, token, _) in enumerate(own):
            if token in (".", "!", "?"):
                spans.append((sentence, own[begin : i + 1]))
                sentence, begin = sentence + 1, i + 1
        spans.append((sentence, own[begin:]))
        for n, span in spans:
            for i, (pos, token, _) in enumerate(span):
                if token.lower() in ("is", "was"):
                    cut = max((j + 1 for j in range(i) if span[j][1] == ","), default=0)
                    words = lambda part: " ".join(t for _, t, k in part if k != "punctuation")
                    expected.append((d, pos, n, token, words(span[cut:i]), words(span[i + 1 :])))
    got = QUERIES["x13_phrases_around_modals"](spark, SF).select("doc_id", "pos", "sentence", "modal", "subject", "predicate").collect()
    assert expected and sorted(map(tuple, got)) == sorted(expected)


def test_hulls_over_the_table(spark):
    points = [(r["s_suppkey"] * 53 % 997, r["s_suppkey"] * 71 % 991, r["s_suppkey"] % 4) for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()]
    for r in QUERIES["g21_hull_comparison"](spark, SF).collect():
        own = [(x, y) for x, y, g in points if g == r["g"]]
        cells = {(x // 20, y // 20) for x, y in own}
        assert r["raster"] == 400 * len(cells)
        disc = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
        grown = {(x + i, y + j) for x, y in cells for i, j in disc}
        closed = {c for c in grown if all((c[0] + i, c[1] + j) in grown for i, j in disc)}
        assert r["buffer"] == 400 * len(grown) and r["morph"] == 400 * len(closed)
        assert math.isclose(r["morph_to_buffer"], len(closed) / len(grown)) and (r["morph_to_hull"] is None) == (r["hull"] == 0)
        # an edge of the hull has all points on one side; the edges' triangles with any point add up to its area
        area = 0.0
        if len(own) >= 3:
            for a in own:
                for b in own:
                    side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in own]
                    between = all((p[0] - a[0]) * (p[0] - b[0]) + (p[1] - a[1]) * (p[1] - b[1]) <= 0 for p, s in zip(own, side) if s == 0)
                    if a != b and min(side) >= 0 and between:
                        area += (a[0] * b[1] - b[0] * a[1]) / 2
        assert math.isclose(r["hull"], area, abs_tol=1e-6)


def test_points_within_keeps_nulls_and_equal_rows(spark):
    ell = [(0, 0), (100, 0), (100, 40), (40, 40), (40, 100), (0, 100), (0, 0)]
    ring = F.array(*(G.point(float(x), F.lit(float(y))) for x, y in ell))
    areas = spark.range(1).select(F.lit("L").alias("name"), ring.alias("ring"))
    points = spark.createDataFrame([(1, 10.0, 90.0, None), (2, 90.0, 90.0, "x"), (3, 50.0, 20.0, "x"), (3, 50.0, 20.0, "x"), (4, None, 20.0, None)], "id int, x double, y double, note string")
    got = sorted((r["id"], r["r_name"], r["note"]) for r in G.points_within(points, "x", "y", areas, "ring", 30.0).collect())
    assert got == [(1, "L", None), (2, None, "x"), (3, "L", "x"), (3, "L", "x"), (4, None, None)]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 1, 501).round(1), "b": np.array([4.0]), None: rng.integers(0, 3, 40).astype(float), "c": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["quantiles"]) for r in A.exact_quantiles(df, ["k"], "v", [0.5, 0.01, 1.0]).collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        assert got[k][0] == len(own) and np.allclose(got[k][1], np.quantile(own, [0.5, 0.01, 1.0]))
    every = np.concatenate(list(groups.values()))
    assert np.allclose(A.exact_quantiles(df, [], "v", [0.25]).first()["quantiles"], np.quantile(every, 0.25))
    assert A.exact_quantiles(df.filter("v > 99"), [], "v", [0.5]).count() == 0
    assert A.agreement(df.limit(0).withColumn("w", F.col("v")), "v", "w", [1]).first()["n"] == 0


def test_written_tables_are_deleted(spark):
    from acrework.functions.storage import delete_written, written

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    df, path = written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "some")
    assert df.count() == 3 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
    delete_written(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(path).count()


def test_written_alone_leaves_tables_of_other_threads(spark):
    from threading import Event, Thread

    from acrework.functions.storage import written, written_alone

    begun, done, theirs, own = Event(), Event(), [], []

    def other():
        begun.wait(60)
        theirs.append(written(spark.range(5), "theirs"))
        done.set()

    def stage():
        own.append(written(spark.range(7), "own"))
        inner = written_alone(lambda: written(own[0][0].filter("id < 6"), "inner")[0], spark, "inner-result")
        begun.set()
        done.wait(60)
        return inner.filter("id > 1")

    thread = Thread(target=other)
    thread.start()
    result = written_alone(stage, spark, "result")
    thread.join()
    assert result.count() == 4 and theirs[0][0].count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(own[0][1]).count()


def test_exact_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(9)
    groups = {1: rng.normal(0, 1, 60_000), 2: np.repeat([1.0, 2.0, 9.0], 10_000), 3: rng.exponential(1, 7), None: rng.integers(0, 50, 20_000).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, own in groups.items() for v in own], "k int, v double").repartition(7)
    probabilities = [0.9, 0.0, 0.5, 0.25, 1.0, 0.333]
    for r in A.exact_quantiles(df, ["k"], "v", probabilities).collect():
        assert r["n"] == len(groups[r["k"]]) and np.allclose(r["quantiles"], np.quantile(groups[r["k"]], probabilities), atol=1e-12)
    every = np.concatenate(list(groups.values()))
    assert np.allclose(A.exact_quantiles(df, [], "v", probabilities).first()["quantiles"], np.quantile(every, probabilities), atol=1e-12)


def test_exact_quantiles_where_a_bracket_misses(spark, monkeypatch):
    monkeypatch.setattr(A.F, "percentile_approx", lambda column, at, accuracy: A.F.array(*(A.F.min(column) for _ in at)))  # brackets of nothing
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(100)], "k int, v double")
    found = {r["k"]: r["quantiles"] for r in A.exact_quantiles(df, ["k"], "v", [0.5, 0.75]).collect()}
    assert found == {0: [49.0, 73.5], 1: [50.0, 74.5]}
    assert A.exact_quantiles(df, [], "v", [0.5]).first()["quantiles"] == [49.5]
