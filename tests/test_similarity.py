"""The pivot index against exhaustive search, and how much it leaves out."""

import numpy as np
import pytest

from acrework.operators import similarity as S


def exhaustive(vectors, k):
    ids = np.asarray([i for i, _ in vectors])
    v = np.asarray([x for _, x in vectors], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        c = np.round(u @ u[i], 12)
        c[i] = -9
        out[int(ids[i])] = [int(j) for j in ids[np.lexsort((ids, -c))[: min(k, len(ids) - 1)]]]
    return out


@pytest.mark.parametrize("kind", ["clusters", "random"])
def test_equals_exhaustive_search(spark, kind, monkeypatch):
    monkeypatch.setattr(S, "ROWS_EACH", 150)
    monkeypatch.setattr(S, "QUERIES_EACH", 7)
    rng = np.random.default_rng(6)
    middle = rng.normal(0, 1, (40, 32))
    v = middle[rng.integers(0, 40, 3000)] + rng.normal(0, 0.05, (3000, 32)) if kind == "clusters" else rng.normal(0, 1, (1500, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(4000 + i, v[7].tolist()) for i in range(300)]
    odd = [(9000, None), (9020, [0.0] * 32), (9040, [float("nan")] * 32), (9060, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    compared = []
    found = S.nearest_by_cosine(df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), df, "query_id", "vec_id", "embedding", 3, compared)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    expected = exhaustive(rows, 3)
    assert set(got) == set(expected)
    u = {i: np.asarray(x) / np.linalg.norm(x) for i, x in rows}
    for q, own in expected.items():  # rows that tie in all but rounding may change places
        assert np.allclose([u[q] @ u[i] for i in got[q]], [u[q] @ u[i] for i in own], atol=1e-12) and len(got[q]) == 3
    every = len(expected) * len(rows)
    assert compared[0] <= every and (kind == "random" or compared[0] < every / 10)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-201]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    ask = lambda rows: S.nearest_by_cosine(rows.withColumnRenamed("vec_id", "query_id"), df, "query_id", "vec_id", "embedding", 3)
    assert [(r["vec_id"], round(r["score"], 6)) for r in ask(df.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 0.995037), (2, -1.0)]
    assert ask(df.limit(0)).count() == 0
    assert S.nearest_by_cosine(df.withColumnRenamed("vec_id", "query_id"), df.limit(0), "query_id", "vec_id", "embedding", 3).count() == 0
