"""Nearest points against brute force, wherever they lie, and how many pairs of points are measured for it."""

import math
import random

import pytest

from acrework.operators import geometry as G


def frame(spark, rows, key):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], f"{key} long, x double, y double")


def rows_joined(plan):
    """Rows that the joins of an executed plan made."""
    name, below = plan.getClass().getSimpleName(), []
    if name == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return own + sum(map(rows_joined, below))


def test_crowded_points_are_not_all_measured(spark):
    """Two thousand points in one cell, and lots far from them: all pairs were measured, 2 million (F2)."""
    rng = random.Random(2)
    streets = [(80 * rng.random(), 80 * rng.random()) for _ in range(2000)]
    lots = [(rng.uniform(-30000, 30000), rng.uniform(-30000, 30000)) for _ in range(1000)]
    found = G.nearest(frame(spark, lots, "k"), frame(spark, streets, "id"), "k", "id", 80.0)
    got = {r["k"]: (r["distance"], r["id"]) for r in found.collect()}
    apart = lambda p, q: math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))
    assert got == {k: min((apart(p, q), i) for i, q in enumerate(streets)) for k, p in enumerate(lots)}
    assert rows_joined(found._jdf.queryExecution().executedPlan()) < 200_000


@pytest.mark.parametrize("most", [None, 60.0])
def test_nearest_is_that_of_brute_force(spark, most, monkeypatch):
    """Clusters, ties on a lattice, points on one line, a crowd in one place, and from far; by grids of several levels."""
    monkeypatch.setattr(G, "CELL_PAIRS", 300)
    rng = random.Random(1)
    wide = lambda: (rng.uniform(-50000, 50000), rng.uniform(-50000, 50000))
    lattice = lambda: (float(rng.randint(0, 30)), float(rng.randint(0, 30)))
    crowd = lambda: (5 + rng.random() * 1e-4, 7 + rng.random() * 1e-4)
    line = lambda: (float(rng.randint(0, 400)), 0.0)
    lots = [rng.choice((wide, lattice, crowd, line))() for _ in range(400)] + [(None, 1.0)]
    streets = [rng.choice((wide, lattice, crowd, line))() for _ in range(400)] + [(2.0, None)]
    got = {r["k"]: (r["distance"], r["id"]) for r in G.nearest(frame(spark, lots, "k"), frame(spark, streets, "id"), "k", "id", 80.0, most).collect()}
    apart = lambda p, q: math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))
    every = {k: min((apart(p, q), i) for i, q in enumerate(streets[:-1])) for k, p in enumerate(lots[:-1])}
    assert got == {k: v for k, v in every.items() if most is None or v[0] <= most}
