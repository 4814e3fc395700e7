"""Parts and holes of cell sets against a flood fill; a set for each key as if it stood alone."""

import random

import pytest

from acrework.operators import raster as Ra


def parts_of(cells):
    left, parts = set(cells), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            x, y = todo.pop()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.discard(n)
                    part.add(n)
                    todo.append(n)
        parts.append(part)
    return parts


def holes_of(cells):
    if not cells:
        return []
    xs, ys = [x for x, _ in cells], [y for _, y in cells]
    ground = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)} - set(cells)
    return [p for p in parts_of(ground) if (min(xs) - 1, min(ys) - 1) not in p]


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(5)
    made = {k: {(rng.randrange(-6, 8), rng.randrange(-6, 8)) for _ in range(n)} for k, n in (("a", 40), ("b", 120), ("c", 190), ("d", 3))}
    made["ring"] = {(x, y) for x in range(9) for y in range(9)} - {(x, y) for x in range(2, 7) for y in range(2, 7)} | {(4, 4)}
    made["apart"] = {(0, 0), (0, 100), (70, 50)}
    return made


@pytest.fixture(scope="module")
def cells(spark, sets):
    rows = [(k, x, y) for k, own in sets.items() for x, y in own]
    return spark.createDataFrame(rows + rows[:5], "k string, cx bigint, cy bigint")


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append((r["cx"], r["cy"]))
    assert all(len(v) == len(set(v)) for v in out.values())
    return {k: set(v) for k, v in out.items()}


def test_islands(cells, sets):
    got = by_key(Ra.drop_islands(cells, 0.3, ["k"]))
    for k, own in sets.items():
        parts = parts_of(own)
        main = max(map(len, parts))
        assert got[k] == set().union(*(p for p in parts if len(p) >= 0.3 * main)), k


def test_holes(cells, sets):
    found = {}
    for r in Ra.holes(cells, ["k"]).collect():
        found.setdefault((r["k"], r["hole"]), set()).update((x, r["cy"]) for x in range(r["x0"], r["x1"] + 1))
    for k, own in sets.items():
        assert sorted(sorted(h) for (key, _), h in found.items() if key == k) == sorted(map(sorted, holes_of(own))), k
    filled = by_key(Ra.fill_holes(cells, 0.1, ["k"]))
    for k, own in sets.items():
        main = max(map(len, parts_of(own)))
        assert filled[k] == own.union(*(h for h in holes_of(own) if len(h) < 0.1 * main)), k


def test_one_set_and_no_cells(spark, cells, sets):
    one = cells.filter("k = 'b'").select("cx", "cy")
    main = max(map(len, parts_of(sets["b"])))
    got = {(r["cx"], r["cy"]) for r in Ra.fill_holes(one, 2.0).collect()}
    assert got == sets["b"].union(*(h for h in holes_of(sets["b"]) if len(h) < 2 * main))
    none = one.limit(0)
    assert Ra.drop_islands(none, 0.5).count() == 0 and Ra.fill_holes(none, 0.5).count() == 0 and Ra.open_cells(none, 1).count() == 0
