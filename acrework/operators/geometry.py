"""Planar geometry on native columns: rings are arrays of (x, y) structs, closed by their first point.

Spatial joins meet in grid cells.  A pair of boxes meets in every cell that both touch; it is kept only in the cell of
the lower left corner of their common box, so no pair is built twice and nothing is deduplicated by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrework.functions.storage import cut_lineage
from acrework.operators.components import connected_components

BOX = ("xmin", "ymin", "xmax", "ymax")
RING = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), y.cast("double").alias("y") if isinstance(y, Column) else F.lit(y).cast("double").alias("y"))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Closed counter-clockwise ring of a box."""
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin))


def _pairs(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + f(e["a"], e["b"]))


def signed_area(ring: Column) -> Column:
    return _total(_pairs(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def length(ring: Column) -> Column:
    return _total(_pairs(ring), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def centroid(ring: Column) -> Column:
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    six = 6 * signed_area(ring)
    return point(_total(_pairs(ring), lambda a, b: (a["x"] + b["x"]) * cross(a, b)) / six, _total(_pairs(ring), lambda a, b: (a["y"] + b["y"]) * cross(a, b)) / six)


def with_box(df: DataFrame, ring: str) -> DataFrame:
    """Adds the box of a ring as four columns."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return df.withColumns(dict(zip(BOX, (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test; points on lower and left edges count as inside, on upper and right ones not."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(_pairs(ring), crosses)) % 2 == 1


def edges(df: DataFrame, ring: str) -> DataFrame:
    """One row for each edge of positive length: pos, x1, y1, x2, y2, edge_length, angle (degrees modulo 180)."""
    out = df.select("*", F.posexplode(_pairs(F.col(ring))).alias("pos", "_e")).select(*df.columns, "pos", F.col("_e.a.x").alias("x1"), F.col("_e.a.y").alias("y1"), F.col("_e.b.x").alias("x2"), F.col("_e.b.y").alias("y2"))
    out = out.withColumn("edge_length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).filter("edge_length > 0")
    return out.withColumn("angle", edge_angle(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


def edge_angle(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def angle_difference(a: Column, b: Column) -> Column:
    """Smallest difference of two directions modulo 180 degrees."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


#: Cells along one side of a box beyond which it is kept in a coarser grid.
MOST_SPAN = 4


def _level(cell: float) -> Column:
    """The grid of a box: each level doubles the cell, so that no box touches more than (MOST_SPAN + 1)² cells of its own."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return F.greatest(F.lit(0), F.ceil(F.log2(side / (MOST_SPAN * cell))).cast("int"))


def _levels(cell: float, *boxed: DataFrame) -> list[int]:
    """Grids in use: one for each doubling of size between the shapes, mostly a single one."""
    return sorted({r[0] for df in boxed for r in df.select(_level(cell).alias("l")).distinct().collect()}) or [0]


def in_cells(df: DataFrame, cell: float, levels: Sequence[int]) -> DataFrame:
    """One row for each cell (level, cx, cy) that a box touches, in its own grid (column ``own``) and in coarser ones."""
    rows = df.withColumn("own", _level(cell)).withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col("own"))))
    spread = lambda lo, hi: F.sequence(_cell(F.col(lo), cell), _cell(F.col(hi), cell))
    return rows.withColumn("cx", F.explode(spread("xmin", "xmax"))).withColumn("cy", F.explode(spread("ymin", "ymax")))


def _cell(at: Column, cell: float) -> Column:
    return F.floor(at / (F.pow(F.lit(2.0), F.col("level")) * cell))


def box_pairs(left: DataFrame, right: DataFrame, cell: float, same: str | None = None) -> DataFrame:
    """Pairs of rows whose boxes meet, each once; right columns get the prefix ``r_``.

    With ``same``, rows that differ in this column are no pairs but by chance (it is compared by its hash).

    Two boxes meet in the coarser of their grids, so ``cell`` should suit the small shapes; large ones cost no more.
    """
    levels = _levels(cell, left, right)
    by = [F.xxhash64(same).alias("_same")] if same else []
    other = in_cells(right, cell, levels).select("level", "cx", "cy", *by, F.col("own").alias("_r_own"), *(F.col(c).alias(f"r_{c}") for c in right.columns))
    joined = in_cells(left, cell, levels).select("*", *by).join(other, ["level", "cx", "cy", *(["_same"] if same else [])]).filter(F.col("level") == F.greatest("own", "_r_own"))
    low_x, low_y = F.greatest("xmin", "r_xmin"), F.greatest("ymin", "r_ymin")
    meets = (F.col("xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("ymax"))
    return joined.filter(meets & (_cell(low_x, cell) == F.col("cx")) & (_cell(low_y, cell) == F.col("cy"))).select(*left.columns, *(f"r_{c}" for c in right.columns))


def equal_shapes(shapes: DataFrame, key: str, ring: str) -> tuple[DataFrame, DataFrame]:
    """One row for each different shape with the least key among its equals, and which shape each key has (``key``, ``shape``, ``n`` equals)."""
    first = cut_lineage(shapes.select(key, ring, F.xxhash64(ring).alias("_hash")), "shapes")
    least = first.groupBy("_hash", ring).agg(F.min(key).alias("shape"), F.count("*").alias("n"))
    member = first.join(least.withColumnRenamed(ring, "_ring"), "_hash").filter(F.col(ring) == F.col("_ring")).select(key, "shape", "n")
    return least.select(F.col("shape").alias(key), ring), member


def points_within(points: DataFrame, x: str, y: str, polygons: DataFrame, ring: str, cell: float) -> DataFrame:
    """Left join of points to the polygons that contain them; polygon columns get the prefix ``r_``.

    Equal rows stay rows of their own; a point with a null coordinate, or in no polygon, has nulls beside it.
    """
    boxed = with_box(polygons, ring)
    levels = _levels(cell, boxed)
    mine = in_cells(boxed, cell, levels).filter("level = own")
    there = mine.select(F.col("level").alias("_pl"), F.col("cx").alias("_px"), F.col("cy").alias("_py"), *(F.col(c).alias(f"_p_{c}") for c in BOX), *(F.col(c).alias(f"r_{c}") for c in polygons.columns))
    inside = F.col(x).between(F.col("_p_xmin"), F.col("_p_xmax")) & F.col(y).between(F.col("_p_ymin"), F.col("_p_ymax")) & contains_point(F.col(f"r_{ring}"), F.col(x), F.col(y))
    columns = [*points.columns, *(f"r_{c}" for c in polygons.columns)]

    def met(rows: DataFrame, level: int, how: str) -> DataFrame:
        size = cell * 2.0**level
        here = (F.col("_pl") == level) & (F.floor(F.col(x) / size) == F.col("_px")) & (F.floor(F.col(y) / size) == F.col("_py"))
        return rows.join(there, here & inside, how).select(*columns)

    if len(levels) == 1:  # a point lies in one cell, so the outer join itself keeps every row as often as it should be
        return met(points, levels[0], "left")
    found = met(points, levels[0], "inner")
    for level in levels[1:]:
        found = found.union(met(points, level, "inner"))
    seen = found.select(F.col(x).alias("_sx"), F.col(y).alias("_sy")).distinct()
    alone = points.join(seen, (F.col(x) == F.col("_sx")) & (F.col(y) == F.col("_sy")), "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


#: Pairs that a task measures; they are few bytes and much work, so that file sizes would not deal them out.
PAIRS_EACH = 4_000


def spread(pairs: DataFrame, name: str) -> DataFrame:
    """The pairs, written and dealt to tasks by their number."""
    found = cut_lineage(pairs, name)
    return found.repartition(max(1, -(-found.count() // PAIRS_EACH)))


#: Rows of a small file that a task takes where each is much work.
ROWS_EACH = 10_000


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows (``rows`` is their number, if it is known without them), dealt to tasks by their number, not their bytes."""
    return df.repartition(max(1, -(-(df.count() if rows is None else rows) // ROWS_EACH)))


def box_overlap() -> Column:
    """Area common to the two boxes of a pair."""
    side = lambda a: F.greatest(F.least(f"{a}max", f"r_{a}max") - F.greatest(f"{a}min", f"r_{a}min"), F.lit(0.0))
    return side("x") * side("y")


def material_overlaps(left: DataFrame, right: DataFrame, cell: float, least_area: float = 10.0, least_share: float = 0.02, ring: str | None = None) -> DataFrame:
    """Overlaps with enough area and enough share of the left shape: of the polygons ``ring``, or of boxes without it."""
    pairs = box_pairs(left, right, cell).withColumn("overlap", box_overlap())
    own = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    if ring:  # polygons never share more than their boxes, so few pairs reach the kernel
        from acrework.operators.polygons import common_area

        pairs = spread(pairs.filter(F.col("overlap") >= least_area), "box-pairs").withColumn("overlap", common_area(F.col(ring), F.col(f"r_{ring}")))
        own = area(F.col(ring))
    return pairs.withColumn("share", F.col("overlap") / F.nullif(own, F.lit(0.0))).filter((F.col("overlap") >= least_area) & (F.col("share") >= least_share))


#: Keys of equal shapes in one list, left and right; right keys that follow each left one (a multiple of 8, as Parquet packs
#: so many values together); and pairs of keys that a task makes.
LEFT_EACH, RIGHT_EACH, RUN, KEYS_EACH = 1_024, 4_096, 256, 10_000_000


def _key_lists(members: DataFrame, key: str, shape: str, n: str, each: int) -> tuple[DataFrame, DataFrame]:
    """The keys of each shape in lists (``_list``, ``_keys``) of about ``each``, and how many keys a shape has (``_n``)."""
    dealt = members.withColumn("_list", F.pmod(F.xxhash64(key), F.ceil(F.col(n) / each)))
    lists = cut_lineage(dealt.groupBy(shape, "_list").agg(F.collect_list(key).alias("_keys")), "key-lists")
    return lists, lists.groupBy(shape).agg(F.sum(F.size("_keys").cast("bigint")).alias("_n"))


def key_pairs(met: DataFrame, lefts: DataFrame, rights: DataFrame, key: str, shape: str, n: str) -> DataFrame:
    """Each pair of shapes (``shape``, ``r_shape``) as the pairs of all their keys (``key``, ``r_key``).

    ``lefts`` and ``rights`` are the shape of every key and the number ``n`` of its equals.  Keys travel in lists and become
    rows last, dealt to tasks by the number of these rows.  A left key meets a few right ones in a run of rows, and the
    next key the same ones: files hold runs and repeats, and a task has few different keys, so that the rows, though
    many, are few bytes.
    """
    r_key, r_shape = f"r_{key}", f"r_{shape}"
    left, lefts_n = _key_lists(lefts, key, shape, n, LEFT_EACH)
    right, rights_n = _key_lists(rights, r_key, r_shape, f"r_{n}", RIGHT_EACH)
    met = cut_lineage(met, "met-shapes")
    rows = met.join(lefts_n, shape).groupBy(r_shape).agg(F.sum("_n").alias("_l")).join(rights_n, r_shape).select(r_shape, (F.col("_l") * F.col("_n")).alias("_rows"))
    shares = cut_lineage(rows.withColumn("_shares", F.ceil(F.col("_rows") / KEYS_EACH)), "key-shares")
    tasks = max(1, -(-int(shares.agg(F.sum(F.col("_rows").cast("decimal(38,0)"))).first()[0] or 0) // KEYS_EACH))
    by = [r_shape, "_share"]
    share = F.pmod(F.xxhash64(shape, "_list"), "_shares").alias("_share")
    units = met.join(left, shape).join(shares, r_shape).select(*met.columns, F.col("_keys").alias("_left"), share).repartition(tasks, *by)
    copies = right.join(shares, r_shape).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1)))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_keys") - 1) / RUN).cast("int")), lambda i: F.slice("_keys", i * RUN + 1, RUN))
    others = copies.select(r_shape, "_share", F.explode(runs).alias("_right")).repartition(tasks, *by)
    lists = units.join(others.hint("merge"), by).drop("_share").withColumn(key, F.explode("_left")).drop("_left")
    parts = max(tasks, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # as many as there are: it only ends
    return lists.coalesce(parts).withColumn(r_key, F.explode("_right")).drop("_right")  # the loop, which would hold all rows of a list


def _apart(x: str, y: str, u: str, v: str) -> Column:
    """Distance of two points; equal sums of squares give equal distances, so that ties are ties."""
    dx, dy = F.col(x) - F.col(u), F.col(y) - F.col(v)
    return F.sqrt(dx * dx + dy * dy)


def densify(df: DataFrame, x1: str, y1: str, x2: str, y2: str, step: float) -> DataFrame:
    """Points (x, y) along each segment, its ends among them, evenly spaced and no more than ``step`` apart."""
    dx, dy = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    pieces = F.greatest(F.ceil(F.hypot(dx, dy) / step), F.lit(1))
    rows = df.withColumns({"_n": pieces, "_dx": dx, "_dy": dy}).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces)))
    at = {"x": F.col(x1) + F.col("_dx") * F.col("_i") / F.col("_n"), "y": F.col(y1) + F.col("_dy") * F.col("_i") / F.col("_n")}
    return rows.withColumns(at).drop("_n", "_dx", "_dy", "_i")


def widest_lines(df: DataFrame, line: str, width: str, ties: Sequence[str]) -> DataFrame:
    """One row for each line of points, whichever way it runs: the widest, then the least by ``ties``."""
    same = F.least(F.col(line), F.reverse(F.col(line)))
    order = Window.partitionBy("_same").orderBy(F.desc_nulls_last(width), *ties)
    return df.withColumn("_same", same).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_same", "_r")


def _segment_distance(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy
    return F.sqrt(ex * ex + ey * ey)


def rings_cross(left: Column, right: Column) -> Column:
    """Whether any two edges of two rings cross (touching does not count)."""
    turn = lambda a, b, p: F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))
    crosses = lambda e, f: (turn(e["a"], e["b"], f["a"]) * turn(e["a"], e["b"], f["b"]) < 0) & (turn(f["a"], f["b"], e["a"]) * turn(f["a"], f["b"], e["b"]) < 0)
    return F.exists(_pairs(left), lambda e: F.exists(_pairs(right), lambda f: crosses(e, f)))


def point_gap(point: Column, ring: Column) -> Column:
    """Distance of a point and the nearest edge of a ring."""
    return F.array_min(F.transform(_pairs(ring), lambda e: _segment_distance(point, e["a"], e["b"])))


def boundary_gap(left: Column, right: Column) -> Column:
    """Distance of the boundaries of two rings that do not cross."""
    gap = lambda points, ring: F.array_min(F.transform(points, lambda p: point_gap(p, ring)))
    return F.least(gap(left, right), gap(right, left))


def ring_distance(left: Column, right: Column) -> Column:
    """Distance of two polygons; zero where their edges cross or one lies in the other."""
    first = lambda ring: F.element_at(ring, 1)
    inside = contains_point(left, first(right)["x"], first(right)["y"]) | contains_point(right, first(left)["x"], first(left)["y"])
    return F.when(rings_cross(left, right) | inside, 0.0).otherwise(boundary_gap(left, right))


def contiguous_blocks(shapes: DataFrame, key: str, ring: str, tolerance: float, cell: float) -> DataFrame:
    """One row for each block of shapes that touch when each is grown by ``tolerance``.

    Columns: ``block`` (the least key), ``parts``, ``area`` (the sum of its shapes), ``x`` and ``y`` (its centroid, by
    area).  A shape that touches none is a block of its own; keys must be unique and not null.
    """
    blocks = block_members(shapes, key, ring, tolerance, cell)
    own, middle = area(F.col(ring)), centroid(F.col(ring))
    parts = dealt(shapes).select(F.col(key).alias("node"), own.alias("_a"), (own * middle["x"]).alias("_x"), (own * middle["y"]).alias("_y")).join(blocks.hint("merge"), "node")
    return parts.groupBy(F.col("component").alias("block")).agg(F.count("*").alias("parts"), F.sum("_a").alias("area"), (F.sum("_x") / F.sum("_a")).alias("x"), (F.sum("_y") / F.sum("_a")).alias("y"))


def block_members(shapes: DataFrame, key: str, ring: str, tolerance: float, cell: float) -> DataFrame:
    """``node`` and ``component``: each shape's key, and the least key of its block (see ``contiguous_blocks``).

    Equal shapes count once among the pairs; pairs are written and dealt out by number before they are measured.
    """
    known = shapes.select(F.col(key).alias("_id"), F.col(ring).alias("_ring"))
    equal = Window.partitionBy("_ring")
    first = cut_lineage(known.withColumn("_first", F.min("_id").over(equal)), "equal-shapes")
    boxed = with_box(first.filter("_id = _first").select("_id", "_ring"), "_ring").select("_id", "_ring", *((F.col(c) + (tolerance if c.endswith("max") else -tolerance)).alias(c) for c in BOX))
    pairs = spread(box_pairs(boxed, boxed.hint("merge"), cell).filter("_id < r__id").select("_id", "_ring", "r__id", "r__ring"), "box-pairs")
    near = pairs.filter(ring_distance(F.col("_ring"), F.col("r__ring")) <= 2 * tolerance).select(F.col("_id").alias("src"), F.col("r__id").alias("dst"))
    ties = cut_lineage(near.union(first.select("_id", "_first")), "near-shapes")  # each with itself, or its first equal
    return connected_components(ties)


def size_table(blocks: DataFrame, size: str, parts: str, member: str, limits: Sequence[float]) -> DataFrame:
    """For each least size: blocks of it or more, those of them that are members, and the median of their parts (0 for none).

    Blocks are written once, since finding them is most of the work.
    """
    from acrework.operators.aggregates import exact_quantiles

    least = F.array(*(F.lit(float(v)) for v in limits))
    blocks = cut_lineage(blocks.select(size, parts, member), "blocks")  # read several times
    rows = blocks.withColumn("least", F.explode(F.filter(least, lambda v: F.col(size) >= v)))
    counted = rows.groupBy("least").agg(F.count("*").alias("blocks"), F.count_if(F.col(member)).alias("members"))
    medians = exact_quantiles(rows, ["least"], parts, [0.5]).select("least", F.get("quantiles", 0).alias("median_parts"))
    every = blocks.sparkSession.createDataFrame([(float(v),) for v in limits], "least double")
    return every.join(counted, "least", "left").join(medians, "least", "left").fillna(0)


def _extent(points: DataFrame) -> tuple[int, float, float]:
    """The number of points (x, y), and width and height of their box."""
    n, wide, high = points.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return n, wide or 0.0, high or 0.0


#: Right points in a cell of the finest grid, left points that look for theirs together (of an average point's cell), and pairs
#: of cells that are looked at without a coarser grid.
RIGHT_CROWD, LEFT_CROWD, CELL_PAIRS = 4, 32, 2_000_000


def _crowd(points: DataFrame, size: float) -> float:
    """How many points the cell of an average point (x, y) has."""
    counts = points.groupBy(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).agg(F.count("*").cast("double").alias("_c"))
    return counts.agg(F.sum(F.col("_c") * F.col("_c")) / F.sum("_c")).first()[0] or 0.0


def _pyramid(points: DataFrame, size: float, first: int, top: int, prefix: str) -> list[DataFrame]:
    """Cells that hold points, by level from ``first`` to ``top``, each twice as coarse: place, box and one point of theirs."""
    x, y, a, b, c, d, p, q = (f"{prefix}{n}" for n in ("x", "y", "x1", "y1", "x2", "y2", "px", "py"))

    def joined(rows: DataFrame, *level: str) -> DataFrame:
        found = rows.groupBy(*level, x, y).agg(F.min(a).alias(a), F.min(b).alias(b), F.max(c).alias(c), F.max(d).alias(d), F.min(F.struct(p, q)).alias("_p"))
        return found.select(*level, x, y, a, b, c, d, f"_p.{p}", f"_p.{q}")

    at = {n: F.col(v) for n, v in ((a, "x"), (b, "y"), (c, "x"), (d, "y"), (p, "x"), (q, "y"))}
    place = {n: F.floor(F.col(v) / (size * 2.0**first)) for n, v in ((x, "x"), (y, "y"))}
    base, levels = joined(points.select(*(v.alias(n) for n, v in (at | place).items()))), []
    for low in range(first, top + 1, 4):
        steps = F.sequence(F.lit(0), F.lit(min(4, top - low)))
        up = {n: F.floor(F.col(n) / F.pow(F.lit(2.0), "level")) for n in (x, y)}
        stored = cut_lineage(joined(base.withColumn("level", F.explode(steps)).withColumns(up), "level"), "cells")
        of = lambda k, stored=stored: stored.filter(F.col("level") == k).drop("level")
        levels += [of(k) for k in range(min(4, top - low + 1))]
        base = of(4)  # only read if there are more levels
    return levels


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float, most: float | None = None) -> DataFrame:
    """The nearest right point (x, y) of each left point within ``most`` (None: however far), with ``distance``; ties to the least id.

    Both sides' cells form pyramids, each level twice as coarse, from so few cells that all pairs can be looked at down to a
    few points (``cell``, or finer where points crowd).  Left points of a cell look for theirs together.  A right cell is given up where a
    right point is nearer to each corner of the left cell's box, for it is nearer to all of the box then: the square of
    the distance to a cell, less that to a point, is concave, so that its least value over a box is in a corner.  So few pairs of cells
    are looked at, however far the nearest point is and however many there are.  Left ids must be unique; points without
    coordinates find nothing.
    """
    known = lambda df, *ids: df.filter("x IS NOT NULL AND y IS NOT NULL").select(*ids, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    mine = cut_lineage(known(left, left_id), "left-points")
    targets = cut_lineage(known(right, right_id).groupBy("x", "y").agg(F.min(right_id).alias(right_id)), "right-points")
    (n, wide, high), (r_n, r_wide, r_high) = _extent(mine), _extent(targets)
    usual = lambda n, wide, high, crowd: max(math.sqrt(wide * high * crowd / max(n, 1)), max(wide, high) * 1e-9)
    size = min(cell, usual(r_n, r_wide, r_high, RIGHT_CROWD) or cell)
    while size > max(r_wide, r_high) * 1e-9 and (crowd := _crowd(targets, size)) > 2 * RIGHT_CROWD:
        size /= 2.0 ** max(1, math.floor(math.log(crowd / RIGHT_CROWD, 4)))
    first = max(0, round(math.log2(max(usual(n, wide, high, LEFT_CROWD) / size, 1.0))))
    while first > 0 and (crowd := _crowd(mine, size * 2.0**first)) > 2 * LEFT_CROWD:
        first = max(0, first - max(1, math.floor(math.log(crowd / LEFT_CROWD, 4))))
    cells = lambda n, wide, high, level: min(n, (wide / (size * 2.0**level) + 2) * (high / (size * 2.0**level) + 2))
    top = first
    while cells(n, wide, high, top) * cells(r_n, r_wide, r_high, top) > CELL_PAIRS:
        top += 1
    lefts, rights = _pyramid(mine, size, first, top, "l"), _pyramid(targets, size, 0, top, "r")
    square = lambda a, b: a * a + b * b
    beyond = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0))
    x1, y1, x2, y2 = (F.col(f"l{n}") for n in ("x1", "y1", "x2", "y2"))
    box = [F.col(f"r{n}") for n in ("x1", "y1", "x2", "y2")]
    corners = [(x1, y1), (x2, y1), (x1, y2), (x2, y2)]
    margin = 1e-12 * square(x2 - x1, y2 - y1)

    def closest(rows: DataFrame) -> DataFrame:
        """Pairs of cells without those that the point nearest to the middle of the left box shows to be too far."""
        apart = F.greatest(box[0] - x2, x1 - box[2], F.lit(0.0)), F.greatest(box[1] - y2, y1 - box[3], F.lit(0.0))
        near = rows if most is None else rows.filter(square(*apart) <= most * most * (1 + 1e-9))
        middle = square((x1 + x2) / 2 - F.col("rpx"), (y1 + y2) / 2 - F.col("rpy"))
        near = near.withColumn("_b", F.min(F.struct(middle.alias("d"), F.col("rpx").alias("x"), F.col("rpy").alias("y"))).over(Window.partitionBy("lx", "ly")))
        least = lambda x, y: square(beyond(x, box[0], box[2]), beyond(y, box[1], box[3]))
        nearer = (least(x, y) <= square(x - F.col("_b.x"), y - F.col("_b.y")) * (1 + 4e-9) + margin for x, y in corners)
        return near.filter(reduce(lambda a, b: a | b, nearer)).select(*rows.columns)

    def inner(cells: DataFrame, side: str) -> DataFrame:
        """Cells with the place of the coarser one that holds them."""
        return cells.withColumns({f"_{side}x": F.shiftright(f"{side}x", 1), f"_{side}y": F.shiftright(f"{side}y", 1)})

    coarse = lambda rows, side: rows.withColumnsRenamed({f"{side}x": f"_{side}x", f"{side}y": f"_{side}y"})
    held = lambda side: [c for c in rights[0].columns] if side == "r" else [c for c in lefts[0].columns if c not in ("lpx", "lpy")]
    rows = closest(lefts[-1].select(*held("l")).crossJoin(rights[-1]))
    for level in range(top - 1, -1, -1):
        if level >= first:
            rows = coarse(rows.drop(*(c for c in held("l") if c not in ("lx", "ly"))), "l").join(inner(lefts[level - first].select(*held("l")), "l"), ["_lx", "_ly"]).drop("_lx", "_ly")
        rows = closest(coarse(rows.select(*held("l"), "rx", "ry"), "r").join(inner(rights[level], "r"), ["_rx", "_ry"]).drop("_rx", "_ry"))
        if level % 4 == 0:
            rows = cut_lineage(rows, "cell-pairs")
    place = lambda v, level: F.floor(F.col(v) / (size * 2.0**level))
    points = targets.select(right_id, place("x", 0).alias("rx"), place("y", 0).alias("ry"), *(F.col(n[-2] if n[-1] in "12" else n[-1]).alias(n) for n in ("rx1", "ry1", "rx2", "ry2", "rpx", "rpy")))
    found = cut_lineage(closest(rows.select(*held("l"), "rx", "ry").join(points, ["rx", "ry"])).select("lx", "ly", right_id, F.col("rpx").alias("_x"), F.col("rpy").alias("_y")), "near-points")
    met = mine.withColumns({"lx": place("x", first), "ly": place("y", first)}).join(found, ["lx", "ly"]).select(left_id, right_id, _apart("x", "y", "_x", "_y").alias("distance"))
    if most is not None:
        met = met.filter(F.col("distance") <= most)
    return met.groupBy(left_id).agg(F.min(F.struct("distance", right_id)).alias("_b")).select(left_id, "_b.distance", f"_b.{right_id}")


def link_streets(parcels: DataFrame, links: DataFrame, streets: DataFrame, key: str, street: str, cell: float, most: float | None = None) -> DataFrame:
    """The street of each parcel point (x, y) and its ``source``: ``address`` by ``links``, else ``nearest`` street point within ``most`` (None: however far).

    Parcels without either are left out.
    """
    by_address = parcels.select(key, "x", "y").join(links.select(key, street), key, "left")
    first = by_address.filter(F.col(street).isNotNull()).select(key, street, F.lit("address").alias("source"))
    rest = nearest(by_address.filter(F.col(street).isNull()).select(key, "x", "y"), streets.select(street, "x", "y"), key, street, cell, most)
    return first.union(rest.select(key, street, F.lit("nearest").alias("source")))


#: A parallel edge within so many feet of its street, and so many degrees, is sure.
PARALLEL, SURE_FEET, SURE_DEGREES = 35.0, 80.0, 15.0


def street_facing(edge_rows: DataFrame, key: str, street_angle: Column, distance: Column, keys: DataFrame | None = None) -> DataFrame:
    """One front edge for each key: nearly parallel to the street, then nearest, then longest; with confidence.

    ``high``: parallel, near and nearly straight; ``medium``: any other parallel edge; ``low``: no edge is parallel, so
    the nearest; ``not_evaluated``: no street, or for a key of ``keys`` no edge (all else is null then).
    """
    off = angle_difference(F.col("angle"), street_angle)
    rows = edge_rows.withColumns({"off": off, "distance": distance}).filter("off IS NOT NULL AND distance IS NOT NULL")
    order = Window.partitionBy(key).orderBy(F.desc(F.col("off") <= PARALLEL), "distance", F.desc("edge_length"), "pos")
    front = rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    if keys is not None:
        front = keys.select(key).distinct().join(front, key, "left")
    confidence = F.when(F.col("off").isNull(), "not_evaluated").when(F.col("off") > PARALLEL, "low").when((F.col("distance") <= SURE_FEET) & (F.col("off") <= SURE_DEGREES), "high").otherwise("medium")
    return front.withColumn("confidence", confidence)


def grid(spark, xmin: int, ymin: int, xmax: int, ymax: int, step: int) -> DataFrame:
    """Cell centres of a regular grid with ids."""
    columns, rows = -(-(xmax - xmin) // step), -(-(ymax - ymin) // step)
    cells = spark.range(columns * rows)
    return cells.select(F.col("id").alias("cell_id"), (xmin + step * (F.col("id") % columns + 0.5)).alias("x"), (ymin + step * (F.floor(F.col("id") / columns) + 0.5)).alias("y"))


def majority_cells(cells: DataFrame, polygons: DataFrame, ring: str, n: int, cell: float) -> DataFrame:
    """Cells whose centre at least n // 2 + 1 polygons cover; equal polygons are compared once and count each."""
    equal = polygons.filter(F.col(ring).isNotNull()).groupBy(ring).agg(F.count("*").alias("_n"))
    covered = points_within(cells, "x", "y", equal, ring, cell).groupBy("cell_id").agg(F.sum("r__n").alias("cover"))
    return covered.filter(F.col("cover") >= n // 2 + 1)


def line_box_clip(x1: Column, y1: Column, x2: Column, y2: Column, box: dict[str, float]) -> Column:
    """(t0, t1) of the part of a segment inside a box; null if nothing but a point is left."""
    low, high, valid = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, d, lo, hi in ((x1, x2 - x1, box["xmin"], box["xmax"]), (y1, y2 - y1, box["ymin"], box["ymax"])):
        safe = F.nullif(d, F.lit(0.0))
        ta, tb = (lo - a) / safe, (hi - a) / safe
        low, high = F.when(d == 0, low).otherwise(F.greatest(low, F.least(ta, tb))), F.when(d == 0, high).otherwise(F.least(high, F.greatest(ta, tb)))
        valid = valid & ((d != 0) | a.between(lo, hi))
    return F.when(valid & (high > low), F.struct(low.alias("t0"), high.alias("t1")))


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points kept by the distance-to-chord rule, the ends always."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        rel = points[a + 1 : b] - points[a]
        norm = math.hypot(*d)
        away = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / norm if norm else np.hypot(rel[:, 0], rel[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplify(df: DataFrame, ring: str, tolerance: float) -> DataFrame:
    """Replace each line by its simplification (NumPy kernel)."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            for i, line in pdf[ring].items():
                kept = simplify_line(np.array([(p["x"], p["y"]) for p in line]), tolerance) if line is not None and len(line) > 2 else None
                if kept is not None:
                    pdf.at[i, ring] = [{"x": float(x), "y": float(y)} for x, y in kept]
            yield pdf

    return df.mapInPandas(run, df.schema)


def hull(points: np.ndarray) -> list[tuple[float, float]]:
    """The convex hull (monotone chain), counter-clockwise; all different points where there are fewer than three."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull."""
    found = hull(points)
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(found, found[1:] + found[:1]))) / 2


def hull_areas(points: DataFrame, key: str) -> DataFrame:
    """Area of the convex hull of each key's points (x, y), as ``hull``: hulls of batches first, then hulls of hulls."""
    kind = points.schema[key].dataType.simpleString()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for value, own in pdf.groupby(key, dropna=False):
                yield pd.DataFrame(hull(own[["x", "y"]].to_numpy()), columns=["x", "y"]).assign(**{key: value})[[key, "x", "y"]]

    reduced = points.select(key, "x", "y").mapInPandas(parts, f"{key} {kind}, x double, y double")
    return reduced.groupBy(key).applyInPandas(lambda p: p.iloc[:1][[key]].assign(hull=hull_area(p[["x", "y"]].to_numpy())), f"{key} {kind}, hull double")


#: Radius of the sphere of web maps, and its half circumference.
WEB_RADIUS, WEB_HALF = 6378137.0, math.pi * 6378137.0


def to_web_mercator(lon: Column, lat: Column) -> Column:
    return F.struct((lon / 180 * WEB_HALF).alias("x"), (F.log(F.tan((90 + lat) * math.pi / 360)) * WEB_RADIUS).alias("y"))


def from_web_mercator(x: Column, y: Column) -> Column:
    return F.struct((x / WEB_HALF * 180).alias("lon"), (F.degrees(2 * F.atan(F.exp(y / WEB_RADIUS))) - 90).alias("lat"))


def require_one_srid(df: DataFrame, srid: str = "srid") -> int:
    """The single reference system of a table, or an error."""
    found = [r[0] for r in df.select(srid).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"reference systems are mixed or missing: {found}")
    return found[0]


def within(distance: Column, limit: Column, inclusive: Column) -> Column:
    """Distance test by policy: the limit itself counts only if the policy says so."""
    return F.when(inclusive, distance <= limit).otherwise(distance < limit)


def missing_thresholds(df: DataFrame, mode: str, threshold: str, expected: Sequence) -> DataFrame:
    """Per mode the expected thresholds it lacks and those it should not have; complete modes give no row."""
    want = F.array(*map(F.lit, expected))
    found = df.groupBy(mode).agg(F.collect_set(threshold).alias("_f"))
    return found.select(mode, F.array_sort(F.array_except(want, "_f")).alias("missing"), F.array_sort(F.array_except("_f", want)).alias("extra")).filter((F.size("missing") > 0) | (F.size("extra") > 0))
