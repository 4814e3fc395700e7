"""Sets of raster cells (integer columns cx, cy), alone or one set for each value of the columns ``by``.

Parts and holes are connected along sides, not corners, as the outlines of cells are.  No step builds an area that its
result does not hold: the ground between cells is kept as runs of a row, whose number is at most that of the cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrework.functions.storage import cut_lineage
from acrework.operators.components import connected_components

#: Ends of runs without an end; cells must lie nearer.
FAR = 1 << 40


def _chords(radius: int) -> Column:
    """The rows of a disc: how far each lies from its middle, and how far it reaches to both sides."""
    return F.array(*(F.struct(F.lit(j).cast("long").alias("j"), F.lit(math.isqrt(radius * radius - j * j)).cast("long").alias("h")) for j in range(-radius, radius + 1)))


def runs(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Neighbouring cells of a row as one run: ``cy``, ``a`` and ``b`` (its first and last cx)."""
    row = Window.partitionBy(*by, "cy").orderBy("cx")
    heads = cells.select(*by, "cy", "cx").distinct().withColumn("_run", F.col("cx") - F.row_number().over(row))
    return heads.groupBy(*by, "cy", "_run").agg(F.min("cx").alias("a"), F.max("cx").alias("b")).drop("_run")


def _cells(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    return spans.select(*by, F.explode(F.sequence("a", "b")).alias("cx"), "cy")


def _covered(spans: DataFrame, times: int, by: Sequence[str]) -> DataFrame:
    """Where at least ``times`` of the spans (cy, a, b) of a row lie over each other, as runs."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("change")), F.struct((F.col("b") + 1).alias("at"), F.lit(-1).alias("change"))))
    steps = spans.select(*by, "cy", ends.alias("_e")).groupBy(*by, "cy", F.col("_e.at").alias("at")).agg(F.sum("_e.change").alias("change")).filter("change <> 0")
    row = Window.partitionBy(*by, "cy").orderBy("at")
    depth = steps.withColumn("over", F.sum("change").over(row) >= times)
    turns = depth.withColumn("before", F.coalesce(F.lag("over").over(row), F.lit(False))).filter("over <> before")
    return turns.select(*by, "cy", F.col("at").alias("a"), (F.lead("at").over(row) - 1).alias("b"), "over").filter("over").drop("over")


def dilate(cells: DataFrame, radius: int, by: Sequence[str] = ()) -> DataFrame:
    """Cells within a radius of the set.  Runs are widened by the disc's chord for each row they reach, and united."""
    reach = runs(cells, by).withColumn("_c", F.explode(_chords(radius)))
    wide = reach.select(*by, (F.col("cy") + F.col("_c.j")).alias("cy"), (F.col("a") - F.col("_c.h")).alias("a"), (F.col("b") + F.col("_c.h")).alias("b"))
    return _cells(_covered(wide, 1, by), by)


def erode(cells: DataFrame, radius: int, by: Sequence[str] = ()) -> DataFrame:
    """Cells all of whose neighbours within a radius belong to the set.

    A cell is left where the runs of all rows of the disc, each narrowed by its chord, lie over it.
    """
    reach = runs(cells, by).withColumn("_c", F.explode(_chords(radius)))
    narrow = reach.select(*by, (F.col("cy") - F.col("_c.j")).alias("cy"), (F.col("a") + F.col("_c.h")).alias("a"), (F.col("b") - F.col("_c.h")).alias("b")).filter("a <= b")
    return _cells(_covered(narrow, 2 * radius + 1, by), by)


def close_gaps(cells: DataFrame, grow: int, shrink: int, by: Sequence[str] = ()) -> DataFrame:
    """Morphological closing: grow by one radius, then shrink by another."""
    return erode(dilate(cells, grow, by), shrink, by)


def open_cells(cells: DataFrame, radius: int, by: Sequence[str] = ()) -> DataFrame:
    """Morphological opening: what is thinner than the disc goes."""
    return dilate(erode(cells, radius, by), radius, by)


def _node(by: Sequence[str], *rest: Column) -> Column:
    return F.struct(*by, *rest)


def islands(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each cell with its ``part`` (a struct that names the part) and the part's ``size``."""
    own = cut_lineage(cells.select(*by, "cx", "cy").distinct(), "cells")
    here = _node(by, "cx", "cy")
    beside = F.explode(F.array(here, _node(by, (F.col("cx") + 1).alias("cx"), F.col("cy")), _node(by, F.col("cx"), (F.col("cy") + 1).alias("cy"))))
    links = own.select(here.alias("src"), beside.alias("dst")).join(own.select(here.alias("dst")), "dst")
    parts = connected_components(links).select(*(F.col(f"node.{c}").alias(c) for c in [*by, "cx", "cy"]), F.col("component").alias("part"))
    return parts.join(parts.groupBy("part").agg(F.count("*").alias("size")), "part")


def _main(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Size of the largest part of each set; without ``by`` one row, so it is small enough for any join."""
    sizes = parts.groupBy(*by).agg(F.max("size").alias("_main"))
    return sizes if by else F.broadcast(sizes)


def _beside(rows: DataFrame, main: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.join(main, list(by)) if by else rows.crossJoin(main)


def drop_islands(cells: DataFrame, least_share: float, by: Sequence[str] = ()) -> DataFrame:
    """Without the parts smaller than a share of the largest part."""
    parts = cut_lineage(islands(cells, by), "islands")
    return _beside(parts, _main(parts, by), by).filter(F.col("size") >= least_share * F.col("_main")).select(*by, "cx", "cy")


def holes(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs (cy, x0 to x1) of the ground enclosed by cells, each with its ``hole`` and the hole's ``size``."""
    row = Window.partitionBy(*by, "cy").orderBy("cx")
    gaps = cells.select(*by, F.col("cx").cast("bigint").alias("cx"), "cy").distinct().withColumn("_next", F.lead("cx").over(row)).withColumn("_before", F.lag("cx").over(row))
    after = F.struct((F.col("cx") + 1).alias("x0"), F.coalesce(F.col("_next") - 1, F.lit(FAR)).alias("x1"))
    ahead = F.when(F.col("_before").isNull(), F.struct(F.lit(-FAR).alias("x0"), (F.col("cx") - 1).alias("x1")))
    spans = gaps.select(*by, F.col("cy").cast("bigint").alias("cy"), F.explode(F.array(after, ahead)).alias("_s")).filter("_s IS NOT NULL AND _s.x0 <= _s.x1")
    runs = cut_lineage(spans.select(*by, "cy", "_s.x0", "_s.x1"), "runs")
    # of two runs that touch in neighbouring rows, one begins above or below the other: look up each beginning there
    looks = runs.withColumn("_at", F.explode(F.array(F.col("cy") - 1, F.col("cy"), F.col("cy") + 1))).withColumn("_own", F.col("_at") == F.col("cy"))
    here = Window.partitionBy(*by, "_at").orderBy("x0", F.desc("_own")).rowsBetween(Window.unboundedPreceding, 0)
    seen = looks.withColumn("_there", F.last(F.when(F.col("_own"), F.struct("x0", "x1")), ignorenulls=True).over(here)).filter("NOT _own")
    mine, outside = _node(by, "cy", "x0"), _node(by, F.lit(-FAR).alias("cy"), F.lit(-FAR).alias("x0"))
    theirs = _node(by, F.col("_at").alias("cy"), F.col("_there.x0").alias("x0"))
    touching = seen.filter("_there.x1 >= x0").select(mine.alias("src"), theirs.alias("dst"))
    rows = runs.select(*by, "cy").distinct()
    beyond = runs.withColumn("_at", F.explode(F.array(F.col("cy") - 1, F.col("cy") + 1))).join(rows.withColumnRenamed("cy", "_at"), [*by, "_at"], "left_anti")
    ends = runs.filter((F.col("x0") == -FAR) | (F.col("x1") == FAR)).select(mine.alias("src"), outside.alias("dst"))
    links = touching.union(ends).union(beyond.select(mine.alias("src"), outside.alias("dst"))).union(runs.select(mine.alias("src"), mine.alias("dst")))
    found = connected_components(links).filter(F.col("component.cy") > -FAR)
    enclosed = found.select(*(F.col(f"node.{c}").alias(c) for c in [*by, "cy", "x0"]), F.col("component").alias("hole")).join(runs, [*by, "cy", "x0"])
    return enclosed.join(enclosed.groupBy("hole").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size")), "hole")


def fill_holes(cells: DataFrame, least_share: float, by: Sequence[str] = ()) -> DataFrame:
    """With every hole filled that is smaller than a share of the largest part."""
    own = cells.select(*by, F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy")).distinct()
    small = _beside(holes(own, by), _main(islands(own, by), by), by).filter(F.col("size") < least_share * F.col("_main"))
    return own.union(small.select(*by, F.explode(F.sequence("x0", "x1")).alias("cx"), "cy"))
