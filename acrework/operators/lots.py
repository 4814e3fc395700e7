"""Setback envelopes of lots, in the frame of their front edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrework.operators.geometry import area, centroid, dealt, rectangle
from acrework.operators.polygons import common_area
from acrework.operators.rules import ordered_reason

#: Fixed values, in feet: yards of a single-family lot, and how well a rectangle must fill its lot.
FRONT, REAR, SIDE, BOTH_SIDES, LEAST_RECTANGULARITY = 20.0, 30.0, 4.0, 14.0, 0.90
#: An outside area counts beyond ten square feet or a hundredth of the footprint.
LEAST_OUTSIDE, OUTSIDE_SHARE = 10.0, 0.01

#: Why a lot is not evaluated, in the order of the tests; the last is the result of those that are.
REASONS = ("other_building_type", "possible_multi_parcel_site", "outside_debug_sample", "no_confident_front_edge", "no_principal_footprint", "irregular_geometry", "evaluated")


def in_edge_frame(shape: Column, ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A shape as points (x along the front edge from its middle, y into the lot ``ring``); null for an edge without length."""
    size = F.nullif(F.hypot(x2 - x1, y2 - y1), F.lit(0.0))
    tx, ty, ox, oy = (x2 - x1) / size, (y2 - y1) / size, (x1 + x2) / 2, (y1 + y2) / 2
    middle = centroid(ring)
    side = F.when((middle["y"] - oy) * tx - (middle["x"] - ox) * ty < 0, -1.0).otherwise(1.0)
    turned = F.transform(shape, lambda p: F.struct(((p["x"] - ox) * tx + (p["y"] - oy) * ty).alias("x"), (((p["y"] - oy) * tx - (p["x"] - ox) * ty) * side).alias("y")))
    return F.when(size.isNotNull(), turned)


def _envelopes() -> list[tuple[Column, Column]]:
    """Two rectangles of the frame, by which side has the wider yard, and whether the yards leave them any room."""
    x0, x1, front, rear = F.col("_x0"), F.col("_x1"), F.col("_y0") + FRONT, F.col("_y1") - REAR
    sides = ((x0 + SIDE, x1 - BOTH_SIDES + SIDE), (x0 + BOTH_SIDES - SIDE, x1 - SIDE))
    return [(rectangle(left, front, right, rear), (rear > front) & (right > left)) for left, right in sides]


def setback_envelopes(lots: DataFrame, ring: str, building: str, edge: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Adds width, depth, rectangularity, and (only for lots that are rectangular enough) available and outside.

    ``available`` is the area of the larger envelope, zero where yards leave no room; ``outside`` is the least area of
    the building outside an envelope, null without a building.  Without a lot or a front edge all five are null.
    """
    frame = lambda shape: in_edge_frame(F.col(shape), F.col(ring), *map(F.col, edge))
    turned = lots.withColumns({"_lot": frame(ring), "_building": frame(building)})
    ends = {f"_{a}{n}": f(f"_lot.{a}") for a in "xy" for n, f in (("0", F.array_min), ("1", F.array_max))}
    sized = turned.withColumns(ends).withColumns({"width": F.col("_x1") - F.col("_x0"), "depth": F.col("_y1") - F.col("_y0")})
    sized = sized.withColumn("rectangularity", area(F.col("_lot")) / F.nullif(F.col("width") * F.col("depth"), F.lit(0.0)))
    lot, building = F.col("_lot"), F.when(F.size("_building") >= 4, F.col("_building"))
    own = area(building)
    room = [F.when(fits, common_area(lot, box)) for box, fits in _envelopes()]
    rest = [F.when(fits, F.greatest(F.lit(0.0), own - common_area(building, lot, box))) for box, fits in _envelopes()]
    regular = F.col("rectangularity") >= LEAST_RECTANGULARITY
    fitted = {"available": F.when(regular, F.greatest(F.lit(0.0), *room)), "outside": F.when(regular & own.isNotNull(), F.least(own, *rest))}
    return sized.withColumns(fitted).drop("_lot", "_building", *ends)


def setback_evaluation(parcels: DataFrame, fronts: DataFrame, buildings: DataFrame, key: str, ring: str, in_scope: str, several: str, sampled: str) -> DataFrame:
    """One row for each parcel: why it is not evaluated (or ``evaluated``), ``crosses``, ``available`` and ``outside``.

    ``fronts`` has the key and a confident front edge (x1, y1, x2, y2), ``buildings`` the key and ``building``, the ring
    of the principal footprint; each at most one row for a key.  Flags that are null count as false.  Areas and
    ``crosses`` are null unless the parcel is evaluated.
    """
    joined = parcels.join(fronts.select(key, "x1", "y1", "x2", "y2"), key, "left").join(buildings.select(key, "building"), key, "left")
    fitted = setback_envelopes(dealt(joined, parcels.count()), ring, "building")
    tests = (~F.coalesce(F.col(in_scope), F.lit(False)), F.col(several), ~F.coalesce(F.col(sampled), F.lit(False)), F.col("x1").isNull(), F.coalesce(F.size("building"), F.lit(0)) < 4, F.col("outside").isNull())
    done = F.col("reason") == REASONS[-1]
    limit = F.greatest(F.lit(LEAST_OUTSIDE), area(F.col("building")) * OUTSIDE_SHARE)
    out = fitted.withColumn("reason", ordered_reason(list(zip(REASONS, tests)), REASONS[-1]))
    return out.select(*parcels.columns, "reason", F.when(done, F.col("outside") > limit).alias("crosses"), *(F.when(done, F.col(c)).alias(c) for c in ("available", "outside")))
