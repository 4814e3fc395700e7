"""Projections: known values, round trips, and angles that keep their size."""

import math

from pyspark.sql import functions as F

from acrework.operators.projections import MICHIGAN_SOUTH_FEET, UTM_17N


def at(spark, projection, lon, lat):
    return spark.range(1).select(projection.forward(F.lit(lon), F.lit(lat)).alias("p")).first()["p"]


def test_known_values(spark):
    # 4,984,944.378 m of meridian lie between the equator and 45 degrees
    p = at(spark, UTM_17N, -81.0, 45.0)
    assert math.isclose(p["x"], 500_000, abs_tol=1e-6) and math.isclose(p["y"], 4_984_944.378 * 0.9996, abs_tol=2e-3)
    q = at(spark, MICHIGAN_SOUTH_FEET, -(84 + 22 / 60), 41.5)
    assert math.isclose(q["x"], 4_000_000 / 0.3048, abs_tol=1e-6) and math.isclose(q["y"], 0, abs_tol=1e-6)


def test_round_trips(spark):
    rows = spark.range(400).select((F.col("id") % 20 * 0.4 - 87).alias("lon"), (F.floor(F.col("id") / 20) * 0.3 + 41).alias("lat"))
    for projection in (UTM_17N, MICHIGAN_SOUTH_FEET):
        p = rows.withColumn("p", projection.forward(F.col("lon"), F.col("lat"))).withColumn("q", projection.inverse(F.col("p.x"), F.col("p.y")))
        far = p.agg(F.max(F.abs(F.col("q.lon") - F.col("lon"))), F.max(F.abs(F.col("q.lat") - F.col("lat")))).first()
        assert max(far) < 1e-9


def test_scale_and_angles(spark):
    """A small step east and one north keep a right angle and one scale: that of the standard parallel, or of the meridian."""
    f = 1 / 298.257222101
    e2, step = f * (2 - f), 1e-5
    for projection, lon, lat, unit, scale in ((MICHIGAN_SOUTH_FEET, -83.0, 42.1, 0.3048, 1.0), (MICHIGAN_SOUTH_FEET, -83.0, 43 + 40 / 60, 0.3048, 1.0), (UTM_17N, -81.0, 42.3, 1.0, 0.9996)):
        here, east, north = (at(spark, projection, lon + a, lat + b) for a, b in ((0, 0), (step, 0), (0, step)))
        s = math.sin(math.radians(lat))
        along = 6378137 / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(lat)) * math.radians(step)
        up = 6378137 * (1 - e2) / (1 - e2 * s * s) ** 1.5 * math.radians(step)
        dx, dy = [(p["x"] - here["x"]) * unit for p in (east, north)], [(p["y"] - here["y"]) * unit for p in (east, north)]
        assert math.isclose(math.hypot(dx[0], dy[0]) / along, scale, rel_tol=1e-6) and math.isclose(math.hypot(dx[1], dy[1]) / up, scale, rel_tol=1e-6)
        assert abs(dx[0] * dx[1] + dy[0] * dy[1]) < 1e-6


def test_alignment_of_two_tables(spark):
    import pytest
    from pyspark.sql import functions as F

    from acrework.operators.projections import SYSTEMS, align

    globe = spark.createDataFrame([(1, -83.05, 42.33), (2, -83.2, 42.4)], "id int, x double, y double")
    for srid, system in SYSTEMS.items():
        there = globe.withColumn("_p", system.forward(F.col("x"), F.col("y"))).select("id", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), F.lit(srid).alias("srid"))
        for other in SYSTEMS:
            left = spark.createDataFrame([(other,)], "srid int")
            back = align(globe.withColumn("srid", F.lit(4326)), align(left, there))
            found = [(r["id"], round(r["x"], 7), round(r["y"], 7), r["srid"]) for r in back.orderBy("id").collect()]
            assert found == [(1, -83.05, 42.33, 4326), (2, -83.2, 42.4, 4326)]
    with pytest.raises(ValueError, match="unknown"):
        align(globe.withColumn("srid", F.lit(1)), globe.withColumn("srid", F.lit(4326)))
    with pytest.raises(ValueError, match="mixed"):
        align(globe.withColumn("srid", F.col("id")), globe.withColumn("srid", F.lit(4326)))
