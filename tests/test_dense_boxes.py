"""Queries over boxes that crowd in one area, as their number grows, against DuckDB; and lots far from any street."""

import duckdb
import pytest

from acrework.operators import geometry as G
from acrework.plans import QUERIES, SQL
from tests.test_queries import rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["g11_majority_coverage", "g15_contiguity_dissolve", "g24_clip_polygons", "j08_point_in_polygon", "j09_overlap_join", "j11_largest_overlap", "j12_area_fraction"])
def test_boxes_crowd_as_they_grow(spark, name):
    """The area must not grow with the number of boxes, or no more of them would meet."""
    assert "sqrt(count(*)" not in SQL[name]
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, expected = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_the_nearest_street_counts_however_far(spark):
    """Lots beyond any fixed distance still have a nearest street."""
    lots = spark.createDataFrame([(1, 0.0, 0.0), (2, 90000.0, 7.0), (3, 5.0, 5.0)], "k long, x double, y double")
    streets = spark.createDataFrame([(8, 1.0, 1.0), (9, -4000.0, 0.0)], "id long, x double, y double")
    links = spark.createDataFrame([(3, 9)], "k long, id long")
    found = G.link_streets(lots, links, streets, "k", "id", 80.0)
    assert sorted(map(tuple, found.collect())) == [(1, 8, "nearest"), (2, 8, "nearest"), (3, 9, "address")]


def test_rows_of_much_work_are_dealt_by_their_number(spark):
    """A table of few bytes would be one task, however much work its rows are."""
    assert G.dealt(spark.range(25_000)).rdd.getNumPartitions() == 3 and G.dealt(spark.range(0)).count() == 0
    for name in ("g07_setback_envelopes", "g08_outside_area", "r07_ordered_reasons", "g20_targets"):
        assert "Repartition" in QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
