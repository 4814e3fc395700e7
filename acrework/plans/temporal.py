"""Queries of temporal operators (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.operators import temporal as T
from acrework.plans.aggregates import SERIES_SQL, yearly
from acrework.plans.registry import query, table


@query("t01_departures", """
SELECT user_id, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', min(ts)) + INTERVAL 1 HOUR, INTERVAL 5 MINUTES)) AS departure FROM events GROUP BY 1""")
def t01(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id").agg(F.date_trunc("hour", F.min("ts")).alias("start"))
    return first.select("user_id", F.explode(F.sequence("start", F.col("start") + F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 5 MINUTES"))).alias("departure"))


@query("t02_median_travel_time", "SELECT user_id, round(median(nullif(value, 6.55)), 4) AS minutes FROM events GROUP BY 1")
def t02(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.median(F.nullif("value", F.lit(6.55))), 4).alias("minutes"))


@query("t03_business_days", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE (SELECT max(d) FROM (SELECT d FROM (SELECT o_orderdate + to_days(i::INT) AS d FROM range(1, 8) t(i)) WHERE isodow(d) < 6 ORDER BY d LIMIT 3)) + INTERVAL 16 HOURS END AS final FROM orders""")
def t03(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.finality(F.col("o_orderdate"), F.col("o_orderstatus") == "F").alias("final"))


@query("t04_lapse", """
SELECT l_orderkey, l_linenumber, l_partkey, NOT coalesce(l_shipdate::DATE <= (o_orderdate + to_months(CASE WHEN e <= 18 THEN e ELSE 1 END::INT))::DATE, false) AS lapsed FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 2 WHEN 1 THEN 24 END AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def t04(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    extension = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 2 WHEN 1 THEN 24 END")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", T.lapsed(F.to_date("o_orderdate"), F.col("l_shipdate"), 1, extension).alias("lapsed"))


@query("t05_renewal", "SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority LIKE '1%' AS renewable FROM orders")
def t05(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.renewable(F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1")).alias("renewable"))


@query("t06_minimum_elapsed", "SELECT date_diff('day', o_orderdate, l_shipdate) >= 15 AS served, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def t06(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(T.elapsed_at_least(F.col("o_orderdate"), F.col("l_shipdate")).alias("served")).agg(F.count("*").alias("n"))


@query("t07_iso_dates", """
SELECT o_orderkey, o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND day(o_orderdate) <= 28) AS valid FROM orders""")
def t07(spark, sf):
    m, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(m == 0, F.date_format(day, "yyyy-MM-dd")).when(m == 1, F.concat(F.lit("2023-02-"), F.date_format(day, "dd"))).when(m == 2, F.date_format(day, "yyyy-M-d'x'")).otherwise(F.lit("2023-13-01"))
    return table(spark, sf, "orders").select("o_orderkey", T.is_iso_date(text).alias("valid"))


@query("t08_year_bounds", "SELECT min(year(o_orderdate))::INT AS first, max(year(o_orderdate))::INT AS last FROM orders WHERE o_orderstatus = 'F'")
def t08(spark, sf):
    return T.year_bounds(table(spark, sf, "orders").filter("o_orderstatus = 'F'"), "o_orderdate")


@query("t09_structural_validation", """
SELECT p_partkey, m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND d <= CASE WHEN m = 2 THEN 29 WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END AND h BETWEEN 0 AND 23 AS valid FROM (SELECT p_partkey, p_size % 14 AS m, p_partkey % 33 AS d, p_size % 25 AS h FROM part)""")
def t09(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.valid_parts(F.col("p_size") % 14, F.col("p_partkey") % 33, F.col("p_size") % 25).alias("valid"))


@query("t10_recovery_years", SERIES_SQL + ", m AS (SELECT series, 1 - min(v) / max(v) AS d FROM s GROUP BY 1) SELECT series, round(ln(1 / (1 - d)) / ln(1.03), 6) AS years FROM m")
def t10(spark, sf):
    drops = yearly(spark, sf).groupBy("series").agg((1 - F.min("v") / F.max("v")).alias("d"))
    return drops.select("series", F.round(T.recovery_years(F.col("d"), 0.03), 6).alias("years"))
