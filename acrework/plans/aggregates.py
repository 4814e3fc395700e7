"""Queries of aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.functions.storage import cut_lineage
from acrework.operators import aggregates as A
from acrework.operators.audits import crosswalk_faults
from acrework.plans.registry import query, table


@query("a01_support_median", """
SELECT l_partkey, round(median(l_extendedprice / l_quantity), 8) AS median, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 5""")
def a01(spark, sf):
    unit = table(spark, sf, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    return A.support_median(unit, "l_partkey", "unit", 5).withColumn("median", F.round("median", 8))


@query("a02_site_summary", """
SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_status, count(DISTINCT o_orderdate) AS dates, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
  string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities, count(DISTINCT o_orderkey) AS cases FROM orders GROUP BY 1""")
def a02(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), F.count_distinct("o_orderdate").alias("dates"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"), F.count_distinct("o_orderkey").alias("cases"),
    )


@query("a03_counts_with_share", """
SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1""")
def a03(spark, sf):
    return A.counts_with_share(table(spark, sf, "orders"), "o_orderstatus").withColumn("share", F.round("share", 6)).orderBy(F.desc("n"))


@query("a04_pivot_counts", """
SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O, count(*) AS total FROM lineitem GROUP BY 1""")
def a04(spark, sf):
    return A.pivot_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"]).orderBy(F.desc("total"), "l_returnflag")


@query("a05_conditional_counts", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS granted, count(*) FILTER (o_orderstatus = 'O') AS denied, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders GROUP BY 1""")
def a05(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(status == "F").alias("granted"), F.count_if(status == "O").alias("denied"), F.count_if(~status.isin("F", "O")).alias("other"))


@query("a06_distinct_under_predicate", """
SELECT l_partkey, count(DISTINCT CASE WHEN l_quantity <= 10 THEN l_suppkey END) AS suppliers FROM lineitem GROUP BY 1""")
def a06(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(A.distinct_where("l_suppkey", F.col("l_quantity") <= 10).alias("suppliers"))


@query("a07_weighted_mean", """
SELECT l_returnflag, round(sum(v * w) FILTER (w > 0) / nullif(sum(w) FILTER (v IS NOT NULL AND w > 0), 0), 4) AS mean FROM (SELECT l_returnflag, nullif(l_extendedprice, 0) AS v, l_quantity - 5 AS w FROM lineitem) GROUP BY 1""")
def a07(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(A.weighted_mean(F.nullif("l_extendedprice", F.lit(0.0)), F.col("l_quantity") - 5), 4).alias("mean"))


@query("a08_ratio_of_sums", """
SELECT l_linenumber, CASE WHEN sum(l_extendedprice) > 0 THEN round(sum(l_extendedprice * l_discount) / sum(l_extendedprice) * 100, 6) END AS percent FROM lineitem GROUP BY 1""")
def a08(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.round(A.ratio_of_sums(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice")), 6).alias("percent"))


@query("a09_quantile_trim", """
WITH u AS (SELECT l_extendedprice / l_quantity AS u FROM lineitem), b AS (SELECT quantile_cont(u, 0.01) AS lo, quantile_cont(u, 0.99) AS hi FROM u)
SELECT count(*) AS n, round(min(u), 8) AS low, round(max(u), 8) AS high FROM u, b WHERE u BETWEEN lo AND hi""")
def a09(spark, sf):
    unit = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    return A.quantile_trim(unit, "u").agg(F.count("*").alias("n"), F.round(F.min("u"), 8).alias("low"), F.round(F.max("u"), 8).alias("high"))


@query("a10_agreement", """
SELECT count(*) AS n, round(median(abs(a - b)), 4) AS median_gap, round(avg(CASE WHEN abs(a - b) <= 2000 THEN 1.0 ELSE 0 END), 6) AS within_2000, round(avg(CASE WHEN abs(a - b) <= 20000 THEN 1.0 ELSE 0 END), 6) AS within_20000
FROM (SELECT l_extendedprice AS a, p_retailprice * l_quantity AS b FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE a > 0 AND b > 0""")
def a10(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_extendedprice").alias("a"), (F.col("p_retailprice") * F.col("l_quantity")).alias("b"))
    return A.agreement(joined, "a", "b", [2000, 20000]).select("n", F.round("median_gap", 4).alias("median_gap"), F.round("within_2000", 6).alias("within_2000"), F.round("within_20000", 6).alias("within_20000"))


@query("a11_fixed_domain_summary", """
SELECT s AS segment, count(c_custkey) AS n, coalesce(sum(c_acctbal) FILTER (c_acctbal > 0), 0)::DECIMAL(18,2)::DOUBLE AS positive, round(median(c_acctbal) FILTER (c_acctbal > 5000), 4) AS upper_median
FROM (SELECT unnest(['BUILDING', 'MACHINERY', 'SPACE']) AS s) LEFT JOIN customer ON c_mktsegment = s GROUP BY 1""")
def a11(spark, sf):
    domain = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("SPACE",)], "segment string")
    rows = domain.join(table(spark, sf, "customer"), F.col("c_mktsegment") == F.col("segment"), "left")
    balance = F.col("c_acctbal")
    return rows.groupBy("segment").agg(F.count("c_custkey").alias("n"), F.round(F.coalesce(F.sum(F.when(balance > 0, balance)), F.lit(0.0)), 2).alias("positive"), F.round(F.median(F.when(balance > 5000, balance)), 4).alias("upper_median"))


@query("a12_explicit_histogram", """
SELECT b AS bin, lo AS lower, hi AS upper, count(l_discount) AS n FROM (VALUES (0, 0.0, 0.025), (1, 0.025, 0.055), (2, 0.055, 0.2), (3, 0.2, 1.0)) e(b, lo, hi) LEFT JOIN lineitem ON l_discount > lo AND l_discount <= hi GROUP BY 1, 2, 3""")
def a12(spark, sf):
    return A.explicit_histogram(table(spark, sf, "lineitem"), "l_discount", [0.0, 0.025, 0.055, 0.2, 1.0])


@query("a13_equal_width_histogram", """
SELECT least(floor((c_acctbal - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS selected, min(c_custkey) AS first_id
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) WHERE hi > lo GROUP BY 1""")
def a13(spark, sf):
    return A.equal_width_histogram(table(spark, sf, "customer"), "c_acctbal", "c_custkey", 10, F.col("c_mktsegment") == "BUILDING")


@query("a13_members", """
SELECT c_custkey, least(floor((c_acctbal - lo) / ((hi - lo) / 10)), 9)::INT AS bin, c_mktsegment = 'BUILDING' AS selected
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) WHERE hi > lo AND c_acctbal IS NOT NULL""")
def a13_members(spark, sf):
    return A.equal_width_bins(table(spark, sf, "customer"), "c_acctbal", 10).select("c_custkey", "bin", (F.col("c_mktsegment") == "BUILDING").alias("selected"))


@query("a14_classes", """
WITH s AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS pos, count(*) OVER () AS n FROM customer), b AS (SELECT v FROM s, range(1, 5) t(i) WHERE pos = n * i // 5)
SELECT c_custkey, (SELECT count(*) FROM b WHERE v < c_acctbal)::INT AS class FROM customer""")
def a14_classes(spark, sf):
    customers = table(spark, sf, "customer")
    return A.assign_classes(customers, "c_acctbal", A.ordered_breaks(customers, "c_acctbal", 5)).select("c_custkey", "class")


@query("a14_ordered_breaks", """
WITH s AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS pos, count(*) OVER () AS n FROM customer) SELECT i::INT AS i, v AS "break" FROM s, range(1, 5) t(i) WHERE pos = n * i // 5""")
def a14(spark, sf):
    return A.ordered_breaks(table(spark, sf, "customer"), "c_acctbal", 5)


@query("a15_column_bins", """
SELECT 'small' AS bin, sum(p_size) FILTER (p_size <= 10) AS total FROM part UNION ALL SELECT 'middle', sum(p_size) FILTER (p_size > 10 AND p_size <= 30) FROM part UNION ALL SELECT 'large', sum(p_size) FILTER (p_size > 30) FROM part""")
def a15(spark, sf):
    size = F.col("p_size")
    sums = table(spark, sf, "part").agg(F.sum(F.when(size <= 10, size)).alias("small"), F.sum(F.when((size > 10) & (size <= 30), size)).alias("middle"), F.sum(F.when(size > 30, size)).alias("large"))
    return sums.unpivot([], ["small", "middle", "large"], "bin", "total")


@query("a16_coverage", """
SELECT event_type, count(*) AS n, count(*) FILTER (value <= 5) AS undated, min(ts) FILTER (value > 5) AS first_ts, max(ts) FILTER (value > 5) AS last_ts FROM events GROUP BY 1""")
def a16(spark, sf):
    dated = F.when(F.col("value") > 5, F.col("ts"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(dated.isNull()).alias("undated"), F.min(dated).alias("first_ts"), F.max(dated).alias("last_ts"))


@query("a17_before_and_after", """
WITH b AS (SELECT * FROM orders WHERE o_orderkey % 10 < 8), a AS (SELECT * FROM orders WHERE o_orderkey % 10 > 1)
SELECT o_orderstatus, count(*) FILTER (o_orderkey % 10 < 8) AS before, count(*) FILTER (o_orderkey % 10 > 1) AS after, count(*) FILTER (o_orderkey % 10 >= 8) AS added, count(*) FILTER (o_orderkey % 10 <= 1) AS removed FROM orders GROUP BY 1""")
def a17(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    before, after = orders.filter("o_orderkey % 10 < 8"), orders.filter("o_orderkey % 10 > 1")
    both = before.withColumn("b", F.lit(True)).join(after.withColumn("a", F.lit(True)), ["o_orderkey", "o_orderstatus"], "full")
    return both.groupBy("o_orderstatus").agg(F.count("b").alias("before"), F.count("a").alias("after"), F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"))


HOLDOUT_SQL = """
WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 7 AS region, l_extendedprice / l_quantity AS v, ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 80 AS train FROM lineitem),
f AS (SELECT l_partkey, median(v) AS m FROM u WHERE train GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT region, median(v) AS m FROM u WHERE train GROUP BY 1 HAVING count(*) >= 20), g AS (SELECT median(v) AS m FROM u WHERE train),
e AS (SELECT u.*, coalesce(f.m, c.m, g.m) AS estimate, CASE WHEN f.m IS NOT NULL THEN 'fine' WHEN c.m IS NOT NULL THEN 'coarse' ELSE 'overall' END AS method FROM u LEFT JOIN f USING (l_partkey) LEFT JOIN c USING (region), g)
"""


def estimates(spark, sf):
    """Unit prices with the estimate of a model learnt on the training folds."""
    u = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 7).alias("region"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"), (A.fold(F.col("l_orderkey")) < 80).alias("train"))
    u = cut_lineage(u, "unit-prices")  # read several times below
    known = u.filter("train")
    wide = A.level_medians(known, ["region"], "v")
    regions = wide.filter("level = 0 AND n >= 20").select(F.col("key").cast("long").alias("region"), "median")
    return A.hierarchical_estimate(u, A.support_median(known, "l_partkey", "v", 5), regions, wide.filter("level = 1").select("median"), "l_partkey", "region")


@query("j06_hierarchical_lookup", HOLDOUT_SQL + "SELECT method, count(*) AS n, round(sum(estimate), 2) AS total FROM e GROUP BY 1")
def j06(spark, sf):
    return estimates(spark, sf).groupBy("method").agg(F.count("*").alias("n"), F.round(F.sum("estimate"), 2).alias("total"))


@query("a18_holdout_validation", HOLDOUT_SQL + "SELECT count(*) AS n, round(median(abs(estimate - v) / v), 6) AS mdape, round(avg(CASE WHEN estimate / v BETWEEN 0.5 AND 2 THEN 1.0 ELSE 0 END), 6) AS within_factor_two FROM e WHERE NOT train")
def a18(spark, sf):
    ratio = F.col("estimate") / F.col("v")
    held = estimates(spark, sf).filter("NOT train").select((F.abs(F.col("estimate") - F.col("v")) / F.col("v")).alias("error"), ratio.between(0.5, 2).cast("double").alias("close"))
    held = cut_lineage(held, "held-out")
    summary = held.agg(F.count("*").alias("n"), F.round(F.avg("close"), 6).alias("within_factor_two"))
    return A.with_median(summary, held, "error", "mdape").withColumn("mdape", F.round("mdape", 6))


SERIES_SQL = """
WITH s AS (SELECT n_regionkey AS series, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
"""


def yearly(spark, sf):
    """Yearly order value of each region."""
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_regionkey").alias("series"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))


@query("a19_peak_and_trough", SERIES_SQL + """, p AS (SELECT series, max(v) AS peak, arg_max(y, v) AS peak_year, arg_max(v, y) AS latest FROM s GROUP BY 1), t AS (SELECT series, min(v) AS trough, arg_min(y, v) AS trough_year FROM s JOIN p USING (series) WHERE y >= peak_year GROUP BY 1)
SELECT series, round(peak, 2) AS peak, peak_year, round(trough, 2) AS trough, trough_year, round(latest, 2) AS latest, round(1 - trough / peak, 6) AS drop_share, round((latest - trough) / nullif(peak - trough, 0), 6) AS recovered FROM p JOIN t USING (series)""")
def a19(spark, sf):
    found = A.peak_and_trough(yearly(spark, sf), "series", "y", "v").withColumnRenamed("drop", "drop_share")
    return found.select("series", "peak_year", "trough_year", *(F.round(c, 2).alias(c) for c in ("peak", "trough", "latest")), *(F.round(c, 6).alias(c) for c in ("drop_share", "recovered")))


@query("a20_present_value", """
SELECT s_suppkey, round(sum(s_acctbal / pow(1.04, t)), 2) AS plain, round(1 - sum(s_acctbal * 0.3 / pow(1.04, t)) / nullif(sum(s_acctbal / pow(1.04, t)), 0), 6) AS reduction FROM supplier, range(0, 21) r(t) GROUP BY 1""")
def a20(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(20))))
    plain, cut = A.present_value(F.col("s_acctbal"), F.col("t"), 0.04), A.present_value(F.col("s_acctbal") * 0.3, F.col("t"), 0.04)
    return rows.groupBy("s_suppkey").agg(F.round(plain, 2).alias("plain"), F.round(1 - cut / F.nullif(plain, F.lit(0.0)), 6).alias("reduction"))


@query("a21_publication_gate", """
SELECT c_mktsegment, count(DISTINCT c_custkey) AS cases, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END), 6) AS located FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' GROUP BY 1 HAVING count(DISTINCT c_custkey) >= 10 AND avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END) >= 0.8""")
def a21(spark, sf):
    grouped = table(spark, sf, "customer").filter("c_mktsegment <> 'HOUSEHOLD'").groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("cases"), F.avg((F.col("c_acctbal") > 0).cast("double")).alias("located"))
    return grouped.filter("cases >= 10 AND located >= 0.8").withColumn("located", F.round("located", 6))


@query("a22_histogram_with_injected_row", """
SELECT p_type AS category, count(DISTINCT p_partkey) AS n, 0 AS injected FROM part GROUP BY 1 UNION ALL SELECT 'subset', count(DISTINCT p_partkey), 1 FROM part WHERE p_size < 5""")
def a22(spark, sf):
    parts = table(spark, sf, "part")
    own = parts.groupBy(F.col("p_type").alias("category")).agg(F.count_distinct("p_partkey").alias("n")).withColumn("injected", F.lit(0))
    extra = parts.filter("p_size < 5").agg(F.count_distinct("p_partkey").alias("n")).select(F.lit("subset").alias("category"), "n", F.lit(1).alias("injected"))
    return own.union(extra).orderBy(F.desc("n"), "injected")


@query("a23_calibration_ratio", """
SELECT round(median(l_extendedprice / (p_retailprice * l_quantity)), 6) AS ratio FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0 AND p_retailprice * l_quantity > 0""")
def a23(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    recorded = F.col("p_retailprice") * F.col("l_quantity")
    ratios = joined.filter((F.col("l_extendedprice") > 0) & (recorded > 0)).select((F.col("l_extendedprice") / recorded).alias("ratio"))
    return A.exact_quantiles(ratios, [], "ratio", [0.5]).select(F.round(F.col("quantiles")[0], 6).alias("ratio"))


@query("a24_group_sets", """
SELECT l_suppkey, list_sort(list_distinct(list(l_returnflag))) AS flags FROM lineitem GROUP BY 1""")
def a24(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("a25_crosswalk_audit", """
WITH k AS (SELECT DISTINCT p_brand FROM part), w AS (SELECT 'Brand#' || (i % 24) AS p_brand FROM range(0, 26) t(i) WHERE i <> 3 UNION ALL SELECT 'Brand#99')
SELECT p_brand, 'unclassified' AS fault FROM k WHERE p_brand NOT IN (SELECT p_brand FROM w) UNION ALL SELECT p_brand, 'unknown' FROM (SELECT DISTINCT p_brand FROM w) WHERE p_brand NOT IN (SELECT p_brand FROM k) UNION ALL SELECT p_brand, 'twice' FROM w GROUP BY 1 HAVING count(*) > 1""")
def a25(spark, sf):
    walk = spark.range(26).filter("id <> 3").select(F.concat(F.lit("Brand#"), (F.col("id") % 24).cast("string")).alias("p_brand")).union(spark.createDataFrame([("Brand#99",)], "p_brand string"))
    return crosswalk_faults(table(spark, sf, "part"), walk, "p_brand")


@query("a26_summary_by_class", """
SELECT coalesce(l_returnflag, 'all') AS class, count(*) AS n, round(avg(l_quantity / 45), 6) AS mean, round(median(l_quantity / 45), 6) AS median, round(avg(CASE WHEN l_quantity / 45 < 0.5 THEN 1.0 ELSE 0 END), 6) AS below_half FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def a26(spark, sf):
    ratio = F.col("l_quantity") / 45
    aggs = [F.count("*").alias("n"), F.round(F.avg(ratio), 6).alias("mean"), F.round(F.median(ratio), 6).alias("median"), F.round(F.avg((ratio < 0.5).cast("double")), 6).alias("below_half")]
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("class")).agg(*aggs).union(lines.agg(*aggs).select(F.lit("all").alias("class"), "n", "mean", "median", "below_half"))
