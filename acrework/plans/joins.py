"""Queries of joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.operators import joins as J
from acrework.plans.registry import query, table


@query("j01_lookup_join", """
SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey""")
def j01(spark, sf):
    nations = table(spark, sf, "nation").filter("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.lookup_join(table(spark, sf, "customer"), nations, "c_nationkey", "n_name", "unknown").select("c_custkey", "n_name")


@query("j02_one_to_one", """
SELECT o_orderkey, o_totalprice, lines FROM orders JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def j02(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return J.one_to_one(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), lines, "o_orderkey")


@query("j03_semi_and_anti", """
SELECT (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS has_lines, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1""")
def j03(spark, sf):
    orders, lines = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders, lines = J.dealt_by(["o_orderkey"], orders, lines)  # hundreds of millions of keys are a few tasks otherwise
    both = [orders.join(lines, "o_orderkey", how).select(F.lit(how == "left_semi").alias("has_lines"), "o_orderkey") for how in ("left_semi", "left_anti")]
    return both[0].union(both[1]).groupBy("has_lines").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("j04_composite_key", """
SELECT l.l_partkey, l.l_suppkey, count(*) AS n, round(max(price), 2) AS price FROM lineitem l
LEFT JOIN (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) r ON l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey GROUP BY 1, 2""")
def j04(spark, sf):
    lines, rows = table(spark, sf, "lineitem"), table(spark, sf, "lineitem").count()
    lines, returned = J.dealt_by(["l_partkey", "l_suppkey"], lines.select("l_partkey", "l_suppkey"), lines.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey", "l_extendedprice"), rows=2 * rows)
    returned = returned.groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("price"))
    return lines.join(returned, ["l_partkey", "l_suppkey"], "left").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.round(F.max("price"), 2).alias("price"))


@query("j05_fallback_join", """
WITH r AS (SELECT p_brand AS brand, p_type AS kind, p_size % 10 AS slot, p_partkey AS found FROM part WHERE p_partkey % 3 = 0),
l AS (SELECT p_partkey, p_brand AS brand, p_type AS kind, p_size % 10 AS slot FROM part WHERE p_partkey % 3 <> 0),
e AS (SELECT brand, kind, slot, min(found) AS x FROM r GROUP BY ALL), u AS (SELECT brand, slot, min(found) AS y FROM r GROUP BY ALL HAVING count(*) = 1)
SELECT p_partkey, coalesce(x, y) AS found, CASE WHEN x IS NOT NULL THEN 'exact' WHEN y IS NOT NULL THEN 'loose' ELSE 'none' END AS matched FROM l LEFT JOIN e USING (brand, kind, slot) LEFT JOIN u USING (brand, slot)""")
def j05(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), (F.col("p_size") % 10).alias("slot"))
    right = parts.filter("p_partkey % 3 = 0").withColumnRenamed("p_partkey", "found")
    return J.fallback_join(parts.filter("p_partkey % 3 <> 0"), right, ["brand", "kind", "slot"], ["brand", "slot"], "found").select("p_partkey", "found", "matched")


@query("j07_band_join", """
SELECT o_orderkey, label FROM orders LEFT JOIN (VALUES (0, 50000, 'a'), (50000, 150000, 'b'), (150000, NULL, 'c')) b(lower, upper, label) ON o_totalprice > lower AND (upper IS NULL OR o_totalprice <= upper)""")
def j07(spark, sf):
    bands = spark.createDataFrame([(0.0, 50000.0, "a"), (50000.0, 150000.0, "b"), (150000.0, None, "c")], "lower double, upper double, label string")
    return J.band_join(table(spark, sf, "orders"), F.col("o_totalprice"), bands).select("o_orderkey", "label")


@query("j13_reference_domain", """
SELECT b AS brand, coalesce(n, 0) AS n, coalesce(total, 0) AS total, i AS row_order FROM (SELECT 'Brand#' || i AS b, i FROM range(0, 30) t(i)) LEFT JOIN (SELECT p_brand, count(*) AS n, sum(p_size) AS total FROM part GROUP BY 1) ON b = p_brand""")
def j13(spark, sf):
    domain = spark.range(30).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("brand"), F.col("id").alias("row_order"))
    totals = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))
    return J.on_domain(domain, totals, "brand").orderBy("row_order")


@query("j14_similarity_join", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(s, 6) AS score, rank, CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS tier, s >= 0.75 AS auto_accept FROM r WHERE rank <= 3""")
def j14(spark, sf):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return J.similarity_join(queries, vectors, "query_id", "vec_id", "embedding", 3).withColumn("score", F.round("score", 6))


@query("j15_results_join", """
SELECT n_name, count(*) AS customers, count(c_custkey) AS matched FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 2) ON n_nationkey = c_nationkey GROUP BY 1""")
def j15(spark, sf):
    customers = table(spark, sf, "customer").filter("c_nationkey <> 2")
    return table(spark, sf, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.count("*").alias("customers"), F.count("c_custkey").alias("matched"))


@query("j16_cohort", """
SELECT a.k, a.before, b.after FROM (SELECT l_partkey AS k, max(l_extendedprice) AS before FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1) a
JOIN (SELECT l_partkey AS k, max(l_extendedprice) AS after FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1) b USING (k) WHERE before > 0 AND after > 0""")
def j16(spark, sf):
    prices = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y")).agg(F.max("l_extendedprice").alias("price"))
    return J.cohort(prices.filter("y = 1996"), prices.filter("y = 1997"), "k", "price")


@query("j17_chain_join", """
SELECT s_suppkey, count(DISTINCT o_orderkey) AS orders, round(count(o_orderkey) FILTER (o_orderstatus = 'F') * 1.0 / nullif(count(*), 0), 6) AS linked_share FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def j17(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    chain = table(spark, sf, "supplier").select("s_suppkey").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return chain.groupBy("s_suppkey").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.count_if((F.col("o_orderstatus") == "F")) / F.count("*"), 6).alias("linked_share"))
