"""Queries of windows, ordering and set operations (W, O, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.functions.storage import shared_path
from acrework.operators import windows as W
from acrework.operators.audits import set_differences
from acrework.plans.aggregates import SERIES_SQL, yearly
from acrework.plans.registry import query, table
from acrework.sources import tables as T

DEDUPE_SQL = "SELECT l_orderkey, min(l_partkey) AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {0}) AS r FROM lineitem) WHERE r = 1 GROUP BY 1"


@query("w01_dedupe_first", DEDUPE_SQL.format("l_linenumber, l_partkey"))
def w01(spark, sf):
    return W.dedupe(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", F.col("l_partkey").alias("part"))


@query("w01_dedupe_last", DEDUPE_SQL.format("l_linenumber DESC, l_partkey DESC"))
def w01b(spark, sf):
    return W.dedupe(table(spark, sf, "lineitem"), ["l_orderkey"], [F.desc("l_linenumber"), F.desc("l_partkey")]).select("l_orderkey", F.col("l_partkey").alias("part"))


@query("w01_dedupe_unique", "SELECT l_orderkey, min(l_partkey) AS part FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def w01c(spark, sf):
    return W.dedupe(table(spark, sf, "lineitem"), ["l_orderkey"], keep="unique").select("l_orderkey", F.col("l_partkey").alias("part"))


@query("w01_dedupe_largest", DEDUPE_SQL.format("l_extendedprice DESC, l_partkey"))
def w01d(spark, sf):
    return W.dedupe(table(spark, sf, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_partkey"]).select("l_orderkey", F.col("l_partkey").alias("part"))


@query("w02_concentration", """
WITH s AS (SELECT l_suppkey, sum(l_extendedprice) AS amount, sum(l_quantity) AS base FROM lineitem GROUP BY 1), r AS (SELECT *, sum(base) OVER w / sum(base) OVER () AS base_share, sum(amount) OVER w / sum(amount) OVER () AS amount_share FROM s WINDOW w AS (ORDER BY amount / base DESC, l_suppkey))
SELECT round(min(amount_share), 6) AS amount_share, round(min(base_share), 6) AS base_share FROM r WHERE base_share >= 0.1""")
def w02(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("base"))
    return W.concentration(sums, "amount", "base", "l_suppkey").filter("base_share >= 0.1").agg(F.round(F.min("amount_share"), 6).alias("amount_share"), F.round(F.min("base_share"), 6).alias("base_share"))


@query("w03_average_rank", """
SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part""")
def w03(spark, sf):
    return W.average_rank(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank")


@query("w04_index_to_peak", SERIES_SQL + "SELECT series, y, round(100 * v / max(v) OVER (PARTITION BY series), 4) AS index FROM s")
def w04(spark, sf):
    return W.index_to_peak(yearly(spark, sf), "series", "v").select("series", "y", F.round("index", 4).alias("index"))


@query("w05_version_ledger", """
WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, event_id, 'v' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM m WHERE p IS NULL OR p <> event_type""")
def w05(spark, sf):
    fingerprint = F.sha2(F.to_json(F.struct("event_type")), 256)
    return W.version_ledger(table(spark, sf, "events"), "user_id", ["ts", "event_id"], fingerprint).select("user_id", "event_id", "version")


@query("w05_ledger_merge", """
WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, event_id, 'v' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM m WHERE p IS NULL OR p <> event_type""")
def w05_merge(spark, sf):
    """The ledger of all events, built from three batches that are published one after the other."""
    events, root = table(spark, sf, "events"), shared_path(spark, "version-ledger")
    fingerprint = F.sha2(F.to_json(F.struct("event_type")), 256)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) / 3, first + (last - first) * 2 / 3] if first is not None else []
    schema = f"user_id {events.schema['user_id'].dataType.simpleString()}, event_id {events.schema['event_id'].dataType.simpleString()}, number long, fingerprint string, version string"
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = events.filter((F.lit(low is None) | (F.col("ts") >= F.lit(low))) & (F.lit(high is None) | (F.col("ts") < F.lit(high))))
        added = W.ledger_additions(T.read_latest(spark, root, schema), batch, "user_id", ["ts", "event_id"], fingerprint)
        T.append_published(added.select("user_id", "event_id", "number", "fingerprint", "version"), root)
    return T.read_latest(spark, root, schema).select("user_id", "event_id", "version")


@query("w06_funnel", """
WITH c AS (SELECT count(*) AS a, count(*) FILTER (l_quantity > 10) AS b, count(*) FILTER (l_quantity > 10 AND l_discount > 0.02) AS c, count(*) FILTER (l_quantity > 10 AND l_discount > 0.02 AND l_returnflag = 'N') AS d FROM lineitem)
SELECT 0 AS step, 'all' AS gate, a AS remaining, 1.0 AS share, 0 AS cut FROM c UNION ALL SELECT 1, 'quantity', b, round(b / a, 6), a - b FROM c UNION ALL SELECT 2, 'discount', c, round(c / a, 6), b - c FROM c UNION ALL SELECT 3, 'flag', d, round(d / a, 6), c - d FROM c""")
def w06(spark, sf):
    gates = [("quantity", F.col("l_quantity") > 10), ("discount", F.col("l_discount") > 0.02), ("flag", F.col("l_returnflag") == "N")]
    return W.funnel(table(spark, sf, "lineitem"), gates).withColumn("share", F.round("share", 6))


@query("w07_group_median_imputation", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_orderkey % 3 > 0 THEN l_quantity END AS q FROM lineitem), m AS (SELECT l_partkey, l_returnflag, median(q) AS m FROM l GROUP BY 1, 2)
SELECT CASE WHEN q IS NOT NULL THEN 'measured' WHEN m IS NOT NULL THEN 'group median' ELSE 'missing' END AS source, count(*) AS n, round(sum(coalesce(q, m)), 2) AS total FROM l LEFT JOIN m USING (l_partkey, l_returnflag) GROUP BY 1""")
def w07(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("q", F.when(F.col("l_orderkey") % 3 > 0, F.col("l_quantity"))).select("l_partkey", "l_returnflag", "q")
    return W.impute_group_median(lines, ["l_partkey", "l_returnflag"], "q").groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("q"), 2).alias("total"))


@query("w08_first_recorded_category", """
WITH own AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS c FROM lineitem), lists AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'R|N' WHEN 1 THEN 'A|R|N' ELSE 'X|A' END AS l FROM orders),
f AS (SELECT k, arg_min(c, pos) AS x FROM (SELECT k, unnest(string_split(l, '|')) AS c, generate_subscripts(string_split(l, '|'), 1) AS pos FROM lists) JOIN own USING (k, c) GROUP BY 1), b AS (SELECT k, arg_min(c, CASE c WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS y FROM own GROUP BY 1)
SELECT k, coalesce(x, y, 'unspecified') AS "primary", CASE coalesce(x, y, 'unspecified') WHEN 'A' THEN 'returned' WHEN 'R' THEN 'returned' ELSE coalesce(x, y, 'unspecified') END AS parent FROM lists LEFT JOIN f USING (k) LEFT JOIN b USING (k)""")
def w08(spark, sf):
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'R|N' WHEN 1 THEN 'A|R|N' ELSE 'X|A' END").alias("l"))
    listed = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("c"))
    return W.first_recorded(cases, listed, "k", "l", "c", {"N": 1, "A": 2, "R": 3}, {"A": "returned", "R": "returned"}).select("k", "primary", "parent")


@query("w09_display_class", """
SELECT c_nationkey, CASE WHEN c_acctbal < 1000 OR c_mktsegment = 'HOUSEHOLD' THEN 'other' ELSE lower(c_mktsegment) END AS class FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r = 1""")
def w09(spark, sf):
    first = W.dedupe(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"])
    return first.select("c_nationkey", F.when((F.col("c_acctbal") < 1000) | (F.col("c_mktsegment") == "HOUSEHOLD"), "other").otherwise(F.lower("c_mktsegment")).alias("class"))


@query("o01_top_k", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_brand <> 'Brand#2' ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 10")
def o01(spark, sf):
    return table(spark, sf, "part").filter("p_brand <> 'Brand#2'").orderBy(F.desc("p_size"), "p_retailprice", "p_partkey").limit(10).select("p_partkey", "p_size", "p_retailprice")


@query("o02_table_sort", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error'), nullif(value, 6.55) DESC NULLS LAST, event_id) AS position FROM events""")
def o02(spark, sf):
    from pyspark.sql import Window

    shown = table(spark, sf, "events").withColumn("v", F.nullif("value", F.lit(6.55)))
    # one view for each user; unnamed ones go to the bottom, missing values last whatever the direction
    order = Window.partitionBy("user_id").orderBy(F.col("event_type") == "error", F.desc_nulls_last("v"), "event_id")
    return shown.select("event_id", F.row_number().over(order).alias("position"))


@query("o03_counts_sorted", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def o03(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("o04_fixed_sample", "SELECT o_orderkey FROM orders ORDER BY md5('seed7' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def o04(spark, sf):
    return W.hash_sample(table(spark, sf, "orders"), "o_orderkey", 100, "seed7").select("o_orderkey")


@query("u01_concat_keep_last", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 5 THEN 'second' ELSE 'first' END AS batch FROM orders WHERE o_orderkey % 10 < 8""")
def u01(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    first = orders.filter("o_orderkey % 10 < 8").withColumns({"batch": F.lit("first"), "order": F.lit(1)})
    second = orders.filter("o_orderkey % 10 < 5").withColumns({"batch": F.lit("second"), "order": F.lit(2)})
    return W.dedupe(first.unionByName(second), ["o_orderkey"], [F.desc("order")]).select("o_orderkey", "batch")


@query("u02_set_differences", """
SELECT p_partkey, 'left' AS side FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'right' FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0""")
def u02(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey")
    return set_differences(parts.filter("p_partkey % 7 = 0"), parts.filter("p_partkey % 5 = 0"))


@query("u03_union_of_maps", """
SELECT p_brand, list_sort(list_distinct(list(p_type) FILTER (p_size <= 25))) AS by_right, list_sort(list_distinct(list(p_type) FILTER (p_size > 45))) AS conditional FROM part GROUP BY 1 HAVING count(*) FILTER (p_size <= 25) > 0 AND count(*) FILTER (p_size > 45) > 0""")
def u03(spark, sf):
    sets = table(spark, sf, "part").groupBy("p_brand").agg(*(F.array_sort(F.collect_set(F.when(c, F.col("p_type")))).alias(n) for n, c in (("by_right", F.col("p_size") <= 25), ("conditional", F.col("p_size") > 45))))
    return sets.filter((F.size("by_right") > 0) & (F.size("conditional") > 0))


@query("u04_relations_after_renaming", """
SELECT c_custkey AS s, 'in' AS p, 'building (all)' AS o, 'left' AS side FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'in', 'building', 'right' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def u04(spark, sf):
    facts = table(spark, sf, "customer").select(F.col("c_custkey").alias("s"), F.lit("in").alias("p"), F.col("c_mktsegment").alias("o"))
    names = facts.select("o").distinct().withColumn("canonical", F.when(F.col("o") == "BUILDING", "building (all)").otherwise(F.lower("o")))
    renamed = facts.join(names, "o").select("s", "p", F.col("canonical").alias("o"))
    return set_differences(renamed, facts.withColumn("o", F.lower("o")))
