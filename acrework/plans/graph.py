"""Queries of graph operators (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.operators import graph as G
from acrework.plans.registry import query, table


#: Rounds of labels in SQL: links at sf0.01 are joined within a few; every round is a pass over all of them.
ROUNDS = 14


def _labels(links: str, item: str, entity: str) -> str:
    """SQL: the least item that each item reaches over shared entities, round by round, as table ``label``."""
    steps = [f"l0 AS MATERIALIZED (SELECT DISTINCT {item}, {item.split(', ')[-1]} AS v FROM {links})"]
    for i in range(1, ROUNDS + 1):
        steps.append(f"m{i} AS MATERIALIZED (SELECT {entity}, min(v) AS v FROM {links} JOIN l{i - 1} USING ({item}) GROUP BY ALL)")
        steps.append(f"l{i} AS MATERIALIZED (SELECT {item}, min(v) AS v FROM {links} JOIN m{i} USING ({entity}) GROUP BY ALL)")
    return ", ".join([*steps, f"label AS (SELECT * FROM l{ROUNDS})"])


@query("n01_shared_member_components", f"""
WITH k AS MATERIALIZED (SELECT DISTINCT l_orderkey AS item, l_partkey AS entity FROM lineitem), {_labels('k', 'item', 'entity')},
c AS (SELECT *, count(*) OVER (PARTITION BY v) AS size FROM label), e AS (SELECT entity FROM k GROUP BY 1 HAVING count(*) > 1),
n AS (SELECT v, count(DISTINCT entity) AS linking FROM k JOIN e USING (entity) JOIN label USING (item) GROUP BY 1)
SELECT item, v AS component, size, coalesce(linking, 0) AS linking FROM c LEFT JOIN n USING (v) WHERE size > 1""")
def n01(spark, sf):
    """Orders that share a part."""
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("entity"))
    return G.shared_member_components(links, "item", "entity").select("item", "component", "size", "linking")


@query("n02_components_within_category", f"""
WITH r AS (SELECT l_returnflag AS cat, l_orderkey AS item, l_partkey AS p, l_suppkey * 1000 + l_linenumber AS s FROM lineitem), k AS MATERIALIZED (SELECT DISTINCT cat, item, 0 AS which, p AS entity FROM r UNION SELECT cat, item, 1, s FROM r), {_labels('k', 'cat, item', 'cat, which, entity')}
SELECT cat, v AS label, count(DISTINCT item) AS cases, count(DISTINCT p) AS places FROM r JOIN label USING (cat, item) GROUP BY 1, 2""")
def n02(spark, sf):
    """Orders of one return flag that share a part, or supplier and line."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cat"), F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("p"), (F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("s"))
    return G.category_sizes(rows, "cat", "item", ["p", "s"]).select("cat", "label", F.col("items").alias("cases"), F.col("values").alias("places"))


@query("n03_bounded_neighbourhood", """
WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey + 1000000, l_partkey FROM lineitem WHERE l_quantity > 49), a AS (SELECT DISTINCT dst FROM e WHERE src = 7), b AS (SELECT DISTINCT e.dst FROM e JOIN a ON e.src = a.dst)
SELECT 7 AS node, 0 AS steps UNION ALL SELECT dst, 1 FROM a UNION ALL SELECT dst, 2 FROM b WHERE dst <> 7 AND dst NOT IN (SELECT dst FROM a)""")
def n03(spark, sf):
    lines = table(spark, sf, "lineitem")
    supplier = F.col("l_suppkey") + 1_000_000
    edges = lines.select(F.col("l_partkey").alias("src"), supplier.alias("dst")).union(lines.filter("l_quantity > 49").select(supplier, "l_partkey")).distinct()
    return G.neighbourhood(edges, table(spark, sf, "part").filter("p_partkey = 7").select(F.col("p_partkey").alias("node")), 2)


@query("n04_transitive_specialisation", """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0), r(src, dst) AS (SELECT * FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, count(*) AS ancestors, min(dst) AS top FROM r GROUP BY 1""")
def n04(spark, sf):
    edges = table(spark, sf, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 3").alias("dst"))
    return G.closure(edges).groupBy("src").agg(F.count("*").alias("ancestors"), F.min("dst").alias("top"))


@query("n05_cycles", """
WITH RECURSIVE e AS (SELECT c_custkey AS s, c_custkey + 1 AS d FROM customer WHERE c_custkey % 5 <> 4 UNION ALL SELECT c_custkey, c_custkey - 4 FROM customer WHERE c_custkey % 15 = 4 UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 50 = 2),
p AS (SELECT s, d FROM e UNION SELECT p.s, e.d FROM p JOIN e ON p.d = e.s)
SELECT DISTINCT s AS node FROM p WHERE s = d""")
def n05(spark, sf):
    key = F.col("c_custkey")
    to = F.array_compact(F.array(F.when(key % 5 != 4, key + 1), F.when(key % 15 == 4, key - 4), F.when(key % 50 == 2, key)))
    return G.cycle_nodes(table(spark, sf, "customer").select(key.alias("src"), F.explode(to).alias("dst")))


@query("n06_rule_conflicts", """
WITH h AS (SELECT DISTINCT o_custkey AS s, o_orderpriority AS r FROM orders) SELECT s, r, (SELECT min(b.r) FROM h b WHERE b.s = h.s AND b.r < h.r) AS displaced_by FROM h""")
def n06(spark, sf):
    order = spark.createDataFrame([("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("3-MEDIUM", "4-NOT SPECIFIED"), ("4-NOT SPECIFIED", "5-LOW")], "src string, dst string")
    held = table(spark, sf, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderpriority").alias("r"))
    return G.in_force(held, order, "s", "r")


@query("n07_cost_limited_reach", """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, p_size::DOUBLE AS cost FROM part UNION ALL SELECT p_partkey, p_partkey + 3, 40.0::DOUBLE FROM part), r(node, cost) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT dst, r.cost + e.cost FROM r JOIN e ON r.node = e.src WHERE r.cost + e.cost <= 200) SELECT node, min(cost)::DOUBLE AS cost FROM r GROUP BY 1""")
def n07(spark, sf):
    parts = table(spark, sf, "part")
    k = F.col("p_partkey")
    edges = parts.select(k.alias("src"), (k + 1).alias("dst"), F.col("p_size").cast("double").alias("cost")).union(parts.select(k, k + 3, F.lit(40.0)))
    return G.reachable_within(edges, parts.filter("p_partkey = 0").select(k.alias("node")), 200.0)


@query("n08_references", """
SELECT o_custkey AS src, l_partkey AS dst, 'in' AS direction FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE l_partkey = 11 UNION ALL SELECT o_custkey, l_partkey, 'out' FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE o_custkey = 11""")
def n08(spark, sf):
    edges = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return G.references(edges, F.lit(11))


@query("n09_network_comparison", """
WITH b AS (SELECT DISTINCT l_partkey AS s, -1 - l_suppkey AS d FROM lineitem), a AS (SELECT DISTINCT l_partkey AS s, -1 - l_suppkey AS d FROM lineitem WHERE l_quantity > 40), n AS (SELECT (SELECT count(*) FROM (SELECT s FROM b UNION SELECT d FROM b)) AS nb, (SELECT count(*) FROM b) AS eb, (SELECT count(*) FROM (SELECT s FROM a UNION SELECT d FROM a)) AS na, (SELECT count(*) FROM a) AS ea)
SELECT nb AS nodes_before, eb AS edges_before, na AS nodes_after, ea AS edges_after, round(100 * (1 - na / nb), 6) AS node_cut, round(100 * (1 - ea / eb), 6) AS edge_cut FROM n""")
def n09(spark, sf):
    edges = lambda df: df.select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))
    lines = table(spark, sf, "lineitem")
    return G.compare_networks(edges(lines), edges(lines.filter("l_quantity > 40"))).withColumns({"node_cut": F.round("node_cut", 6), "edge_cut": F.round("edge_cut", 6)})
