"""Queries of rule evaluation (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.operators import rules as R
from acrework.operators.audits import crosswalk_faults
from acrework.operators.joins import interval_totals
from acrework.plans.registry import query, table


@query("r01_four_state_rules", """
SELECT p_partkey, CASE WHEN m IS NULL THEN 'not_applicable' WHEN v IS NULL THEN 'unknown' WHEN v >= m * 0.99 THEN 'meets' ELSE 'fails' END AS state
FROM (SELECT p_partkey, p_brand, nullif(p_size, 7) AS v FROM part) LEFT JOIN (SELECT 'Brand#' || i AS p_brand, i * 2.0 AS m FROM range(1, 20) t(i)) USING (p_brand)""")
def r01(spark, sf):
    rules = spark.range(1, 20).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("p_brand"), (F.col("id") * 2.0).alias("minimum"), F.col("id").alias("rule"))
    return R.evaluate_rules(table(spark, sf, "part").withColumn("v", F.nullif("p_size", F.lit(7))), rules, ["p_brand"], "v", 0.01).select("p_partkey", "state")


SCREEN = "SELECT p_partkey, s AS in_scope, s AND k AS evaluated, s AND k AND b AS below FROM (SELECT p_partkey, p_type IN ('STANDARD', 'ECONOMY') AS s, {0} AS k, {1} AS b FROM part)"


def screened(spark, sf, *measures):
    flags = R.screen(F.col("p_type").isin("STANDARD", "ECONOMY"), measures)
    return table(spark, sf, "part").withColumn("area", F.nullif(F.col("p_retailprice"), F.lit(900.0))).withColumn("width", F.nullif("p_size", F.lit(5))).select("p_partkey", *(c.alias(n) for n, c in flags.items()))


@query("r02_minimum_area", SCREEN.format("p_retailprice <> 900", "p_retailprice < 910 * 0.99"))
def r02(spark, sf):
    return screened(spark, sf, (F.col("area"), 910))


@query("r03_minimum_width", SCREEN.format("p_size <> 5", "p_size < 20 * 0.99"))
def r03(spark, sf):
    return screened(spark, sf, (F.col("width"), 20))


@query("r04_area_or_width", SCREEN.format("p_retailprice <> 900 AND p_size <> 5", "(p_retailprice < 910 * 0.99 OR p_size < 20 * 0.99)"))
def r04(spark, sf):
    return screened(spark, sf, (F.col("area"), 910), (F.col("width"), 20))


@query("r05_maximum_coverage", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN least(45, 35 + greatest(0, floor((4000 - a) / 100))) WHEN 1 THEN least(45, 35 + greatest(0, floor((4300 - a) / 100))) END::INT AS cap FROM (SELECT *, p_retailprice * 4 AS a FROM part)""")
def r05(spark, sf):
    kind = F.expr("CASE p_size % 3 WHEN 0 THEN 'single_family' WHEN 1 THEN 'two_family' ELSE 'other' END")
    return table(spark, sf, "part").select("p_partkey", R.maximum_coverage(kind, F.col("p_retailprice") * 4).alias("cap"))


@query("r06_coverage_evaluation", """
WITH s AS (SELECT l_orderkey, sum(l_quantity) AS footprint FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT o_orderkey, CASE WHEN footprint IS NULL THEN 'unknown' WHEN footprint / (o_totalprice / 1000) * 100 <= 45 * 1.01 THEN 'meets' ELSE 'fails' END AS state FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def r06(spark, sf):
    excluded = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    kept = table(spark, sf, "lineitem").select(*excluded.columns).join(excluded, excluded.columns, "left_anti")
    sums = kept.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("footprint"))
    cover = F.col("footprint") / (F.col("o_totalprice") / 1000) * 100
    state = F.when(F.col("footprint").isNull(), "unknown").when(cover <= 45 * 1.01, "meets").otherwise("fails")
    return table(spark, sf, "orders").join(sums, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("r08_principal_ambiguity", """
SELECT l_partkey, count(*) AS parts, round(max(q) / sum(q), 6) AS share, count(*) > 1 AND max(q) / sum(q) < 0.9 AS ambiguous FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def r08(spark, sf):
    by = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q")).groupBy("l_partkey").agg(F.count("*").alias("parts"), (F.max("q") / F.sum("q")).alias("share"))
    return by.withColumn("ambiguous", R.ambiguous(F.col("parts"), F.col("share"))).withColumn("share", F.round("share", 6))


@query("r09_whole_counts", "SELECT p_partkey, (p_size * 2 + 2) // 3 AS at_least, p_size // 2 + 1 AS more_than FROM part")
def r09(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.least_count(F.col("p_size"), 2, 3, False).alias("at_least"), R.least_count(F.col("p_size"), 1, 2, True).alias("more_than"))


@query("r10_vote_requirement", "SELECT p_partkey, p_partkey % 10 >= CASE WHEN p_size % 2 = 0 THEN (9 * 2 + 2) // 3 ELSE 9 // 2 + 1 END AS passes FROM part")
def r10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.vote_passes(F.lit(9), F.col("p_partkey") % 10, F.col("p_size") % 2 == 0).alias("passes"))


@query("r12_spacing_bar", """
SELECT l_partkey, count(DISTINCT l_suppkey) FILTER (l_quantity <= 20) AS sites, count(DISTINCT l_suppkey) FILTER (l_quantity <= 20) >= 2 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AS barred FROM lineitem GROUP BY 1""")
def r12(spark, sf):
    waivers = table(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return R.spacing_bar(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_quantity", 20, waivers)


@query("r11_eligibility", "SELECT o_orderkey, (o_orderstatus = 'F' OR o_orderpriority LIKE '1%') AND NOT o_totalprice > 400000 AS eligible FROM orders")
def r11(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (((F.col("o_orderstatus") == "F") | F.col("o_orderpriority").startswith("1")) & ~(F.col("o_totalprice") > 400_000)).alias("eligible"))


@query("r13_waiver_finding", """
SELECT p_partkey, CASE WHEN NOT (p_type <> 'PROMO') THEN 'denied' WHEN p_size > 25 AND p_retailprice > 910 THEN 'eligible' WHEN p_size > 25 OR p_retailprice > 910 THEN 'ambiguous' ELSE 'none' END AS finding FROM part""")
def r13(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.waiver_finding(F.col("p_type") != "PROMO", F.col("p_size") > 25, F.col("p_retailprice") > 910).alias("finding"))


@query("r14_constraints", "SELECT p_partkey FROM part WHERE (p_size >= 5 AND p_size < 20 OR p_size IN (30, 31)) AND NOT p_size = 12")
def r14(spark, sf):
    spec = {"kind": "all", "of": [{"kind": "any", "of": [{"kind": "interval", "low": 5, "high": 20, "high_open": True}, {"kind": "one_of", "values": [30, 31]}]}, {"kind": "not", "of": [{"kind": "equal", "value": 12}]}]}
    return table(spark, sf, "part").filter(R.constraint(spec, F.col("p_size"))).select("p_partkey")


@query("r14_interval_list", """
WITH i AS (SELECT s_suppkey AS rule, CASE WHEN s_suppkey % 10 > 0 THEN 900.0 + s_suppkey * 7 % 200 END AS low, CASE WHEN s_suppkey % 11 > 0 THEN 900.0 + s_suppkey * 7 % 200 + s_suppkey % 13 * 0.7 END AS high, s_suppkey % 2 = 0 AS high_open FROM supplier)
SELECT p_partkey, count(*) AS rules, min(rule) AS first FROM part JOIN i ON (low IS NULL OR p_retailprice >= low) AND (high IS NULL OR p_retailprice < high OR p_retailprice = high AND NOT high_open) GROUP BY 1""")
def r14_intervals(spark, sf):
    k = F.col("s_suppkey")
    low = 900.0 + k * 7 % 200
    intervals = table(spark, sf, "supplier").select(k.alias("rule"), F.when(k % 10 > 0, low).alias("low"), F.when(k % 11 > 0, low + k % 13 * 0.7).alias("high"), (k % 2 == 0).alias("high_open"))
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    met = parts.join(interval_totals(parts, "p_retailprice", intervals, "rule", high_open="high_open"), "p_retailprice")
    return met.groupBy("p_partkey").agg(F.sum("n").alias("rules"), F.min("rule").alias("first"))


@query("r15_interval_faults", "SELECT p_partkey, CASE WHEN lo > hi THEN 'inverted' WHEN lo = hi AND p_partkey % 2 = 0 THEN 'empty' END AS fault FROM (SELECT p_partkey, p_size % 5 AS lo, p_partkey % 5 AS hi FROM part)")
def r15(spark, sf):
    low, high = (F.col("p_size") % 5).cast("double"), (F.col("p_partkey") % 5).cast("double")
    return table(spark, sf, "part").select("p_partkey", R.interval_fault(low, high, F.col("p_partkey") % 2 == 0, F.lit(False)).alias("fault"))


@query("r16_exact_units", "SELECT p_partkey, (p_size * 9753600 + (p_partkey % 12) * 812800)::DOUBLE AS length, p_size * 7 <= 3 * (1 + p_partkey % 50) AS at_most FROM part")
def r16(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", R.lattice_length(F.col("p_size"), k % 12).cast("double").alias("length"), R.ratio_at_most(F.col("p_size"), 1 + k % 50, F.lit(3), F.lit(7)).alias("at_most"))


@query("r17_fact_errors", """
SELECT s, p, o, CASE WHEN p = 'near' THEN 'unknown relation' WHEN o = 'n99' THEN 'unknown individual' ELSE 'wrong range' END AS error FROM (SELECT 'c' || c_custkey AS s, CASE WHEN c_custkey % 7 = 0 THEN 'near' ELSE 'in' END AS p, CASE WHEN c_custkey % 5 = 0 THEN 'n99' WHEN c_custkey % 5 = 1 THEN 'c' || c_custkey ELSE 'n' || c_nationkey END AS o FROM customer) WHERE p = 'near' OR o = 'n99' OR o LIKE 'c%'""")
def r17(spark, sf):
    k, customers = F.col("c_custkey"), table(spark, sf, "customer")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    facts = customers.select(name("c", "c_custkey").alias("s"), F.when(k % 7 == 0, "near").otherwise("in").alias("p"), F.when(k % 5 == 0, "n99").when(k % 5 == 1, name("c", "c_custkey")).otherwise(name("n", "c_nationkey")).alias("o"))
    kinds = customers.select(name("c", "c_custkey").alias("node"), F.lit("customer").alias("kind")).union(table(spark, sf, "nation").select(name("n", "n_nationkey"), F.lit("nation")))
    return R.fact_errors(facts, spark.createDataFrame([("in", "customer", "nation")], "p string, domain string, range string"), kinds)


@query("r18_conjunctive_pattern", """
SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND date_diff('day', o_orderdate, l_shipdate) >= 15)""")
def r18(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    key = F.col("o_orderkey")
    facts = orders.select(key.alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o")).union(orders.select(key, F.lit("placed by"), F.col("o_custkey").cast("string"))).union(orders.select(key, F.lit("placed on"), F.date_format("o_orderdate", "yyyy-MM-dd"))).union(lines.select("l_orderkey", F.lit("served on"), F.date_format("l_shipdate", "yyyy-MM-dd")))
    of = lambda p, name: facts.filter(F.col("p") == p).select("s", F.col("o").alias(name))
    found = of("status", "status").filter("status = 'F'").join(of("placed by", "who"), "s").join(of("placed on", "start"), "s").join(of("served on", "end"), "s").filter(F.datediff("end", "start") >= 15)
    customers = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("who"), "c_nationkey")
    return found.select("s", "who").distinct().join(customers, "who").select(F.col("s").alias("o_orderkey"), "c_nationkey")


@query("r19_missing_facts", """
SELECT user_id, t AS predicate, CASE WHEN v IS NOT NULL THEN CASE WHEN v THEN 'true' ELSE 'false' END WHEN t = 'error' THEN 'false' ELSE 'unknown' END AS state FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(['error', 'signup']) AS t) LEFT JOIN (SELECT user_id AS u, event_type AS e, bool_or(value > 8) AS v FROM events WHERE value > 6 GROUP BY 1, 2) ON u = user_id AND e = t""")
def r19(spark, sf):
    events = table(spark, sf, "events")
    policy = spark.createDataFrame([("error", True), ("signup", False)], "predicate string, closed boolean")
    asked = events.select("user_id").distinct().withColumn("predicate", F.explode(F.array(F.lit("error"), F.lit("signup")))).join(policy, "predicate")
    facts = events.filter("value > 6").groupBy("user_id", F.col("event_type").alias("predicate")).agg(F.bool_or(F.col("value") > 8).alias("fact"))
    return asked.join(facts, ["user_id", "predicate"], "left").select("user_id", "predicate", R.missing_fact(F.col("fact"), F.col("closed")).alias("state"))


@query("r20_blocked_rules", "SELECT blocked, count(*) AS n FROM (SELECT NOT o_orderstatus = 'F' OR o_orderpriority LIKE '5%' AS blocked FROM orders) GROUP BY 1")
def r20(spark, sf):
    rules = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("draft").alias("status"), F.when(F.col("o_orderpriority").startswith("5"), "open").alias("reading"))
    return R.blocked(rules, "status", "reading").groupBy("blocked").agg(F.count("*").alias("n"))


@query("r21_applicability", """
SELECT o_orderkey, o_orderstatus <> 'P' AND NOT o_orderpriority LIKE '5%' AS applies, CASE WHEN o_orderkey % 10 = 0 THEN 'use list' WHEN k = 7 THEN 'unknown' WHEN o_totalprice > 150000 THEN 'chapter' ELSE 'agreement' END AS control,
o_orderstatus = 'F' AND k <> 3 AND k < 5 AS continues, o_orderstatus = 'F' AND year(o_orderdate) <= 1996 AND o_orderkey % 3 = 0 AND day(o_orderdate) <= 12 AS extension,
o_orderdate::DATE < DATE '1996-01-01' AND k <> 1 AND (k = 2 OR o_orderdate::DATE + k * 100 >= DATE '1996-01-01') AS prior FROM (SELECT *, (o_orderkey % 8)::INT AS k FROM orders)""")
def r21(spark, sf):
    day, k, status = F.to_date("o_orderdate"), (F.col("o_orderkey") % 8).cast("int"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey", R.chapter_applies(status != "P", F.col("o_orderpriority").startswith("5")).alias("applies"), R.controlling_rule(F.when(k != 7, F.col("o_totalprice") > 150_000), F.col("o_orderkey") % 10 == 0, "agreement").alias("control"),
        R.nonconformity_continues(status == "F", k != 3, k >= 5).alias("continues"), R.may_extend(status == "F", F.year(day) <= 1996, F.col("o_orderkey") % 3, F.dayofmonth(day)).alias("extension"),
        R.may_choose_prior_rules(day, F.lit("1996-01-01").cast("date"), F.when(k != 2, F.date_add(day, k * 100)), k != 1).alias("prior"),
    )


@query("r22_ledger_audit", """
WITH l AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN p_partkey - 1 ELSE p_partkey END AS id, p_brand AS section, p_type AS d, CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE p_name END AS note FROM part),
m AS (SELECT DISTINCT p_brand AS section, CASE WHEN p_brand LIKE '%1' THEN upper(sha256(p_brand)) ELSE sha256(p_brand) END AS digest FROM part WHERE p_brand NOT LIKE '%2' UNION ALL SELECT 'Missing', sha256('Missing')),
f AS (SELECT CASE WHEN trim(note) = '' THEN 'note' WHEN d NOT IN ('STANDARD', 'ECONOMY', 'PROMO', 'LARGE') THEN 'disposition' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated' END AS fault FROM l
UNION ALL SELECT 'digest' FROM m WHERE NOT regexp_matches(digest, '^[0-9a-f]{64}$') UNION ALL SELECT 'uncovered' FROM m WHERE section NOT IN (SELECT section FROM l) UNION ALL SELECT 'unlisted' FROM (SELECT DISTINCT section FROM l) WHERE section NOT IN (SELECT section FROM m))
SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1""")
def r22(spark, sf):
    parts, k = table(spark, sf, "part"), F.col("p_partkey")
    ledger = parts.select(F.when(k % 97 == 0, k - 1).otherwise(k).alias("id"), F.col("p_brand").alias("section"), F.col("p_type").alias("disposition"), F.when(k % 31 == 0, " ").otherwise(F.col("p_name")).alias("note"))
    digest = F.sha2("section", 256)
    sections = ledger.filter("section NOT LIKE '%2'").select("section").distinct().withColumn("digest", F.when(F.col("section").endswith("1"), F.upper(digest)).otherwise(digest))
    manifest = sections.union(spark.createDataFrame([("Missing",)], "section string").withColumn("digest", digest))
    faults = R.ledger_faults(ledger, manifest, "id", "section", "disposition", ["STANDARD", "ECONOMY", "PROMO", "LARGE"], ["note"], ["id", "section", "disposition", "note"])
    return faults.groupBy("fault").agg(F.count("*").alias("n"))


@query("r23_current_and_proposed", """
SELECT p_partkey, CASE WHEN a IS NULL THEN 'unknown' WHEN a >= 930 THEN 'meets' ELSE 'fails' END AS current, CASE WHEN a IS NULL THEN 'unknown' WHEN a >= 905 THEN 'meets' ELSE 'fails' END AS proposed FROM (SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_retailprice END, 0), CASE WHEN p_size % 8 = 0 THEN p_size * 40.0 END) AS a FROM part)""")
def r23(spark, sf):
    from acrework.functions.scalars import first_positive

    size = F.col("p_size")
    area = first_positive(F.when(size % 4 == 0, 0.0).otherwise(F.col("p_retailprice")), F.when(size % 8 == 0, size * F.lit(40.0)))
    both = [R.evaluate_minimum(area, F.lit(m), F.lit(True)).alias(n) for n, m in (("current", 930.0), ("proposed", 905.0))]
    return table(spark, sf, "part").select("p_partkey", *both)


@query("r24_vacancy", "SELECT p_partkey, t IS NULL OR contains(t, 'ECONOMY') AS vacant FROM (SELECT p_partkey, nullif(p_type, 'PROMO') AS t FROM part)")
def r24(spark, sf):
    kind = F.nullif("p_type", F.lit("PROMO"))
    return table(spark, sf, "part").select("p_partkey", F.when(kind.isNull(), True).otherwise(kind.contains("ECONOMY")).alias("vacant"))


@query("r25_use_resolution", """
WITH e AS (SELECT DISTINCT p_brand, p_type, p_size <= 3 AS broad FROM part WHERE p_size <= 10)
SELECT p_partkey, EXISTS (SELECT 1 FROM e WHERE e.p_brand = part.p_brand AND (e.p_type = part.p_type OR broad AND left(e.p_type, 1) = left(part.p_type, 1))) AS conforms FROM part""")
def r25(spark, sf):
    parts, initial = table(spark, sf, "part"), F.concat(F.lit("all of "), F.substring("p_type", 1, 1))
    entries = parts.filter("p_size <= 10").select("p_brand", F.when(F.col("p_size") <= 3, initial).otherwise(F.col("p_type")).alias("entry"))
    allowed = R.resolve_uses(entries, parts.select(initial.alias("broad"), "p_type"), "p_brand", "entry", "broad", "p_type").withColumn("conforms", F.lit(True))
    return parts.join(allowed, ["p_brand", "p_type"], "left").select("p_partkey", F.coalesce("conforms", F.lit(False)).alias("conforms"))


@query("r26_formula_requirements", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q IS NOT NULL THEN round(greatest(5.0, (q + l_linenumber) / 6), 6) END AS setback FROM (SELECT *, nullif(l_quantity, 7) AS q FROM lineitem)")
def r26(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(R.formula_setback(F.nullif("l_quantity", F.lit(7.0)), F.col("l_linenumber"), 6), 6).alias("setback"))


@query("r27_branch_tables", """
SELECT p_partkey, CASE WHEN p_size = 9 THEN 'unknown' WHEN p_type = 'PROMO' THEN 'not allowed' WHEN p_size / 50 < 0.5 THEN 'by right' WHEN p_size / 50 > 0.5 THEN 'conditional' ELSE 'unresolved' END AS effect FROM part""")
def r27(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.branch_effect(F.nullif("p_size", F.lit(9)) / 50, F.col("p_type") != "PROMO").alias("effect"))


@query("r28_overlay_prohibitions", """
SELECT c_custkey, rule FROM customer JOIN (VALUES ('BUILDING', 'a'), ('BUILDING', 'b'), ('*', 'c')) r(scope, rule) ON scope = c_mktsegment OR scope = '*'""")
def r28(spark, sf):
    rules = spark.createDataFrame([("BUILDING", "a"), ("BUILDING", "b"), ("*", "c")], "scope string, rule string")
    return R.overlay_prohibitions(table(spark, sf, "customer"), rules, "c_mktsegment").select("c_custkey", "rule")


@query("r29_required_signature", "SELECT 'Brand#' || i AS required FROM range(0, 40) t(i) WHERE 'Brand#' || i NOT IN (SELECT p_brand FROM part)")
def r29(spark, sf):
    required = spark.range(40).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("required"))
    return required.join(table(spark, sf, "part").select(F.col("p_brand").alias("required")), "required", "left_anti")


@query("r30_corpus_audit", """
SELECT doc_id, 'unclassified' AS fault FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def r30(spark, sf):
    return crosswalk_faults(table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id"), "doc_id")
