"""Queries of domain pipelines and triples (D, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.functions import scalars as S
from acrework.operators import aggregates as A
from acrework.operators import domain as D
from acrework.operators import text as X
from acrework.operators import windows as W
from acrework.plans.aggregates import HOLDOUT_SQL, SERIES_SQL, estimates, yearly
from acrework.plans.registry import query, table


@query("d01_volume_over_capacity", """
WITH v AS (SELECT l_quantity * 900 * 0.1 * 0.55 AS peak, l_linenumber / 2 AS lanes, CASE l_suppkey % 6 WHEN 1 THEN 2200 WHEN 2 THEN 2000 WHEN 3 THEN 1800 WHEN 4 THEN 1700 ELSE 1600 END AS cap FROM lineitem),
r AS (SELECT peak / (lanes * cap) AS vc, greatest(1, ceil(peak / cap)) AS needed, lanes FROM v)
SELECT CASE WHEN vc < 0.3 THEN 'free' WHEN vc < 0.5 THEN 'light' WHEN vc < 0.7 THEN 'moderate' WHEN vc < 0.85 THEN 'heavy' WHEN vc <= 1.0 THEN 'near capacity' ELSE 'over capacity' END AS category, count(*) AS n, round(sum(needed), 2) AS needed, round(sum(greatest(0, lanes - needed)), 2) AS excess FROM r GROUP BY 1""")
def d01(spark, sf):
    segments = table(spark, sf, "lineitem").select((F.col("l_quantity") * 900).alias("AADT"), F.col("l_linenumber").alias("THROUGH_LANES"), (F.col("l_suppkey") % 6).cast("int").alias("F_SYSTEM"))
    out = D.volume_over_capacity(segments, {"volume": ["aadt"], "lanes": ["through_lanes", "lanes"], "class": ["f_system"], "k": ["k_factor"], "d": ["dir_factor"], "miles": ["section_length"]})
    return out.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("needed").cast("double"), 2).alias("needed"), F.round(F.sum("excess").cast("double"), 2).alias("excess"))


@query("d02_value_per_area", """
SELECT CASE WHEN r <= 1200 THEN 'low' WHEN r <= 2500 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(sum(l_extendedprice), 2) AS value FROM (SELECT l_extendedprice / l_quantity AS r, l_extendedprice FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0) GROUP BY 1""")
def d02(spark, sf):
    rated = D.value_per_area(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", [0, 1200, 2500], ["low", "middle", "high"])
    return rated.filter("recorded").groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


@query("d03_site_selection", """
WITH s AS (SELECT p_partkey, p_size, CASE WHEN regexp_matches(p_name, '(?i)red|blue') THEN 'protected' WHEN regexp_matches(p_name, '(?i)widget|ring') THEN 'disposable' ELSE 'private' END AS owner FROM part), g AS (SELECT * FROM s WHERE owner = 'disposable')
SELECT limit_at, count(*) FILTER (p_size >= limit_at) AS sites, coalesce(sum(p_size) FILTER (p_size >= limit_at), 0) AS total FROM g, (SELECT unnest([10, 15, 30]) AS limit_at) GROUP BY 1""")
def d03(spark, sf):
    owner = X.keyword_class(F.col("p_name"), ["red", "blue"], ["widget", "ring"])
    sites = table(spark, sf, "part").filter(owner == "disposable").select("p_size", F.explode(F.array(F.lit(10), F.lit(15), F.lit(30))).alias("limit_at"))
    meets = F.col("p_size") >= F.col("limit_at")
    return sites.groupBy("limit_at").agg(F.count_if(meets).alias("sites"), F.coalesce(F.sum(F.when(meets, F.col("p_size"))), F.lit(0)).alias("total"))


#: The gates of a site: big enough, not protected, cheap, disposable.
GATES = "p_size >= 15", "NOT regexp_matches(p_name, '(?i)red|blue')", "p_retailprice < 1000", "regexp_matches(p_name, '(?i)widget|ring')"


def site_gates():
    owner = X.keyword_class(F.col("p_name"), ["red", "blue"], ["widget", "ring"])
    return [("size", F.col("p_size") >= 15), ("open", owner != "protected"), ("price", F.col("p_retailprice") < 1000), ("disposable", owner == "disposable")]


@query("d03_funnel", "WITH c AS (SELECT count(*) AS g0, " + ", ".join(f"count(*) FILTER ({' AND '.join(GATES[:i])}) AS g{i}" for i in range(1, 5)) + " FROM part) " + " UNION ALL ".join(f"SELECT '{n}' AS gate, g{i} AS remaining, round(g{i} / g0, 6) AS share, g{max(i - 1, 0)} - g{i} AS cut FROM c" for i, n in enumerate(("all", "size", "open", "price", "disposable"))))
def d03_funnel(spark, sf):
    return W.funnel(table(spark, sf, "part"), site_gates()).select("gate", "remaining", F.round("share", 6).alias("share"), "cut")


@query("d03_candidates", f"SELECT p_partkey, p_size FROM part WHERE {' AND '.join(GATES)}")
def d03_candidates(spark, sf):
    return D.ranked_candidates(table(spark, sf, "part"), site_gates(), "p_size", "p_partkey").select("p_partkey", "p_size")


@query("d04_land_value_model", HOLDOUT_SQL + "SELECT l_partkey, method, round(avg(estimate), 8) AS estimate, count(*) AS n FROM e WHERE NOT train GROUP BY 1, 2")
def d04(spark, sf):
    return estimates(spark, sf).filter("NOT train").groupBy("l_partkey", "method").agg(F.round(F.avg("estimate"), 8).alias("estimate"), F.count("*").alias("n"))


@query("d05_two_vintage_change", """
SELECT a.k, round((b.v - a.v) / a.v * 100, 4) AS change FROM (SELECT l_partkey AS k, max(l_extendedprice / l_quantity) AS v FROM lineitem WHERE year(l_shipdate) <= 1996 GROUP BY 1) a JOIN (SELECT l_partkey AS k, max(l_extendedprice / l_quantity) AS v FROM lineitem WHERE year(l_shipdate) > 1996 GROUP BY 1) b USING (k)""")
def d05(spark, sf):
    from acrework.operators.joins import cohort

    prices = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k"), (F.year("l_shipdate") > 1996).alias("late")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    both = cohort(prices.filter("NOT late"), prices.filter("late"), "k", "v")
    return both.select("k", F.round((F.col("after") - F.col("before")) / F.col("before") * 100, 4).alias("change"))


@query("d06_tax_scenarios", """
WITH y AS (SELECT s_suppkey, abs(s_acctbal) AS l, 3 * abs(s_acctbal) * pow(1 - t / 21, 1.5) AS b, t FROM supplier, range(0, 21) r(t) WHERE s_acctbal <> 0), s AS (SELECT s_suppkey, sum((l + b) * 0.06 / pow(1.04, t)) AS c, sum((l + b * (1 - 0.7)) * 0.06 / pow(1.04, t)) AS a, sum(l * 0.06 / pow(1.04, t)) AS o FROM y GROUP BY 1)
SELECT s_suppkey, round(c, 2) AS conventional, round(a, 2) AS abated, round(o, 2) AS land_only, round(1 - o / c, 6) AS reduction FROM s""")
def d06(spark, sf):
    worth = F.abs("s_acctbal")
    years = D.tax_scenarios(table(spark, sf, "supplier").filter("s_acctbal <> 0"), "s_suppkey", worth, 3 * worth, 0.06)
    values = D.present_values(years, "s_suppkey", 0.04)
    return values.select("s_suppkey", *(F.round(c, 2).alias(c) for c in ("conventional", "abated", "land_only")), F.round("reduction", 6).alias("reduction"))


@query("d07_shortfall_audit", """
SELECT o_orderpriority AS type, count(*) AS cases, count(*) FILTER (q IS NOT NULL) AS numeric_cases, coalesce(sum(greatest(0, 100 - q)), 0) AS short, round(coalesce(sum(greatest(0, 100 - q)), 0) * 300 / 43560, 4) AS acres FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def d07(spark, sf):
    reviewed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    rows = table(spark, sf, "orders").join(reviewed, "o_orderkey", "left").withColumn("gap", S.clip(100 - F.col("q"), 0.0))
    short = F.coalesce(F.sum("gap"), F.lit(0.0))
    return rows.groupBy(F.col("o_orderpriority").alias("type")).agg(F.count("*").alias("cases"), F.count("q").alias("numeric_cases"), short.alias("short"), F.round(short * 300 / 43560, 4).alias("acres"))


SPACING = """WITH v AS (SELECT l_orderkey AS k, sum(l_quantity) AS actual, 50.0 * count(*) AS required, CASE WHEN min(l_linenumber) % 2 = 0 THEN 'church' ELSE 'school' END AS context FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Granted' WHEN 'O' THEN 'Denied' ELSE 'Other' END AS outcome, context, actual / required AS share, CASE WHEN o_totalprice < 50000 THEN 'not_spacing_case' WHEN k IS NOT NULL THEN 'explicit_pair' ELSE 'not_stated' END AS status FROM orders LEFT JOIN v ON k = o_orderkey)
"""


def spacing(spark, sf):
    orders = table(spark, sf, "orders")
    context = F.when(F.min("l_linenumber") % 2 == 0, "church").otherwise("school")
    pairs = table(spark, sf, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("actual"), (50.0 * F.count("*")).alias("required"), context.alias("context"))
    return D.spacing_audit(orders, pairs, orders.filter("o_totalprice < 50000"), "o_orderkey", "o_orderstatus", "F", "O")


@query("d08_spacing_audit", SPACING + "SELECT status, outcome, count(*) AS n, round(median(share) FILTER (status = 'explicit_pair'), 6) AS median FROM c GROUP BY 1, 2")
def d08(spark, sf):
    cases = spacing(spark, sf).select(F.col("audit_status").alias("status"), F.col("outcome_label").alias("outcome"), F.when(F.col("audit_status") == "explicit_pair", F.col("distance_share")).alias("share"))
    middle = A.exact_quantiles(cases, ["status", "outcome"], "share", [0.5]).select("status", "outcome", F.round(F.col("quantiles")[0], 6).alias("median"))
    return cases.groupBy("status", "outcome").agg(F.count("*").alias("n")).join(middle, ["status", "outcome"], "left")


@query("d08_context_outcomes", SPACING + "SELECT context, count(*) FILTER (outcome = 'Granted') AS granted, count(*) FILTER (outcome = 'Denied') AS denied, count(*) FILTER (outcome = 'Other') AS other, count(*) AS total FROM c WHERE status = 'explicit_pair' GROUP BY 1")
def d08_contexts(spark, sf):
    found = A.pivot_counts(spacing(spark, sf).filter("audit_status = 'explicit_pair'"), "context", "outcome_label", ["Granted", "Denied", "Other"])
    return found.withColumnsRenamed({"Granted": "granted", "Denied": "denied", "Other": "other"})


@query("d09_height_audit", """
SELECT outcome, count(*) AS n, round(median(x), 6) AS median_excess FROM (SELECT o_orderstatus AS outcome, o_totalprice / 200000 - 1 AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND x > 0 GROUP BY 1""")
def d09(spark, sf):
    latest = W.dedupe(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).withColumn("x", F.col("o_totalprice") / 200_000 - 1)
    found = A.exact_quantiles(latest.filter("x > 0").select(F.col("o_orderstatus").alias("outcome"), "x"), ["outcome"], "x", [0.5])
    return found.select("outcome", "n", F.round(F.col("quantiles")[0], 6).alias("median_excess"))


SITES = """WITH r AS (SELECT p_partkey AS rec, (p_partkey % 100)::VARCHAR AS number, upper(p_name) AS bare, CASE p_size % 3 WHEN 0 THEN 'N ' WHEN 1 THEN 'S ' ELSE '' END || upper(p_name) AS street FROM part),
c AS (SELECT o_orderkey, o_orderdate::DATE AS day, number, bare, CASE WHEN o_orderkey % 2 = 0 THEN street ELSE bare END AS street FROM orders JOIN r ON rec = o_custkey),
e AS (SELECT number, street, min(rec) AS exact FROM r GROUP BY 1, 2), l AS (SELECT number, bare, min(rec) AS loose FROM r GROUP BY 1, 2 HAVING count(*) = 1),
s AS (SELECT number, street, min(coalesce(exact, loose)) AS record, count(DISTINCT day) AS appearances, count(DISTINCT o_orderkey) AS cases, min(day) AS first_seen, max(day) AS last_seen FROM c LEFT JOIN e USING (number, street) LEFT JOIN l USING (number, bare) WHERE coalesce(exact, loose) IS NOT NULL GROUP BY 1, 2)
"""


def sites(spark, sf):
    parts, direction = table(spark, sf, "part"), F.expr("CASE p_size % 3 WHEN 0 THEN 'N ' WHEN 1 THEN 'S ' ELSE '' END")
    number = (F.col("p_partkey") % 100).cast("string")
    records = parts.select(F.col("p_partkey").alias("rec"), number.alias("number"), F.concat(direction, F.upper("p_name")).alias("street"))
    place = F.concat(number, F.lit(" "), F.when(F.col("o_orderkey") % 2 == 0, direction).otherwise(""), F.col("p_name"), F.lit(" Street near park"))
    told = table(spark, sf, "orders").join(parts, F.col("o_custkey") == F.col("p_partkey")).select("o_orderkey", F.to_date("o_orderdate").alias("day"), place.alias("place"))
    cases = X.address_keys(told, "place", ["near"]).withColumn("street", X.normal_street(F.col("street"), ["STREET"]))
    return D.repeat_sites(cases, records, "o_orderkey", "day", "rec")


@query("d10_repeat_sites", SITES + "SELECT * FROM s")
def d10(spark, sf):
    return sites(spark, sf)


@query("d10_most_repeated", SITES + "SELECT * FROM s WHERE appearances > 1 ORDER BY appearances DESC, cases DESC, street, number LIMIT 10")
def d10_ranking(spark, sf):
    return D.most_repeated(sites(spark, sf))


@query("d11_public_case_file", """
SELECT o_orderkey, len(h) AS n_hearings, h[1].d AS first_day, h[-1].f AS last_flag FROM (SELECT o_orderkey, list_sort(list({'d': l_shipdate, 'n': l_linenumber, 'p': l_partkey, 'f': l_returnflag})) AS h FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def d11(spark, sf):
    hearings = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    files = D.case_file(table(spark, sf, "orders"), hearings, "o_orderkey", "l_shipdate", ["l_linenumber", "l_partkey", "l_returnflag"]).filter("n_hearings > 0")
    return files.select("o_orderkey", "n_hearings", F.element_at("hearings", 1)["l_shipdate"].alias("first_day"), F.element_at("hearings", -1)["l_returnflag"].alias("last_flag"))


@query("d12_filtered_summary", """
SELECT o_orderstatus AS label, count(*) AS total, count(*) FILTER (o_custkey % 3 > 0) AS mapped, count(*) FILTER (o_custkey % 5 = 0) AS undated FROM orders WHERE instr(lower(o_orderpriority), 'high') > 0 OR instr(lower(o_orderpriority), 'low') > 0 GROUP BY 1""")
def d12(spark, sf):
    orders = table(spark, sf, "orders")
    keep = S.matches_filter([F.col("o_orderpriority")], "high") | S.matches_filter([F.col("o_orderpriority")], "low")
    return orders.filter(keep).groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("total"), F.count_if(F.col("o_custkey") % 3 > 0).alias("mapped"), F.count_if(F.col("o_custkey") % 5 == 0).alias("undated")).orderBy(F.desc("total"), "label")


@query("d13_value_recovery", SERIES_SQL + """, p AS (SELECT series, max(v) AS peak, arg_max(y, v) AS py FROM s GROUP BY 1), t AS (SELECT series, min(v) AS trough FROM s JOIN p USING (series) WHERE y >= py GROUP BY 1)
SELECT series, round(1 - trough / peak, 6) AS lost, round(CASE WHEN trough < peak THEN ln(peak / trough) / ln(1.03) ELSE 0 END, 6) AS years FROM p JOIN t USING (series)""")
def d13(spark, sf):
    from acrework.operators.temporal import recovery_years

    found = A.peak_and_trough(yearly(spark, sf), "series", "y", "v")
    return found.select("series", F.round("drop", 6).alias("lost"), F.round(recovery_years(F.col("drop"), 0.03), 6).alias("years"))


@query("d14_district_profile", """
WITH r AS (SELECT *, c_custkey % 4 + 0.0 AS w, greatest(c_acctbal, 0) AS paid, abs(c_acctbal) AS moved FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2))
SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, CASE WHEN sum(moved) > 0 THEN round(sum(paid) / sum(moved) * 100, 4) END AS paid_pct, CASE WHEN sum(w) > 0 THEN round(sum(c_acctbal * w) FILTER (w > 0) / nullif(sum(w) FILTER (w > 0), 0), 4) END AS weighted FROM r GROUP BY 1""")
def d14(spark, sf):
    chosen = table(spark, sf, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"))
    rows = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("total"), F.greatest("c_acctbal", F.lit(0)).alias("paid"), F.abs("c_acctbal").alias("moved"), F.col("c_acctbal").alias("weighted"), (F.col("c_custkey") % 4).cast("double").alias("w"))
    found = A.district_profile(rows, chosen, "c_nationkey", ["total"], {"paid_pct": ("paid", "moved")}, ["weighted"], "w", by=["c_mktsegment"])
    return found.select("c_mktsegment", "n", F.round("total", 2).alias("total"), F.round("paid_pct", 4).alias("paid_pct"), F.round("weighted", 4).alias("weighted"))


@query("d15_margin_and_turnout", """
SELECT round(median(m), 6) AS median, round(avg(m), 6) AS mean, round(min(m), 6) AS low, round(max(m), 6) AS high, count(*) AS n FROM (SELECT c_nationkey, (count(*) FILTER (c_acctbal > 4000) - count(*) FILTER (c_acctbal <= 4000)) / count(*) AS m FROM customer GROUP BY 1)""")
def d15(spark, sf):
    yes = F.col("c_acctbal") > 4000
    margins = table(spark, sf, "customer").groupBy("c_nationkey").agg(((F.count_if(yes) - F.count_if(~yes)) / F.count("*")).alias("m"))
    return margins.agg(F.round(F.median("m"), 6).alias("median"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.min("m"), 6).alias("low"), F.round(F.max("m"), 6).alias("high"), F.count("*").alias("n"))


@query("d16_housing_burden", """
WITH s AS (SELECT n_regionkey, sum(CASE WHEN r > 0.3 THEN 1 ELSE 0 END) / count(*) AS a, sum(CASE WHEN r > 0.5 THEN 1 ELSE 0 END) / count(*) AS b FROM (SELECT c_nationkey, 3000 / nullif(c_acctbal, 0) AS r FROM customer WHERE c_acctbal > 0) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_regionkey, round(a, 6) AS over_30, round(b, 6) AS over_50, CASE WHEN a < 0.1 THEN 'low' WHEN a < 0.3 THEN 'moderate' WHEN b < 0.3 THEN 'high' ELSE 'severe' END AS category FROM s""")
def d16(spark, sf):
    crosswalk = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = table(spark, sf, "customer").filter("c_acctbal > 0").join(crosswalk, "c_nationkey")
    out = D.burden(rows, "n_regionkey", F.lit(3000.0), F.col("c_acctbal"), F.lit(1))
    return out.withColumns({"over_30": F.round("over_30", 6), "over_50": F.round("over_50", 6)})


@query("d17_rule_change_impact", """
SELECT p_type, count(*) FILTER (p_size < 20) AS nonconforming, count(*) FILTER (p_size < 20 AND p_size >= 8) AS legalised, round(count(*) FILTER (p_size < 20) / count(*), 6) AS share FROM part GROUP BY 1""")
def d17(spark, sf):
    from acrework.operators.rules import evaluate_minimum

    size = F.col("p_size")
    now, then = evaluate_minimum(size, F.lit(20), F.lit(True)), evaluate_minimum(size, F.lit(8), F.lit(True))
    return table(spark, sf, "part").groupBy("p_type").agg(F.count_if(now == "fails").alias("nonconforming"), F.count_if((now == "fails") & (then == "meets")).alias("legalised"), F.round(F.count_if(now == "fails") / F.count("*"), 6).alias("share"))


@query("d18_request_outcomes", """
WITH h AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
p AS (SELECT o_orderstatus AS s, CASE WHEN m = 0 AND a THEN 'A' WHEN m = 0 AND n THEN 'N' WHEN m = 1 AND r THEN 'R' WHEN m = 1 AND a THEN 'A' WHEN r THEN 'R' WHEN n THEN 'N' WHEN a THEN 'A' ELSE 'unspecified' END AS request FROM (SELECT *, o_orderkey % 3 AS m FROM orders) LEFT JOIN h ON k = o_orderkey)
SELECT request, count(*) FILTER (s = 'F') AS granted, count(*) FILTER (s = 'O') AS denied, count(*) AS total, round(count(*) FILTER (s = 'F') / count(*), 6) AS grant_share FROM p WHERE s IN ('F', 'O') GROUP BY 1""")
def d18(spark, sf):
    listing = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'A|N' WHEN 1 THEN 'R|A' ELSE 'X' END")
    cases = table(spark, sf, "orders").withColumn("listing", listing)
    listed = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("category"))
    found = D.request_outcomes(cases, listed, "o_orderkey", "listing", "category", "o_orderstatus", "F", "O", {"R": 1, "N": 2, "A": 3})
    return found.withColumn("grant_share", F.round("grant_share", 6))


@query("d19_case_histories", """
SELECT l_orderkey, count(DISTINCT l_shipdate) AS appearances, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, CASE WHEN l_orderkey % 50 = 0 THEN 'reviewed' ELSE arg_max(l_returnflag, l_shipdate::VARCHAR || l_returnflag) END AS final_outcome FROM lineitem GROUP BY 1""")
def d19(spark, sf):
    lines = table(spark, sf, "lineitem")
    overrides = lines.filter("l_orderkey % 50 = 0").select("l_orderkey").distinct().withColumn("l_returnflag", F.lit("reviewed"))
    return D.case_histories(lines, "l_orderkey", "l_shipdate", "l_returnflag", overrides)


@query("d20_provision_ledger", """
WITH n AS (SELECT source, count(*) AS rules FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 7 = 0 GROUP BY 1),
m AS (SELECT doc_id, count(*) AS cited, sum(times) AS mentions FROM (SELECT doc_id, c, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([a-z]+)tion', 1)) AS c FROM documents) GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, list_filter(['measure', 'permission', 'prohibition'], lambda e: CASE e WHEN 'permission' THEN regexp_matches(text, '(?i)with') WHEN 'prohibition' THEN regexp_matches(text, '(?i)not') ELSE regexp_matches(text, '(?i)tion') END) AS classes, coalesce(cited, 0) AS cited, coalesce(mentions, 0)::BIGINT AS mentions, coalesce(rules, 0) AS rules, CASE WHEN rules > 0 THEN 'partially_reviewed_executable' ELSE 'source_encoded' END AS state FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN n USING (source)""")
def d20(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    effects = X.rule_effects(docs, "doc_id", "text", {"permission": "with", "prohibition": "not", "measure": "tion"})
    cited = X.citations(docs, "doc_id", "text", "([a-z]+)tion", table(spark, sf, "nation"), "n_nationkey")
    rules = docs.select("doc_id", "source").join(labels.filter("quality = 1 AND doc_id % 7 = 0"), "doc_id").select("source")
    return D.provision_ledger(docs, effects, cited, rules, "doc_id", "source").select("doc_id", "classes", "cited", "mentions", "rules", "state")


TRIPLES = """WITH t AS (SELECT 'c' || c_custkey AS s, 'in' AS p, 'n' || c_nationkey AS o FROM customer UNION ALL SELECT 'n' || n_nationkey, 'in', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || c_custkey, 'kind', c_mktsegment FROM customer)
"""


def triples(spark, sf):
    """Customers, nations and segments as subject, predicate, object."""
    customers = table(spark, sf, "customer")
    who = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = [
        customers.select(who.alias("s"), F.lit("in").alias("p"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("o")),
        nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("in").alias("p"), F.col("r_name").alias("o")),
        customers.select(who.alias("s"), F.lit("kind").alias("p"), F.col("c_mktsegment").alias("o")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k01_triples", TRIPLES + "SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM t GROUP BY 1")
def k01(spark, sf):
    return triples(spark, sf).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query("k02_permissions_by_district", TRIPLES + "SELECT a.s FROM t a JOIN t b ON a.o = b.s JOIN t c ON a.s = c.s WHERE a.p = 'in' AND b.p = 'in' AND b.o = 'ASIA' AND c.p = 'kind' AND c.o = 'BUILDING'")
def k02(spark, sf):
    t = triples(spark, sf)
    asia = t.filter("p = 'in' AND o = 'ASIA'").select(F.col("s").alias("o"))
    kind = t.filter("p = 'kind' AND o = 'BUILDING'").select("s")
    return t.filter("p = 'in'").join(asia, "o").join(kind, "s").select("s")


@query("k03_standards_by_substring", TRIPLES + "SELECT o, count(*) AS n FROM t WHERE p = 'kind' AND contains(lower(o), 'hin') GROUP BY 1")
def k03(spark, sf):
    return triples(spark, sf).filter((F.col("p") == "kind") & F.lower("o").contains("hin")).groupBy("o").agg(F.count("*").alias("n"))


@query("k04_definition_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def k04(spark, sf):
    return table(spark, sf, "documents").filter(F.lower("text").contains("license")).select("doc_id")
