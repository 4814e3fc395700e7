"""Queries of projections, filters and scalar expressions (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.functions import scalars as S
from acrework.operators.audits import contract_faults
from acrework.plans.registry import query, table


@query("p01_numeric_coercion", """
SELECT event_id, TRY_CAST(props AS DOUBLE) AS as_is, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k FROM events""")
def p01(spark, sf):
    return table(spark, sf, "events").select("event_id", S.number(F.col("props")).alias("as_is"), S.number(F.regexp_extract("props", r"(\d+)", 1)).alias("k"))


@query("p02_column_resolver", """
SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def p02(spark, sf):
    df = table(spark, sf, "lineitem")
    flag, quantity = S.resolve(df, ["return_flag", "L_RETURNFLAG"]), S.resolve(df, ["QTY", "L_Quantity"])
    return df.groupBy(F.col(flag).alias("flag")).agg(F.count("*").alias("n"), F.round(F.sum(quantity), 2).alias("quantity"))


@query("p03_default_fill", """
SELECT l_linenumber, round(sum(coalesce(nullif(l_tax, 0), 0.08)), 4) AS tax, sum(1600) AS capacity FROM lineitem GROUP BY 1""")
def p03(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return df.groupBy("l_linenumber").agg(F.round(F.sum(S.with_default(df, "l_tax", 0.08)), 4).alias("tax"), F.sum(S.with_default(df, "capacity", 1600)).alias("capacity"))


@query("p04_first_positive", """
SELECT p_partkey, coalesce(nullif(p_size % 3, 0), nullif(p_size % 5, 0), nullif(p_size, 0)) AS area FROM part""")
def p04(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", S.first_positive(size % 3, size % 5, size).alias("area"))


BANDS = ([0, 50_000, 150_000, 300_000], ["low", "middle", "high", "top"])


@query("p05_bands", """
SELECT CASE WHEN o_totalprice > 0 AND o_totalprice <= 50000 THEN 'low' WHEN o_totalprice > 50000 AND o_totalprice <= 150000 THEN 'middle'
  WHEN o_totalprice > 150000 AND o_totalprice <= 300000 THEN 'high' WHEN o_totalprice > 300000 THEN 'top' END AS band, count(*) AS n FROM orders GROUP BY 1""")
def p05(spark, sf):
    return table(spark, sf, "orders").groupBy(S.band(F.col("o_totalprice"), *BANDS).alias("band")).agg(F.count("*").alias("n"))


@query("p06_threshold_labels", """
SELECT CASE WHEN r < 0.3 THEN 'free' WHEN r < 0.5 THEN 'light' WHEN r < 0.7 THEN 'busy' WHEN r < 0.85 THEN 'dense' WHEN r <= 1.0 THEN 'full' ELSE 'over' END AS label, count(*) AS n
FROM (SELECT l_quantity / 45 AS r FROM lineitem) GROUP BY 1""")
def p06(spark, sf):
    label = S.threshold_label(F.col("l_quantity") / 45, [(0.3, "free"), (0.5, "light"), (0.7, "busy"), (0.85, "dense")], [(1.0, "full")], "over")
    return table(spark, sf, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("p07_lookup_default", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2200 WHEN 'O' THEN 1900 ELSE 1600 END AS capacity FROM orders""")
def p07(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.lookup(F.col("o_orderstatus"), {"F": 2200, "O": 1900}, 1600).alias("capacity"))


@query("p08_identifier", """
SELECT c_custkey, nullif(upper(regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g')), '') AS id, nullif(upper(regexp_replace(c_name, '[0-9A-Za-z#]', '', 'g')), '') AS nothing FROM customer""")
def p08(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.identifier(F.col("c_name")).alias("id"), S.identifier(F.regexp_replace("c_name", "[0-9A-Za-z]", "")).alias("nothing"))


@query("p09_scope_flags", """
SELECT p_size IN (1, 5, 9, 20) AND NOT coalesce(p_brand = 'Brand#2', false) AS in_scope, count(*) AS n FROM part GROUP BY 1""")
def p09(spark, sf):
    scope = S.holds(F.col("p_size").isin(1, 5, 9, 20)) & ~S.holds(F.col("p_brand") == "Brand#2")
    return table(spark, sf, "part").groupBy(scope.alias("in_scope")).agg(F.count("*").alias("n"))


@query("p10_clip", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q IS NOT NULL THEN least(24, greatest(4, q)) END AS clipped FROM (SELECT *, nullif(l_quantity, 7) AS q FROM lineitem)""")
def p10(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.clip(F.nullif("l_quantity", F.lit(7.0)), 4.0, 24.0).alias("clipped"))


@query("p11_bucket_half_even", """
SELECT 2 * round_even(l_quantity / 2, 0) AS bucket, count(*) AS n FROM lineitem GROUP BY 1""")
def p11(spark, sf):
    return table(spark, sf, "lineitem").groupBy(S.bucket(F.col("l_quantity"), 2).alias("bucket")).agg(F.count("*").alias("n"))


@query("p12_whole_needed", """
SELECT greatest(1, CAST(ceil(l_quantity / 12 - 0.5) AS BIGINT)) AS lanes, count(*) AS n FROM lineitem GROUP BY 1""")
def p12(spark, sf):
    return table(spark, sf, "lineitem").groupBy(S.whole_needed(F.col("l_quantity") / 12 - 0.5).cast("long").alias("lanes")).agg(F.count("*").alias("n"))


@query("p13_record_filter", """
SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
WHERE instr(lower(concat_ws(' ', c_name, c_mktsegment)), 'mach') > 0 AND o_orderstatus IN ('F', 'O') AND year(o_orderdate) IN (1995, 1996)""")
def p13(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keep = S.matches_filter([F.col("c_name"), F.col("c_mktsegment")], "Mach", F.col("o_orderstatus"), ["F", "O"], F.year("o_orderdate"), [1995, 1996])
    return joined.filter(keep).select("o_orderkey", "c_name")


@query("p14_query_builder", """
SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND abs(p_size - 12) >= 1e-9 AND p_retailprice > 905""")
def p14(spark, sf):
    return table(spark, sf, "part").filter(S.all_conditions([("p_size", ">=", 10), ("p_size", "<", 40), ("p_size", "!=", 12), ("p_retailprice", ">", 905), ("p_size", "=", None)])).select("p_partkey")


@query("p15_numbers_in_text", """
SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x >= 2 AND x <= 5000)) AS largest FROM documents""")
def p15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_max(S.numbers_in(F.col("text"), 2, 5000)).alias("largest"))


@query("p16_hierarchy", """
SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN '1-URGENT' WHEN bool_or(o_orderpriority = '2-HIGH') THEN '2-HIGH' ELSE min(o_orderpriority) END AS priority FROM orders GROUP BY 1""")
def p16(spark, sf):
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("values"))
    return sets.select("o_custkey", S.first_of_hierarchy(F.col("values"), ["1-URGENT", "2-HIGH"]).alias("priority"))


@query("p17_value_with_evidence", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size % 3 = 1 THEN greatest(3.5, p_size * 3.2) ELSE 7.0 END AS value,
  CASE p_size % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'lanes' ELSE 'class' END AS source FROM part""")
def p17(spark, sf):
    size = F.col("p_size")
    choice = S.tagged([(F.when(size % 3 == 0, F.col("p_retailprice")), "explicit"), (F.when(size % 3 == 1, F.greatest(F.lit(3.5), size * F.lit(3.2))), "lanes"), (F.lit(7.0), "class")])
    return table(spark, sf, "part").select("p_partkey", choice.alias("c")).select("p_partkey", "c.value", "c.source")


@query("p18_joined_key", """
SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY 1""")
def p18(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(S.joined_key(F.collect_set("p_type")).alias("types"))


@query("p19_shortened", """
SELECT doc_id, substring(trim(regexp_extract(text, '^([^.,;]*)', 1), ' '), 1, 40) AS place,
  (CAST(round_even(n_chars * 0.75, 0) AS BIGINT) // 12) || ''' ' || (CAST(round_even(n_chars * 0.75, 0) AS BIGINT) % 12) || '"' AS height FROM documents""")
def p19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.shortened(F.col("text"), ".,;", 40).alias("place"), S.feet_and_inches(F.col("n_chars") / 16).alias("height"))


@query("p20_or_label", """
SELECT event_id, coalesce(nullif(trim(replace(props, '{"k": 7}', '  ')), ''), 'Not recorded') AS props FROM events""")
def p20(spark, sf):
    return table(spark, sf, "events").select("event_id", S.or_label(F.replace("props", F.lit('{"k": 7}'), F.lit("  ")), "Not recorded").alias("props"))


@query("p21_spreadsheet_guard", """
SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+@\\-\\t\\r]') THEN '''' || t ELSE t END AS cell FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' ELSE '' END || text AS t FROM documents)""")
def p21(spark, sf):
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", S.spreadsheet_safe(text).alias("cell"))


@query("p22_web_url", """
SELECT page_id, CASE WHEN regexp_matches(u, '^https?://') THEN u END AS url FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ftp' || substring(url, 5) ELSE url END AS u FROM pages)""")
def p22(spark, sf):
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ftp"), F.substr("url", F.lit(5)))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", S.web_url(url).alias("url"))


@query("p24_parameter_sweep", """
SELECT a AS assumption, count(*) FILTER (p_size * a > 10000) AS n, round(sum(p_size * a) / 43560.0, 3) AS acres FROM part, (SELECT unnest([250, 300, 350, 400]) AS a) GROUP BY 1""")
def p24(spark, sf):
    swept = table(spark, sf, "part").select("p_size", F.explode(F.array(*map(F.lit, (250, 300, 350, 400)))).alias("assumption"))
    total = F.col("p_size") * F.col("assumption")
    return swept.groupBy("assumption").agg(F.count_if(total > 10000).alias("n"), F.round(F.sum(total) / F.lit(43560.0), 3).alias("acres"))


@query("p25_envelope_filter", """
SELECT p_partkey FROM (SELECT p_partkey, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y, 1 + p_partkey % 20 AS s FROM part) WHERE x <= 400 AND x + s >= 200 AND y <= 500 AND y + s >= 300""")
def p25(spark, sf):
    k = F.col("p_partkey")
    x, y, s = F.pmod(k * 37, F.lit(1000)), F.pmod(k * 91, F.lit(1000)), 1 + F.pmod(k, F.lit(20))
    return table(spark, sf, "part").filter(S.boxes_meet({"xmin": 200, "xmax": 400, "ymin": 300, "ymax": 500}, x, y, x + s, y + s)).select("p_partkey")


@query("p23_contract_audit", """
SELECT c_custkey, CASE WHEN NOT coalesce(c_acctbal > -500, false) THEN 'balance' ELSE 'repeated' END AS fault
FROM (SELECT *, count(*) OVER (PARTITION BY c_custkey % 400) AS n FROM customer) WHERE NOT coalesce(c_acctbal > -500, false) OR n > 3""")
def p23(spark, sf):
    customers = table(spark, sf, "customer").withColumn("slot", F.col("c_custkey") % 400)
    return contract_faults(customers, "slot", ["c_name"], {"balance": F.col("c_acctbal") > -500}, most_per_key=3).select("c_custkey", "fault")
