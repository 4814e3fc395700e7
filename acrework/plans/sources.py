"""Queries of sources and sinks (S): tables written in one of the formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.functions.storage import shared_path
from acrework.plans.registry import query, table
from acrework.sources import tables as T


@query("s01_csv_round_trip", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s01(spark, sf):
    path = shared_path(spark, "csv")
    table(spark, sf, "supplier").write.option("header", True).csv(path)
    return T.read_csv(spark, path, "s_suppkey string, s_name string, s_nationkey int, s_acctbal double")


@query("s02_feature_round_trip", "SELECT c_custkey, c_name, c_custkey * 1.5 AS x FROM customer WHERE c_nationkey = 2")
def s02(spark, sf):
    path = shared_path(spark, "features")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("c_custkey") * 1.5, F.lit(0.0)).alias("coordinates"))
    T.write_features(table(spark, sf, "customer").withColumn("geometry", point), path, ["c_custkey", "c_name", "c_nationkey"])
    back = T.read_feature_lines(spark, path, "c_custkey:int,c_name:string,c_nationkey:int")
    return back.filter("c_nationkey = 2").select("c_custkey", "c_name", F.col("geometry.coordinates")[0].alias("x"))


@query("s03_cached_join", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def s03(spark, sf):
    path = shared_path(spark, "cache")
    build = lambda: table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    T.cached(spark, path, build, ["o_orderstatus"])
    return T.cached(spark, path, build).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s04_crosswalk", "SELECT p_brand || '/' || p_size AS code, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS p_type FROM part GROUP BY 1")
def s04(spark, sf):
    return T.crosswalk(table(spark, sf, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("code"), "p_type"), "code", "p_type")


@query("s05_ledger_scan", "SELECT p_partkey::VARCHAR AS span, p_name AS proposition FROM part")
def s05(spark, sf):
    path = shared_path(spark, "ledger")
    table(spark, sf, "part").select("p_partkey", "p_name").write.option("header", True).option("sep", "\t").csv(path)
    return T.read_csv(spark, path, "span string, proposition string", sep="\t")


@query("s06_whole_documents", "SELECT lang, count(*) AS n, sum(len(replace(text, chr(10), ' '))) AS chars FROM documents GROUP BY 1")
def s06(spark, sf):
    path = shared_path(spark, "texts")
    docs = table(spark, sf, "documents").select("lang", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    docs.write.partitionBy("lang").text(path)
    files = T.read_text_files(spark, f"{path}/*")
    lines = files.select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("s07_page_cache", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 0")
def s07(spark, sf):
    path = shared_path(spark, "pages")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("n_nationkey", "n_name").alias("properties"))
    pages = table(spark, sf, "nation").withColumn("page", F.col("n_nationkey") % 5).groupBy("page").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    torn = F.when(F.col("page") == 0, F.substring("value", 1, 60)).otherwise(F.col("value"))
    pages.select("page", torn.alias("value")).repartition("page").write.partitionBy("page").text(path)
    return T.read_features(spark, f"{path}/*", "n_nationkey:int,n_name:string").select("n_nationkey", "n_name")


@query("s08_pinned_inputs", "SELECT CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'changed' WHEN doc_id % 10 = 3 THEN 'undeclared' ELSE 'verified' END AS state, count(*) AS n FROM documents GROUP BY 1")
def s08(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 10).alias("m"))
    files = docs.filter("m <> 1").select("name", "sha256")
    manifest = docs.filter("m <> 3").select("name", F.when(F.col("m") == 2, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    return T.verify_pins(files, manifest).groupBy("state").agg(F.count("*").alias("n"))


@query("s09_lock_audit", "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN 'snapshot' ELSE 'digest' END AS fault FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def s09(spark, sf):
    k = F.col("doc_id")
    digest = F.sha2("text", 256)
    lock = table(spark, sf, "documents").select(k.cast("string").alias("id"), F.when(k % 7 == 0, " ").otherwise("2025-10-09").alias("snapshot"), F.when(k % 11 == 0, F.substring(digest, 1, 60)).otherwise(digest).alias("sha256"))
    return T.lock_faults(lock)


@query("s10_audit_sink", "SELECT count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part")
def s10(spark, sf):
    root = shared_path(spark, "audit")
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    T.write_audit(parts, parts.agg(F.count("*").alias("n")), root)
    summary = spark.read.schema("n bigint").json(f"{root}/summary")
    rows = T.read_csv(spark, f"{root}/rows", "p_partkey string, p_retailprice double").agg(F.round(F.sum("p_retailprice"), 2).alias("total"))
    return summary.crossJoin(rows)


@query("s11_feature_sink", """SELECT '{"type":"Feature","properties":{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"},"geometry":{"type":"Point","coordinates":[' || s_suppkey || '.0,1.5]}}' AS value FROM supplier""")
def s11(spark, sf):
    path = shared_path(spark, "sink")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey").cast("double"), F.lit(1.5)).alias("coordinates"))
    T.write_features(table(spark, sf, "supplier").withColumn("geometry", point), path, ["s_suppkey", "s_name"])
    return spark.read.text(path)


@query("s12_content_addressed", "SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_partkey\":' || p_partkey || '}') AS digest FROM part")
def s12(spark, sf):
    parts, root = table(spark, sf, "part").select("p_partkey", "p_brand"), shared_path(spark, "published")
    T.publish_latest(parts.filter("p_partkey < 9"), root)
    name = T.publish_latest(parts, root)
    if T.publish_latest(parts.orderBy(F.desc("p_partkey")), root) != name or T.latest(spark, root) != [name]:
        raise ValueError("the same contents have two addresses")
    back = T.read_latest(spark, root, parts.schema)
    return back.select("p_partkey", T.canonical_digest(back.columns).alias("digest"))


@query("s13_slices_and_merge", "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def s13(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    merged = T.merge_slices([T.key_slice(orders, "o_orderkey", 3, i) for i in range(3)], "o_orderkey")
    return merged.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("s14_catalog_sql", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def s14(spark, sf):
    T.register_views(spark, sf, ["region", "nation"])
    return spark.sql("SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")


@query("s15_feed_check", "SELECT (SELECT list(r ORDER BY r) FROM (VALUES ('click'), ('view'), ('calendar')) v(r) WHERE r NOT IN (SELECT event_type FROM events)) AS missing, min(ts)::DATE AS first, max(ts)::DATE AS last, DATE '2024-01-15' BETWEEN min(ts)::DATE AND max(ts)::DATE AS served FROM events")
def s15(spark, sf):
    events = table(spark, sf, "events")
    return T.feed_check(events.select(F.col("event_type").alias("name")), ["click", "view", "calendar"], events.select(F.to_date("ts").alias("day")), "2024-01-15")
