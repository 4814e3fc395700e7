"""Queries of text operators (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrework.operators import text as X
from acrework.plans.registry import query, table


@query("x01_street_normalisation", """
SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(s), '[^0-9A-Z]+', ' ', 'g'), '\\b(STREET|AVE|WEST)\\b', ' ', 'g'), ' +', ' ', 'g')) AS street FROM (SELECT s_suppkey, 'West ' || s_name || ', Elm.  Street' AS s FROM supplier)""")
def x01(spark, sf):
    street = F.concat(F.lit("West "), F.col("s_name"), F.lit(", Elm.  Street"))
    return table(spark, sf, "supplier").select("s_suppkey", X.normal_street(street, ["STREET", "AVE"], {}, ["WEST"]).alias("street"))


@query("x02_address_keys", """
SELECT s_suppkey, unnest([s_suppkey::VARCHAR, (s_suppkey + 2)::VARCHAR]) AS number, 'Elm Road' AS street FROM supplier""")
def x02(spark, sf):
    k = F.col("s_suppkey")
    text = F.concat(k.cast("string"), F.lit(" & "), (k + 2).cast("string"), F.lit(" Elm (rear) Road between A and B"))
    return X.address_keys(table(spark, sf, "supplier").withColumn("t", text), "t", ["between", "near"]).select("s_suppkey", "number", "street")


@query("x03_evidence_classifier", """
SELECT doc_id, regexp_matches(text, '(?i)the ') AND NOT regexp_matches(text, '(?i)%%%') AND regexp_matches(text, '(?i)tion') AS found, regexp_matches(substring(text, 1, 60), '(?i)der ') AS early FROM documents""")
def x03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.evidence(F.col("text"), "the ", "%%%", "tion").alias("found"), X.evidence(F.col("text"), "der ", window=60).alias("early"))


@query("x04_name_variants", """
SELECT s_suppkey, regexp_matches(upper(trim(regexp_replace('  ' || s_name, '\\s+', ' ', 'g'))), '^(SUPPLIER#0+1|CITY OF)') AS public_owner FROM supplier""")
def x04(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", X.name_variant(["SUPPLIER#0+1", "CITY OF"], F.concat(F.lit("  "), F.col("s_name")), F.lit(None).cast("string")).alias("public_owner"))


@query("x05_owner_classes", """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license|public') THEN 'protected' WHEN regexp_matches(text, '(?i)%%%|secret') THEN 'disposable' ELSE 'private' END AS class FROM documents""")
def x05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.keyword_class(F.col("text"), ["license", "public"], ["%%%", "secret"]).alias("class"))


WORDS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


@query("x09_tokeniser", f"""
SELECT doc_id, len(regexp_extract_all(t, '{WORDS}')) AS words, len(regexp_extract_all(t, '[.,;:!?()]')) AS marks FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '§+\\s*\\d+(?:[-.]\\d+)*', ' ', 'g'), '\\d+(?:[.,]\\d+)*', ' ', 'g') AS t FROM documents WHERE regexp_matches(text, '\\S'))""")
def x09(spark, sf):
    counts = X.token_counts(table(spark, sf, "documents"), "doc_id", "text", ["word", "punctuation"])
    return counts.groupBy("doc_id").agg(F.sum("word").alias("words"), F.sum("punctuation").alias("marks"))


MARKERS = {"modality": ["is", "was"], "condition": ["if", "for"], "coordination": ["and", "or"]}


@query("x10_marker_candidates", """
SELECT kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zß-öø-ÿ]+')) AS w FROM documents) JOIN (VALUES ('is', 'modality'), ('was', 'modality'), ('if', 'condition'), ('for', 'condition'), ('and', 'coordination'), ('or', 'coordination')) m(w, kind) USING (w) GROUP BY 1""")
def x10(spark, sf):
    rows = [(w, k) for k, ws in MARKERS.items() for w in ws]
    markers = spark.createDataFrame(rows, "w string, marker string")
    tokens = X.tokens(table(spark, sf, "documents"), "doc_id", "text").filter("kind = 'word'").withColumn("w", F.lower("token"))
    return tokens.join(F.broadcast(markers), "w").groupBy(F.col("marker").alias("kind")).agg(F.count("*").alias("n"))  # a fixed dictionary


#: Tokens of the documents in SQL, in order.
TOK = f"t AS (SELECT doc_id, (u.pos - 1)::INT AS pos, u.token FROM documents, unnest(regexp_extract_all(text, '{X.TOKEN}')) WITH ORDINALITY AS u(token, pos))"


@query("x11_temporal_neighbourhood", f"""
WITH {TOK}, w AS (SELECT *, lead(token) OVER o AS unit, [lower(lag(token, 2) OVER o), lower(lag(token) OVER o), lower(lead(token) OVER o), lower(lead(token, 2) OVER o)] AS near FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, token, unit FROM w WHERE regexp_matches(token, '^\\d') AND list_has_any(near, ['the', 'and', 'to'])""")
def x11(spark, sf):
    """Windows of tokens around numbers."""
    found = X.neighbourhood(X.tokens(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", ["the", "and", "to"], 2)
    return found.select("doc_id", "pos", "token", "unit")


@query("x12_proper_name_runs", f"""
WITH {TOK}, c AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM t WHERE regexp_matches(token, '^[A-ZÀ-ÖØ-Þ]'))
SELECT doc_id, min(pos) AS pos, count(*) AS words, string_agg(token, ' ' ORDER BY pos) AS name FROM c GROUP BY doc_id, i HAVING count(*) >= 2""")
def x12(spark, sf):
    """Runs of capitalised words."""
    return X.proper_name_runs(X.tokens(table(spark, sf, "documents"), "doc_id", "text"), "doc_id")


@query("x13_phrases_around_modals", f"""
WITH {TOK}, s AS (SELECT *, coalesce(sum((token IN ('.', '!', '?'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence, NOT regexp_matches(token, '^[.,;:!?()]') AS word FROM t),
m AS (SELECT doc_id, pos, sentence, token AS modal, coalesce((SELECT max(c.pos) FROM s c WHERE c.doc_id = s.doc_id AND c.sentence = s.sentence AND c.token = ',' AND c.pos < s.pos), -1) AS begin FROM s WHERE lower(token) IN ('is', 'was'))
SELECT m.doc_id, m.pos, m.sentence, m.modal, coalesce(string_agg(s.token, ' ' ORDER BY s.pos) FILTER (s.word AND s.pos > begin AND s.pos < m.pos), '') AS subject, coalesce(string_agg(s.token, ' ' ORDER BY s.pos) FILTER (s.word AND s.pos > m.pos), '') AS predicate
FROM m JOIN s ON m.doc_id = s.doc_id AND m.sentence = s.sentence GROUP BY 1, 2, 3, 4""")
def x13(spark, sf):
    """Subject and predicate of each modal."""
    return X.phrases_around(X.tokens(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", ["is", "was"])


@query("x14_lexical_hints", """
SELECT hint, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(w, 'tion$') THEN 'noun' WHEN regexp_matches(w, 'ly$') THEN 'adverb' WHEN regexp_matches(w, 'ed$') THEN 'participle' ELSE 'none' END AS hint FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zß-öø-ÿ]+')) AS w FROM documents)) GROUP BY 1""")
def x14(spark, sf):
    w = F.lower("token")
    hint = F.when(w.rlike("tion$"), "noun").when(w.rlike("ly$"), "adverb").when(w.rlike("ed$"), "participle").otherwise("none")
    return X.tokens(table(spark, sf, "documents"), "doc_id", "text").filter("kind = 'word'").groupBy(hint.alias("hint")).agg(F.count("*").alias("n"))


@query("x15_coverage", """
SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-zß-öø-ÿ]+'), lambda w: w IN ('is', 'was', 'if', 'for', 'and', 'or'))) AS linked, len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS words FROM documents WHERE regexp_matches(text, '\\S')""")
def x15(spark, sf):
    words = [w for ws in MARKERS.values() for w in ws]
    rows = X.tokens(table(spark, sf, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count_if((F.col("kind") == "word") & F.lower("token").isin(*words)).alias("linked"), F.count_if(F.col("kind") == "word").alias("words"))


#: SQL: bytes 10 to 30 of a text hold whole characters.
WHOLE = "n >= 30 AND NOT hex(encode(text)[11:11]) BETWEEN '80' AND 'BF' AND (n = 30 OR NOT hex(encode(text)[31:31]) BETWEEN '80' AND 'BF')"


@query("x16_span_verification", f"""
SELECT doc_id, {WHOLE} AS valid, CASE WHEN {WHOLE} THEN sha256(encode(text)[11:30]) END AS quote_sha256,
CASE WHEN NOT ({WHOLE}) THEN 'invalid' WHEN doc_id % 3 = 0 THEN 'changed' WHEN doc_id % 3 = 1 THEN 'occluded' ELSE 'verified' END AS state FROM (SELECT doc_id, text, strlen(text) AS n FROM documents)""")
def x16(spark, sf):
    """Spans cited in the documents and looked up in later versions: some begin with another line, some are cut short."""
    start, end, k = F.lit(10), F.lit(30), F.col("doc_id") % 3
    later = F.when(k == 0, F.concat(F.repeat(F.lit("_"), 40), "text")).when(k == 1, F.substring("text", 1, 5)).otherwise(F.col("text"))
    cited = X.span_citation(table(spark, sf, "documents"), "text", start, end).withColumn("later", later)
    return cited.select("doc_id", "valid", "quote_sha256", X.span_state("later", start, end, F.col("quote_sha256")).alias("state"))


@query("x17_use_matrix", """
SELECT p_type AS use, f AS district, CASE WHEN n = 0 THEN 'not allowed' WHEN n > 100 THEN 'by right' WHEN n > 5 THEN 'conditional' ELSE 'review: L/R' END AS permission
FROM (SELECT p_type, unnest(['R1', 'R2']) AS f, unnest([count(*) FILTER (p_size <= 25), count(*) FILTER (p_size > 48)]) AS n FROM part GROUP BY 1)""")
def x17(spark, sf):
    code = lambda n: F.when(n == 0, "").when(n > 100, "R").when(n > 5, "C").otherwise("L/R")
    wide = table(spark, sf, "part").groupBy(F.concat("p_type", F.lit(" (cont'd)")).alias("use")).agg(code(F.count_if(F.col("p_size") <= 25)).alias("R1"), code(F.count_if(F.col("p_size") > 48)).alias("R2"))
    return X.decode_matrix(wide, ["use"], ["R1", "R2"], {"R": "by right", "C": "conditional", "L": "legislative"}).select("use", "district", "permission")


@query("x18_cell_kinds", """
SELECT kind, rule, count(*) AS n, sum(amount) AS amount FROM (SELECT CASE m WHEN 0 THEN 'number' WHEN 1 THEN 'compound' WHEN 2 THEN 'ratio' WHEN 3 THEN 'cross reference' WHEN 4 THEN 'no minimum' WHEN 5 THEN 'compound' ELSE 'text' END AS kind,
unnest(CASE m WHEN 0 THEN ['single'] WHEN 1 THEN ['individual', 'combined'] WHEN 5 THEN ['first', 'second'] ELSE [NULL] END) AS rule, unnest(CASE m WHEN 0 THEN [p_size] WHEN 1 THEN [p_size, p_size + 10] WHEN 5 THEN [p_size, 30] ELSE [NULL] END)::DOUBLE AS amount FROM (SELECT *, p_partkey % 7 AS m FROM part)) GROUP BY 1, 2""")
def x18(spark, sf):
    size, m = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    both = F.concat(size, F.lit(" ft. minimum / "), (F.col("p_size") + 10).cast("string"), F.lit(" ft. combined"))
    cell = F.when(m == 0, F.concat(size, F.lit(" ft"))).when(m == 1, both).when(m == 2, F.concat(size, F.lit(":1"))).when(m == 3, F.concat(F.lit("See "), size)).when(m == 4, "None").when(m == 5, F.concat(size, F.lit(" or 30"))).otherwise(F.col("p_name"))
    return X.dimensional_rules(table(spark, sf, "part").select(cell.alias("cell")), "cell").groupBy("kind", "rule").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("x19_citations", """
WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'page=(\\d+)', 1)) AS cited FROM (SELECT page_id, url AS html FROM pages))
SELECT page_id, cited, count(*) AS times, CASE WHEN cited::BIGINT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3) THEN 'internal' WHEN cited::BIGINT BETWEEN 3 AND 4 THEN 'reserved' ELSE 'missing' END AS state FROM c GROUP BY 1, 2""")
def x19(spark, sf):
    return X.citations(table(spark, sf, "pages"), "page_id", "url", r"page=(\d+)", table(spark, sf, "nation").filter("n_nationkey < 3"), "n_nationkey", (3, 4))


EFFECTS = {"permission": "with", "prohibition": "not", "measure": "tion"}


@query("x20_prose_effects", """
SELECT doc_id, effect FROM documents, (VALUES ('permission', '(?i)with'), ('prohibition', '(?i)not'), ('measure', '(?i)tion')) r(effect, pattern) WHERE regexp_matches(text, pattern)""")
def x20(spark, sf):
    return X.rule_effects(table(spark, sf, "documents"), "doc_id", "text", EFFECTS)


@query("x21_date_in_name", """
SELECT o_orderkey, o_orderdate::DATE AS day FROM orders""")
def x21(spark, sf):
    day, m = F.col("o_orderdate"), F.col("o_orderkey") % 4
    name = F.concat(F.lit("minutes "), F.when(m == 0, F.date_format(day, "yyyy-MM-dd")).when(m == 1, F.date_format(day, "M-d-yyyy")).when(m == 2, F.date_format(day, "M_d_yyyy")).otherwise(F.date_format(day, "MMddyyyy")), F.lit(".txt"))
    return table(spark, sf, "orders").select("o_orderkey", X.date_in_name(name).alias("day"))


@query("x20_rule_table", """
WITH r AS (SELECT DISTINCT w AS rule FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM benchmark) WHERE length(w) >= 6),
d AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents))
SELECT doc_id, count(*) AS rules, min(rule) AS first FROM d JOIN r ON w = rule GROUP BY 1""")
def x20_rule_table(spark, sf):
    """Which of some thousand rules each document meets: the long words of ``benchmark``, as whole words."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("rule")).distinct().filter(F.char_length("rule") >= 6)
    rules = words.select("rule", F.col("rule").alias("literal"), F.concat(F.lit("\\b"), "rule", F.lit("\\b")).alias("expression"))
    return X.rule_hits(table(spark, sf, "documents"), "doc_id", "text", rules).groupBy("doc_id").agg(F.count("*").alias("rules"), F.min("rule").alias("first"))


@query("x22_gap_listing", """
SELECT p_brand AS rule, list_sort(list_distinct(list(p_type))) AS relations FROM part WHERE p_size > 30 OR p_retailprice > 910 GROUP BY 1""")
def x22(spark, sf):
    entries = lambda test: F.array_compact(F.array(F.when(test, F.struct(F.col("p_type").alias("relation")))))
    nested = table(spark, sf, "part").select(F.col("p_brand").alias("rule"), entries(F.col("p_size") > 30).alias("propositions"), entries(F.col("p_retailprice") > 910).alias("consequents"))
    return X.nested_relations(nested, "rule", ["propositions", "consequents"])


@query("x23_latest_heading", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events""")
def x23(spark, sf):
    return X.latest_heading(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", "event_id").select("event_id", "heading")


@query("x24_section_tree", """
WITH a AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER w AS s1, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS h1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, s1 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS h2 FROM a)
SELECT event_id, concat_ws('/', h1, h2) AS path FROM b""")
def x24(spark, sf):
    events = table(spark, sf, "events").withColumns({"level": F.expr("CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 END"), "head": F.col("event_id").cast("string")})
    return X.section_path(events, "user_id", ["ts", "event_id"], "level", "head", 2).select("event_id", "path")


@query("x24_depth_first", """
WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 END AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
w AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, last_value(CASE WHEN l = 1 THEN event_id END IGNORE NULLS) OVER b AS h1, last_value(CASE WHEN l = 2 THEN event_id END IGNORE NULLS) OVER b AS h2, coalesce(last_value(CASE WHEN l = 1 THEN pos END IGNORE NULLS) OVER b, 0) AS p1, coalesce(last_value(CASE WHEN l = 2 THEN pos END IGNORE NULLS) OVER b, 0) AS p2,
min(CASE WHEN l <= 1 THEN pos END) OVER a AS n1, min(CASE WHEN l <= 2 THEN pos END) OVER a AS n2, min(CASE WHEN l <= 3 THEN pos END) OVER a AS n3
FROM e WINDOW b AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, concat_ws('/', CASE WHEN l > 1 THEN h1 END, CASE WHEN l > 2 AND p2 > p1 THEN h2 END, event_id) AS path, coalesce(CASE l WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END, n + 1) - pos - 1 AS below FROM w WHERE l IS NOT NULL AND event_id % 10 IN (3, 7)""")
def x24_depth_first(spark, sf):
    events = table(spark, sf, "events").withColumns({"level": F.expr("CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 END"), "head": F.col("event_id").cast("string")})
    return X.sections(events, "user_id", ["ts", "event_id"], "level", "head").filter(F.col("head").rlike("[37]$")).select("event_id", "path", "below")


@query("x25_html_blocks", """
SELECT page_id, len(regexp_extract_all(html, '(?s)(<p[ >].*?</p>|<table[ >].*?</table>)')) AS blocks FROM pages WHERE len(regexp_extract_all(html, '(?s)(<p[ >].*?</p>|<table[ >].*?</table>)')) > 0""")
def x25(spark, sf):
    return X.html_blocks(table(spark, sf, "pages"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("blocks"))


@query("x06_minutes_cases", """
SELECT o_custkey, o_orderkey::VARCHAR AS case_number, c_name AS petitioner, CASE o_orderstatus WHEN 'F' THEN 'GRANTED' ELSE 'DENIED' END AS decision, (o_orderkey % 3 + 1)::INT AS votes_for, (o_orderkey % 2)::INT AS votes_against FROM orders JOIN customer ON o_custkey = c_custkey""")
def x06(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    label = F.when(F.col("o_orderkey") % 2 == 0, "BZA PETITIONER: ").otherwise("APPLICANT: ")
    names = lambda n: F.array_join(F.array_repeat(F.lit("Ms. A"), n.cast("int")), ", ")
    case = F.concat(F.lit("CASE NO: "), F.col("o_orderkey").cast("string"), F.lit("\n"), label, F.col("c_name"), F.lit("\nAffirmative: "), names(F.col("o_orderkey") % 3 + 1), F.lit("\nNegative: "), names(F.col("o_orderkey") % 2), F.lit("\nDENIED at first, then "), F.when(F.col("o_orderstatus") == "F", "granted").otherwise("denied"), F.lit("\n"))
    minutes = orders.withColumn("case", case).groupBy("o_custkey").agg(F.concat(F.lit("Roll call\n"), F.array_join(F.collect_list("case"), "")).alias("text"))
    return X.minutes_cases(minutes, "o_custkey", "text").select("o_custkey", "case_number", "petitioner", "decision", "votes_for", "votes_against")


@query("x07_levy_rows", """
SELECT o_custkey, min(year(o_orderdate))::INT AS year, count(*) * 1000 AS value FROM orders GROUP BY 1""")
def x07(spark, sf):
    reports = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("y"), (F.count("*") * 1000).alias("v"))
    line = F.concat(F.when(F.col("o_custkey") % 2 == 0, "").otherwise(" 82 "), F.lit("Riverton  "), F.format_number("v", 0))
    text = F.concat(F.lit("Ad valorem levy "), F.col("y").cast("string"), F.lit("\n 82 Riverton 1\n"), line, F.lit("\nother 5"))
    return X.levy_rows(reports.withColumn("text", text), "o_custkey", "text", "Riverton", "82")


@query("x08_anchor_reconciliation", """
SELECT CASE WHEN y % 3 = 0 THEN 'gap' WHEN y % 2 = 0 THEN 'verified' ELSE 'unverified' END AS state, count(*) AS n FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) WHERE y % 3 <> 0 OR y % 2 = 0 GROUP BY 1""")
def x08(spark, sf):
    totals = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("v"))
    parsed = totals.filter("y % 3 <> 0").withColumn("_ord", F.lit(1))
    return X.reconcile(parsed, totals.filter("y % 2 = 0"), "y", "v").groupBy("state").agg(F.count("*").alias("n"))
