"""Text operators over document tables: normalisation, keys, evidence, tokens, citations, sections."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from acrework.functions.storage import cut_lineage


def normal_street(street: Column, suffixes: Sequence[str], fixes: dict[str, str] | None = None, directions: Sequence[str] = ()) -> Column:
    """Upper case, punctuation to single spaces, spelling fixes, suffix words (and, if given, directions) dropped."""
    out = F.regexp_replace(F.upper(street), r"[^0-9A-Z]+", " ")
    for wrong, right in (fixes or {}).items():
        out = F.regexp_replace(out, rf"\b{wrong}\b", right)
    dropped = "|".join([*suffixes, *directions])
    return F.trim(F.regexp_replace(F.regexp_replace(out, rf"\b({dropped})\b", " "), r" +", " "))


def address_keys(df: DataFrame, text: str, markers: Sequence[str]) -> DataFrame:
    """One row for each house number of a leading number list (``12, 14 & 16 Elm``), with the street that follows."""
    head = F.get(F.split(F.regexp_replace(F.col(text), r"\([^)]*\)", " "), rf"(?i)\b({'|'.join(markers)})\b", 2), 0)
    found = F.regexp_extract(head, r"(\d+(?:\s*(?:,|&|and)\s*\d+)*)\s+([A-Za-z][A-Za-z .]*)", 1)
    street = F.regexp_extract(head, r"(\d+(?:\s*(?:,|&|and)\s*\d+)*)\s+([A-Za-z][A-Za-z .]*)", 2)
    return df.withColumns({"street": F.trim(F.regexp_replace(street, " +", " ")), "_n": F.regexp_extract_all(found, F.lit(r"(\d+)"), 1)}).withColumn("number", F.explode("_n")).drop("_n")


def evidence(text: Column, include: str, exclude: str | None = None, context: str | None = None, window: int | None = None) -> Column:
    """Include-pattern found, exclude-pattern not, context-pattern found, whatever the case; missing text gives false."""
    seen = F.substring(text, 1, window) if window else text
    out = seen.rlike(f"(?i){include}")
    if exclude:
        out = out & ~seen.rlike(f"(?i){exclude}")
    if context:
        out = out & seen.rlike(f"(?i){context}")
    return F.coalesce(out, F.lit(False))


def name_variant(patterns: Sequence[str], *columns: Column) -> Column:
    """Some column, white space collapsed, begins with one of the patterns."""
    out = F.lit(False)
    for c in columns:
        plain = F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))
        out = out | F.coalesce(plain.rlike("^(" + "|".join(patterns) + ")"), F.lit(False))
    return out


def keyword_class(text: Column, protected: Sequence[str], disposable: Sequence[str]) -> Column:
    """``protected`` wins over ``disposable``; else ``private``."""
    has = lambda words: F.coalesce(text.rlike("(?i)" + "|".join(words)), F.lit(False))
    return F.when(has(protected), "protected").when(has(disposable), "disposable").otherwise("private")


#: What a token is, by kind; the first that fits counts.
TOKENS = {"citation": r"§+\s*\d+(?:[-.]\d+)*", "word": "[A-Za-zÀ-ÖØ-öø-ÿ]+", "number": r"\d+(?:[.,]\d+)*", "punctuation": "[.,;:!?()]", "symbol": r"[^\sA-Za-zÀ-ÖØ-öø-ÿ\d.,;:!?()]"}
TOKEN = f"({'|'.join(TOKENS.values())})"


def token_counts(df: DataFrame, key: str, text: str, kinds: Sequence[str]) -> DataFrame:
    """How many tokens of each kind a text has; texts without a token have no row.  Counted within the row: nothing is exploded."""
    pattern = "(?s)" + "|".join(f"({p})" for p in TOKENS.values())
    number = lambda kind: F.size(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1 + list(TOKENS).index(kind))), lambda t: t != "")).cast("long")
    return df.filter(F.col(text).rlike(r"\S")).select(key, *(number(k).alias(k) for k in kinds))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """Tokens in order: kind is citation, word, number, punctuation or symbol; ``start`` and ``end`` are byte offsets."""
    parts = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)(\s*)" + TOKEN), 0)).alias("pos", "_raw"))
    first = F.substring("token", 1, 1)  # tells the kind; no pattern is searched for in each token
    kind = F.when(first.isin(*".,;:!?()"), "punctuation").when(first == "§", "citation").when(first.between("0", "9"), "number").when(first.rlike("^[A-Za-zÀ-ÖØ-öø-ÿ]"), "word").otherwise("symbol")
    upto = F.sum(F.octet_length("_raw")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("token", F.ltrim("_raw", F.lit(" \t\n\x0b\f\r"))).withColumns({"kind": kind, "end": upto}).withColumn("start", F.col("end") - F.octet_length("token")).drop("_raw")


def proper_name_runs(token_rows: DataFrame, key: str) -> DataFrame:
    """Maximal runs of two or more neighbouring capitalised words."""
    capital = token_rows.filter((F.col("kind") == "word") & F.col("token").rlike("^[A-ZÀ-ÖØ-Þ]"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    runs = capital.withColumn("_i", island).groupBy(key, "_i").agg(F.min("pos").alias("pos"), F.count("*").alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " ").alias("name"))
    return runs.filter("words >= 2").drop("_i")


def neighbourhood(token_rows: DataFrame, key: str, words: Sequence[str], reach: int = 2) -> DataFrame:
    """Numbers with the tokens around them, where one of these is a temporal word; ``unit`` is the next token."""
    order = Window.partitionBy(key).orderBy("pos")
    beside = {f"_t{i}": F.lag("token", -i).over(order) for i in range(-reach, reach + 1)}  # no list is built for other tokens
    near = token_rows.withColumns({**beside, "unit": F.lead("token").over(order)}).filter("kind = 'number'")
    near = near.withColumn("around", F.array_compact(F.array(*map(F.lower, beside)))).select(*token_rows.columns, "around", "unit")
    return near.filter(F.arrays_overlap("around", F.array(*map(F.lit, words))))


def phrases_around(token_rows: DataFrame, key: str, modals: Sequence[str]) -> DataFrame:
    """For each modal word its sentence number, and the words before (from the last comma) and after within the sentence."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_word, ends = F.col("kind") != "punctuation", F.col("token").isin(".", "!", "?")
    upto = lambda of: F.coalesce(of.over(before), F.lit(0))
    marked = token_rows.withColumns({"sentence": upto(F.sum(ends.cast("int"))), "_w": upto(F.sum(is_word.cast("int"))).cast("int")})
    # words before the sentence, and before its last comma so far
    counted = marked.withColumns({"_s": upto(F.max(F.when(ends, F.col("_w")))), "_c": upto(F.max(F.when(F.col("token") == ",", F.col("_w"))))})
    counted = counted.withColumns({"_i": F.col("_w") - F.col("_s"), "_c": F.greatest("_c", "_s") - F.col("_s")})
    is_modal = F.lower("token").isin(*modals)
    counted = counted.withColumn("_m", F.max(is_modal).over(Window.partitionBy(key, "sentence"))).filter("_m")
    # one array of words for each sentence with a modal, and its modals with their places; each phrase is a slice of the words
    words, modal = F.when(is_word, F.struct("pos", "token")), F.when(is_modal, F.struct("pos", F.col("token").alias("modal"), "_i", "_c"))
    whole = counted.groupBy(key, "sentence").agg(F.sort_array(F.collect_list(words)).alias("_words"), F.collect_list(modal).alias("_modals"))
    cut = whole.select(key, "sentence", F.transform("_words", lambda t: t["token"]).alias("_words"), F.explode("_modals").alias("m"))
    text = lambda first, n: F.array_join(F.slice("_words", first + 1, n), " ")
    subject, predicate = text(F.col("m._c"), F.col("m._i") - F.col("m._c")), text(F.col("m._i") + 1, F.greatest(F.size("_words") - F.col("m._i") - 1, F.lit(0)))
    return cut.select(key, "m.pos", "sentence", "m.modal", subject.alias("subject"), predicate.alias("predicate"))


def citations(df: DataFrame, key: str, text: str, pattern: str, sections: DataFrame, section_key: str, reserved: tuple[int, int] | None = None) -> DataFrame:
    """Edges from documents to the sections they cite, with the state of each: internal, reserved, external or missing."""
    edges = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("cited")).groupBy(key, "cited").agg(F.count("*").alias("times"))
    known = sections.select(F.col(section_key).cast("string").alias("cited"), F.lit(True).alias("_known")).distinct()
    joined = edges.join(known, "cited", "left")
    number = F.col("cited").try_cast("bigint")
    inside = F.lit(False) if reserved is None else F.coalesce(number.between(*reserved), F.lit(False))
    state = F.when(F.col("_known"), "internal").when(inside, "reserved").when(number.isNull(), "external").otherwise("missing")
    return joined.withColumn("state", state).drop("_known")


def rule_effects(df: DataFrame, key: str, text: str, rules: dict[str, str]) -> DataFrame:
    """One row for each rule (name: pattern) that a text matches; a text may match several."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)), n) for n, p in rules.items())))
    return df.select(key, F.explode(found).alias("effect"))


def _bytes_at(text: str, start: Column, end: Column) -> Column:
    """The bytes from start to end, if they are some and whole characters of the text; else null."""
    piece = F.substr(F.col(text).cast("binary"), (start + 1).cast("int"), (end - start).cast("int"))
    there = (end > start) & (start >= 0) & (end <= F.octet_length(text))
    return F.when(there & F.is_valid_utf8(piece.cast("string")), piece)


def span_citation(df: DataFrame, text: str, start: Column, end: Column) -> DataFrame:
    """Quote digest of a byte range; a range that is empty, outlying or cuts a character is invalid and has none."""
    quote = _bytes_at(text, start, end)
    return df.withColumns({"valid": quote.isNotNull(), "quote_sha256": F.sha2(quote, 256)})


def span_state(text: str, start: Column, end: Column, quote_sha256: Column) -> Column:
    """``verified`` if the cited range still reads the same, ``changed`` if it reads otherwise, ``occluded`` if it is
    there no more, ``invalid`` if there is no citation (null digest)."""
    now = F.sha2(_bytes_at(text, start, end), 256)
    return F.when(quote_sha256.isNull(), "invalid").when(now.isNull(), "occluded").when(now == quote_sha256, "verified").otherwise("changed")


def decode_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str], codes: dict[str, str]) -> DataFrame:
    """A wide use matrix as long rows; codes are decoded, a blank is ``not allowed``, other text stays for review."""
    long = df.select(*(F.trim(F.regexp_replace(k, r"\s*\(cont'd\)", "")).alias(k) for k in keys), *columns).filter(F.col(keys[-1]) != keys[-1]).unpivot(list(keys), list(columns), "district", "code")
    code = F.trim(F.coalesce("code", F.lit("")))
    decoded = F.when(code == "", "not allowed")
    for short, meaning in codes.items():
        decoded = decoded.when(code == short, meaning)
    return long.withColumn("permission", decoded.otherwise(F.concat(F.lit("review: "), code)))


def cell_kind(cell: Column) -> Column:
    """Kind of a dimensional cell, first match wins."""
    plain = F.trim(cell)
    return (
        F.when(plain.isNull() | (plain == ""), "blank").when(plain.rlike(r"(?i)^(none|no minimum)$"), "no minimum").when(plain.rlike(r"(?i)^(n/?a|not applicable)$"), "inapplicable")
        .when(plain.rlike(r"(?i)\b(see|sec(tion)?\.?)\s"), "cross reference").when(plain.rlike(r"(?i)formula"), "formula").when(plain.rlike(r"^[\d.,]+[^\d/;]*(/|;| or )\s*[\d.,]+"), "compound")
        .when(plain.rlike(r"^\d+(\.\d+)?\s*:\s*\d+"), "ratio").when(plain.rlike(r"^[\d.,]+\s*(%|ft|feet|sq\.? ?ft)?\.?$"), "number").otherwise("text")
    )


def dimensional_rules(df: DataFrame, cell: str) -> DataFrame:
    """One row for each rule of a cell: ``rule``, ``amount``; cells of other kinds keep one row without an amount.

    A number is one rule, ``single``; a compound cell gives two, ``individual`` and ``combined`` where it says the
    second is combined, else ``first`` and ``second``.
    """
    plain = F.trim(F.col(cell))
    amounts = F.transform(F.regexp_extract_all(plain, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), lambda v: F.regexp_replace(v, ",", "").cast("double"))
    rule = lambda name, i: F.struct(F.lit(name).alias("rule"), F.get(amounts, F.lit(i)).alias("amount"))
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("double").alias("amount"))
    kind = cell_kind(F.col(cell))
    pair = F.when(F.lower(plain).contains("combined"), F.array(rule("individual", 0), rule("combined", 1))).otherwise(F.array(rule("first", 0), rule("second", 1)))
    rules = F.when(kind == "compound", pair).when(kind == "number", F.array(rule("single", 0))).otherwise(F.array(none))
    return df.withColumn("kind", kind).select("*", F.explode(rules).alias("_r")).select(*df.columns, "kind", "_r.rule", "_r.amount")


def date_in_name(name: Column) -> Column:
    """Date in a file name: year first, then month first, then undelimited forms; seven digits are tried both ways."""
    at = lambda pattern, form: F.try_to_date(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), form)
    seven = F.regexp_extract(name, r"(?<!\d)(\d{7})(?!\d)", 1)
    return F.coalesce(
        at(r"(?<!\d)(\d{4}-\d{1,2}-\d{1,2})(?!\d)", "y-M-d"), at(r"(?<!\d)(\d{1,2}-\d{1,2}-\d{4})(?!\d)", "M-d-y"), at(r"(?<!\d)(\d{1,2}_\d{1,2}_\d{4})(?!\d)", "M_d_y"), at(r"(?<!\d)(\d{8})(?!\d)", "MMddyyyy"),
        F.try_to_date(F.nullif(F.concat(F.lit("0"), seven), F.lit("0")), "MMddyyyy"), F.try_to_date(F.when(seven != "", F.concat(F.substring(seven, 1, 2), F.lit("0"), F.substring(seven, 3, 5))), "MMddyyyy"),
    )


def latest_heading(df: DataFrame, partition: str, order: Sequence[str], is_heading: Column, heading: str, name: str = "heading") -> DataFrame:
    """Each row with the latest heading at or before it; null before the first."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(is_heading, F.col(heading)), ignorenulls=True).over(w))


def section_path(df: DataFrame, partition: str, order: Sequence[str], level: str, heading: str, levels: int = 3) -> DataFrame:
    """Path of headings (level 1 is the outermost) over each row; a new heading resets all deeper levels."""
    whole = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_s0", F.lit(0))
    parts = []
    for depth in range(1, levels + 1):
        groups = [f"_s{i}" for i in range(depth)]
        inner = Window.partitionBy(partition, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_h{depth}", F.last(F.when(F.col(level) == depth, F.col(heading)), ignorenulls=True).over(inner))
        out = out.withColumn(f"_s{depth}", F.sum((F.col(level) == depth).cast("int")).over(whole))
        parts.append(f"_h{depth}")
    return out.withColumn("path", F.concat_ws("/", *parts)).drop(*parts, *(f"_s{i}" for i in range(levels + 1)))


def sections(df: DataFrame, partition: str, order: Sequence[str], level: str, heading: str) -> DataFrame:
    """The headings among a document's blocks (rows with a level), each with ``path``, ``depth`` and ``below``.

    A heading belongs to the last one before it of a lower level; levels may be skipped.  ``below`` counts the blocks that
    a depth-first walk meets under it.  Paths of any depth are put together by pointer jumping.  The distinct levels are
    few (a window column each); documents are the values of ``partition``.
    """
    levels = [r[0] for r in df.filter(F.col(level).isNotNull()).select(level).distinct().orderBy(level).collect()]
    before = Window.partitionBy(partition).orderBy(*order)
    after = Window.partitionBy(partition).orderBy(F.desc("_pos"))
    placed = df.withColumn("_pos", F.row_number().over(before)).withColumn("_left", F.row_number().over(after) - 1)
    pick = lambda f: F.coalesce(*(F.when(F.col(level) == v, f(v)) for v in levels)) if levels else F.lit(None).cast("int")
    up = pick(lambda v: F.last(F.when(F.col(level) < v, F.col("_pos")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    end = pick(lambda v: F.last(F.when(F.col(level) <= v, F.col("_pos")), ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, -1)))
    heads = placed.withColumns({"_up": up, "_end": end}).filter(F.col(level).isNotNull())
    heads = heads.withColumns({"below": (F.coalesce(F.col("_end") - 1, F.col("_pos") + F.col("_left")) - F.col("_pos")).cast("long"), "path": F.col(heading).cast("string"), "depth": F.lit(1)}).drop("_end", "_left")
    heads = cut_lineage(heads, "headings")
    while not heads.filter("_up IS NOT NULL").isEmpty():
        above = heads.select(F.col(partition).alias("_p"), F.col("_pos").alias("_at"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("_up").alias("_further"))
        met = heads.join(above, F.col(partition).eqNullSafe(F.col("_p")) & (F.col("_up") == F.col("_at")), "left")
        known = F.col("_at").isNotNull()
        met = met.withColumns({"path": F.when(known, F.concat_ws("/", "_path", "path")).otherwise(F.col("path")), "depth": F.col("depth") + F.coalesce("_depth", F.lit(0)), "_up": F.col("_further")})
        heads = cut_lineage(met.drop("_p", "_at", "_path", "_depth", "_further"), "headings")
    return heads.drop("_up", "_pos")


def nested_relations(df: DataFrame, key: str, lists: Sequence[str]) -> DataFrame:
    """The different relations in nested lists of entries (structs with ``relation``), sorted, for each key that has any."""
    found = df.select(key, F.explode(F.concat(*lists)).alias("_e")).select(key, F.col("_e.relation").alias("relation")).distinct()
    return found.groupBy(key).agg(F.array_sort(F.collect_list("relation")).alias("relations"))  # distinct before, so as many as there are relations


def html_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """Paragraph and table blocks in order, markup kept (well-formed, unnested blocks)."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?s)(<p[ >].*?</p>|<table[ >].*?</table>)"), 1)
    out = df.select(key, F.posexplode(blocks).alias("pos", "block"))
    return out.withColumn("kind", F.when(F.col("block").startswith("<table"), "table").otherwise("paragraph"))


def minutes_cases(df: DataFrame, key: str, text: str) -> DataFrame:
    """Meeting minutes as cases: number, petitioner (or applicant), location, proposal, votes, decision (last found)."""
    blocks = df.select(key, F.posexplode(F.split(text, r"(?m)^(?=CASE NO[.:])")).alias("pos", "block")).filter(F.col("block").rlike("^CASE NO"))
    field = lambda p: F.nullif(F.trim(F.regexp_extract("block", p, 1)), F.lit(""))
    votes = lambda p: F.size(F.filter(F.split(F.coalesce(field(p), F.lit("")), r"\s*,\s*"), lambda v: F.trim(v) != ""))
    decisions = F.regexp_extract_all(F.upper("block"), F.lit(r"\b(GRANTED|DENIED|ADJOURNED|DISMISSED)\b"), 1)
    return blocks.select(
        key, "pos", field(r"^CASE NO[.:]+\s*([^\n]+)").alias("case_number"), F.coalesce(field(r"(?m)^(?:BZA )?PETITIONER:\s*([^\n]+)"), field(r"(?m)^APPLICANT:\s*([^\n]+)")).alias("petitioner"),
        field(r"(?m)^LOCATION:\s*([^\n]+)").alias("location"), field(r"(?m)^PROPOSAL:\s*([^\n]+)").alias("proposal"), votes(r"(?mi)^\s*Affirmative:[ \t]*([^\n]*)").alias("votes_for"), votes(r"(?mi)^\s*Negative:[ \t]*([^\n]*)").alias("votes_against"),
        F.try_element_at(decisions, F.lit(-1)).alias("decision"),
    )


def levy_rows(df: DataFrame, key: str, text: str, city: str, county: str) -> DataFrame:
    """Year of the title page (1994 to 2027) and the city's value: its row at the line start, else the last county-prefixed one."""
    year = F.regexp_extract(text, r"\b(199[4-9]|20[01]\d|202[0-7])\b", 1).try_cast("int")
    number = r"\s+([\d,]+)"
    own = F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?mi)^{city}{number}"), 1), F.lit(1))
    prefixed = F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?mi)^\s*{county}\s+{city}{number}"), 1), F.lit(-1))
    return df.select(key, year.alias("year"), F.regexp_replace(F.coalesce(own, prefixed), ",", "").try_cast("bigint").alias("value"))


def reconcile(parsed: DataFrame, anchors: DataFrame, key: str, value: str) -> DataFrame:
    """First value of each key (by ``_ord``) with its state against verified anchors; a mismatch is an error."""
    first = parsed.groupBy(key).agg(F.min_by(value, "_ord").alias(value), (F.count_distinct(value) > 1).alias("conflict"))
    joined = first.join(anchors.select(key, F.col(value).alias("_anchor")), key, "full")
    wrong = joined.filter(F.col(value) != F.col("_anchor")).select(key).limit(5).collect()
    if wrong:
        raise ValueError(f"parsed values differ from verified ones: {[r[0] for r in wrong]}")
    state = F.when(F.col(value).isNull(), "gap").when(F.col("_anchor").isNull(), "unverified").otherwise("verified")
    return joined.withColumns({"state": state, "conflict": F.coalesce("conflict", F.lit(False))}).drop("_anchor")


#: Bytes of a rule table's literals and expressions that one automaton takes; larger tables take several passes.
RULE_BYTES = 32_000_000
#: Texts of one task.
TEXTS_EACH = 1_000
#: An expression that is one whole word, and the words of a text.
WHOLE_WORD, WORDS = re.compile(r"\\b([A-Za-z0-9_]+)\\b"), re.compile("[A-Za-z0-9_]+")


def rule_hits(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """``key`` and ``rule`` of each text that a rule's expression matches; rules have ``rule``, ``literal``, ``expression``.

    A literal is a string that every match holds (null where there is none).  Expressions that are their literal as a
    whole word are looked up among the words of a text.  All other literals form one automaton, which reads each text
    once however many rules there are; their expressions (in the syntax that Java and Python share, letters and word
    edges as in ASCII) are tried only where their literal occurs, or on every text without one.  An expression that is
    null means the literal itself.  Null texts match nothing; equal rows stay rows of their own.  Texts are dealt to
    tasks by their number, as a small file of them is much work.
    """
    size = rules.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("literal"), F.lit(0)) + F.coalesce(F.octet_length("expression"), F.lit(0)))).first()
    passes = max(1, -(-(size[1] or 0) // RULE_BYTES))
    numbered = rules.select("rule", "literal", "expression", F.pmod(F.xxhash64("rule"), F.lit(passes)).alias("_pass"))
    source = df.select(key, F.col(text).cast("string").alias("_text")).filter("_text IS NOT NULL")
    schema = StructType([source.schema[key], rules.schema["rule"]])
    kind = to_arrow_type(rules.schema["rule"].dataType)
    texts = df.count()
    source = source.repartition(-(-texts // TEXTS_EACH)) if texts > TEXTS_EACH else source
    out = None
    for i in range(passes):
        table = [tuple(r) for r in numbered.filter(F.col("_pass") == i).select("rule", "literal", "expression").collect()]  # bounded by RULE_BYTES
        found = source.mapInArrow(lambda it, table=table: _matched(it, table, key, kind), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _matched(batches: Iterator[pa.RecordBatch], table: list[tuple], key: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    automaton, by_literal, by_word, always = ahocorasick.Automaton(), {}, {}, []
    for i, (_, literal, expression) in enumerate(table):
        if literal:
            word = expression is not None and WHOLE_WORD.fullmatch(expression)
            (by_word if word and word[1] == literal else by_literal).setdefault(literal, []).append(i)
        elif expression is not None:
            always.append(i)
    for literal, own in by_literal.items():
        automaton.add_word(literal, own)
    if by_literal:
        automaton.make_automaton()
    compiled: dict[int, re.Pattern] = {}
    for batch in batches:
        rows, rules = [], []
        for row, text in enumerate(batch.column("_text").to_pylist()):
            met = [i for word in by_word.keys() & set(WORDS.findall(text)) for i in by_word[word]] if by_word else []
            tried = {i for _, own in automaton.iter(text) for i in own} if by_literal else set()
            for i in tried.union(always):
                expression = table[i][2]
                if expression is not None and i not in compiled:
                    compiled[i] = re.compile(expression, re.ASCII)
                if expression is None or compiled[i].search(text):
                    met.append(i)
            rows.extend([row] * len(met))
            rules.extend(table[i][0] for i in sorted(met))
        yield pa.record_batch([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(rules, kind)], [key, "rule"])
