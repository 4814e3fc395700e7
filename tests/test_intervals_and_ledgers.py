"""Interval joins, ledgers, publication, section trees, rule tables and classes against plain versions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acrework.functions.storage import shared_path
from acrework.operators import aggregates as A
from acrework.operators import text as X
from acrework.operators import windows as W
from acrework.operators.joins import interval_join, interval_totals
from acrework.sources import tables as T


def test_interval_join_equals_nested_loop(spark):
    rng = np.random.default_rng(1)
    values = [(i, v) for i, v in enumerate([*rng.normal(0, 100, 150).round(1).tolist(), 0.0, 0.0, 5.0, None, float("nan"), 1e9])]
    intervals = []
    for j in range(120):
        low, width = float(rng.normal(0, 100).__round__(1)), float(rng.choice([0, 0.1, 1, 30, 500, -3]))
        intervals.append((j, None if j % 17 == 3 else low, None if j % 13 == 5 else low + width, j % 2 == 0 or None, j % 3 == 0))
    points = spark.createDataFrame(values, "id int, v double")
    table = spark.createDataFrame(intervals, "rule int, low double, high double, lo boolean, ho boolean")
    df = interval_join(points, "v", table, low_open="lo", high_open="ho")
    assert re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join \[_level", df._jdf.queryExecution().executedPlan().toString())  # not all pairs

    def holds(v, low, high, lo, ho):
        return v is not None and v == v and (low is None or v > low or v == low and not lo) and (high is None or v < high or v == high and not ho)

    expected = sorted((i, r[0]) for i, v in values for r in intervals if holds(v, *r[1:]))
    assert sorted((r["id"], r["r_rule"]) for r in df.collect()) == expected
    assert interval_join(points, "v", table.limit(0)).count() == 0 and interval_join(points.limit(0), "v", table).count() == 0


def test_interval_totals_equal_counted_pairs(spark):
    """Counts and least numbers without pairs, whatever ends are open, null, equal or inverted."""
    rng = np.random.default_rng(3)
    values = [(v,) for v in [*rng.normal(0, 50, 90).round(0).tolist(), 0.0, -0.0, 5.0, None, float("nan"), 1e9]]
    rows = [(j, None if j % 17 == 3 else low, None if j % 13 == 5 else low + w, j % 2 == 0 or None, j % 3 == 0) for j, (low, w) in enumerate(zip(rng.normal(0, 50, 150).round(0).tolist(), rng.choice([0, 1, 2, 30, 200, -3], 150).tolist()))]
    points = spark.createDataFrame(values, "v double")
    table = spark.createDataFrame(rows, "rule int, low double, high double, lo boolean, ho boolean")
    pairs = interval_join(points.distinct(), "v", table, low_open="lo", high_open="ho").groupBy("v").agg(F.count("*").alias("n"), F.min("r_rule").alias("rule"))
    found = interval_totals(points, "v", table, "rule", low_open="lo", high_open="ho")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect())) != []
    assert interval_totals(points, "v", table.limit(0), "rule").count() == 0 and interval_totals(points.limit(0), "v", table, "rule").count() == 0


def test_ledger_of_batches_equals_ledger_of_all(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), t, str(v)) for t, (k, v) in enumerate(zip(rng.integers(0, 6, 200), rng.choice(list("abc"), 200)))]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    whole = {(r["k"], r["t"], r["version"]) for r in W.version_ledger(df, "k", ["t"], F.sha2("v", 256)).collect()}
    root, schema = shared_path(spark, "ledger-test"), "k int, t int, number long, fingerprint string, version string"
    assert T.latest(spark, root) == [] and T.read_latest(spark, root, schema).count() == 0
    for low, high in ((0, 70), (70, 71), (71, 71), (71, 200)):
        added = W.ledger_additions(T.read_latest(spark, root, schema), df.filter((F.col("t") >= low) & (F.col("t") < high)), "k", ["t"], F.sha2("v", 256))
        T.append_published(added.select("k", "t", "number", "fingerprint", "version"), root)
    assert {(r["k"], r["t"], r["version"]) for r in T.read_latest(spark, root, schema).collect()} == whole


def test_pointer_moves_only_after_a_verified_write(spark):
    root = shared_path(spark, "published-test")
    old = T.publish_latest(spark.range(5), root)
    with pytest.raises(Exception, match="no such row"):
        T.publish_latest(spark.range(6).select(F.when(F.col("id") < 5, F.col("id")).otherwise(F.raise_error(F.lit("no such row")).cast("long")).alias("id")), root)
    assert T.latest(spark, root) == [old] and T.read_latest(spark, root, "id long").count() == 5
    new = T.publish(spark.range(7), root)  # written, but its writer ended before the pointer moved
    assert T.latest(spark, root) == [old]
    spark.range(8).write.mode("overwrite").parquet(f"{root}/{new}")
    with pytest.raises(ValueError, match="other contents"):
        T.publish_latest(spark.range(7), root)
    assert T.latest(spark, root) == [old]
    assert T.publish_latest(spark.range(9), root) == T.latest(spark, root)[0] != old


def test_sections_of_any_depth(spark):
    rng = np.random.default_rng(3)
    rows = [(d, i, int(v) if v else None, f"{d}.{i}") for d in ("a", "b") for i, v in enumerate(rng.choice([0, 0, 1, 2, 3, 5, 9], 120))]
    rows += [("deep", i, i + 1, str(i)) for i in range(12)] + [(None, 0, 2, "x"), (None, 1, None, "y"), ("plain", 0, None, "z")]
    expected = {}
    for d in {r[0] for r in rows}:
        own, stack = sorted(r for r in rows if r[0] == d), []
        for at, (_, i, level, head) in enumerate(own):
            if level is None:
                continue
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, head))
            end = next((k for k in range(at + 1, len(own)) if own[k][2] is not None and own[k][2] <= level), len(own))
            expected[d, i] = ("/".join(h for _, h in stack), len(stack), end - at - 1)
    df = spark.createDataFrame(rows, "doc string, i int, level int, head string")
    found = X.sections(df, "doc", ["i"], "level", "head")
    assert {(r["doc"], r["i"]): (r["path"], r["depth"], r["below"]) for r in found.collect()} == expected
    assert X.sections(df.filter("level IS NULL"), "doc", ["i"], "level", "head").count() == 0


def test_rule_table_equals_each_rule(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choice(words, 40))) for i in range(30)] + [(99, None), (100, ""), (101, "w1")]
    rules = [(i, f"w{i}", rf"\bw{i}\b") for i in range(200)] + [(500, "w1", None), (501, None, r"w2\d+ w1"), (502, None, None), (503, "w9", r"w9\d* w\d*5\b")]
    expected = sorted((k, r) for k, t in texts if t is not None for r, lit, e in rules if (e is not None or lit is not None) and re.search(e if e is not None else re.escape(lit), t))
    df, table = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(rules, "rule int, literal string, expression string")
    assert sorted(tuple(r) for r in X.rule_hits(df, "k", "t", table).collect()) == expected
    monkeypatch.setattr(X, "RULE_BYTES", 1000)  # several passes
    assert sorted(tuple(r) for r in X.rule_hits(df, "k", "t", table).collect()) == expected
    assert X.rule_hits(df, "k", "t", table.limit(0)).count() == 0


def test_classes_and_bins(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 1, 2, 9, 7, 7, 3])] + [(90, None)], "i int, v double")
    breaks = A.ordered_breaks(df, "v", 4)
    found = {r["i"]: r["class"] for r in A.assign_classes(df, "v", breaks).collect()}
    ordered = sorted([5, 1, 1, 2, 9, 7, 7, 3])
    limits = [ordered[8 * i // 4] for i in (1, 2, 3)]
    assert found == {i: sum(b < v for b in limits) for i, v in enumerate([5, 1, 1, 2, 9, 7, 7, 3])} | {90: None}
    assert {r["i"]: r["bin"] for r in A.equal_width_bins(df, "v", 4).collect()} == {0: 2, 1: 0, 2: 0, 3: 0, 4: 3, 5: 3, 6: 3, 7: 1}
    assert A.equal_width_bins(df.filter("v = 7"), "v", 4).count() == 0


def test_phrases_are_slices_of_one_array_of_words(spark):
    """No array is filtered anew for each modal of a sentence (F2)."""
    rows = X.tokens(spark.createDataFrame([(1, "It is, so they say, that was 1.5 % off. Then it is! IS was? no"), (2, "is"), (3, None), (4, "a , b")], "doc_id int, text string"), "doc_id", "text")
    found = X.phrases_around(rows, "doc_id", ["is", "was"])
    assert sorted(tuple(r)[1:] for r in found.filter("doc_id = 1").collect()) == [
        (1, 0, "is", "It", "so they say that was 1.5 % off"),
        (8, 0, "was", "that", "1.5 % off"),
        (15, 1, "is", "Then it", ""),
        (17, 2, "IS", "", "was"),
        (18, 2, "was", "IS", ""),
    ]
    assert [tuple(r) for r in found.filter("doc_id > 1").collect()] == [(2, 0, 0, "is", "", "")]
    assert "filter(" not in found._jdf.queryExecution().analyzed().toString()


def test_whole_words_are_looked_up_and_texts_dealt_by_number(spark, monkeypatch):
    """No search through the text for each rule that it may meet, and no task of all texts of a small file."""
    texts = [(0, "über wort_1 wort"), (1, "wortes Wort,wort-x"), (2, "éwort wortß"), (3, "wort1"), (4, None), (5, "wort"), (6, "a.c wort\nwort")] + [(i, "x") for i in range(7, 40)]
    rules = [(0, "wort", r"\bwort\b"), (1, "wort_1", r"\bwort_1\b"), (2, "wort", None), (3, "ort", r"\bwort\b"), (4, "a.c", r"\ba.c\b"), (5, "ber", r"\bber\b"), (6, "wort", r"\bwort\b")]
    expected = sorted((k, r) for k, t in texts if t is not None for r, lit, e in rules if re.search(e if e is not None else re.escape(lit), t, re.ASCII))
    rows = spark.createDataFrame(texts, "k int, t string").coalesce(1)
    monkeypatch.setattr(X, "TEXTS_EACH", 10)
    found = X.rule_hits(rows, "k", "t", spark.createDataFrame(rules, "rule int, literal string, expression string"))
    assert sorted(tuple(r) for r in found.collect()) == expected and (2, 0) in expected
    assert found.rdd.getNumPartitions() == 4
    words = pa.RecordBatch.from_pydict({"k": [1], "_text": ["wort and more " * 9]})
    monkeypatch.setattr(X.re, "compile", lambda *_: pytest.fail("a whole word is no search"))
    (batch,) = X._matched([words], [("r", "wort", r"\bwort\b")], "k", pa.string())
    assert batch.to_pydict() == {"k": [1], "rule": ["r"]}
