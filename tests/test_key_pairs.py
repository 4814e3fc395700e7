"""Pairs of the keys of equal shapes: every one, once, whatever the lists they travel in; dealt to tasks by their number."""

from collections import Counter

from pyspark.sql import functions as F

from acrework.operators import geometry as G
from acrework.plans import QUERIES


def test_every_pair_of_keys_once(spark, monkeypatch):
    """Shapes of one key and of many, lists and runs that end early, and shapes that meet none."""
    for name, most in (("LEFT_EACH", 3), ("RIGHT_EACH", 5), ("RUN", 2), ("KEYS_EACH", 7)):
        monkeypatch.setattr(G, name, most)
    sizes, r_sizes, pairs = {1: 1, 2: 20, 3: 4, 4: 2}, {1: 13, 5: 1, 6: 3, 7: 2}, [(1, 1, 0.5), (2, 1, 0.25), (2, 5, 1.0), (3, 6, 2.0)]
    lefts = [(100 * s + i, s, n) for s, n in sizes.items() for i in range(n)]
    rights = [(100 * s + i, s, n) for s, n in r_sizes.items() for i in range(n)]
    frames = [spark.createDataFrame(rows, f"{p}k long, {p}shape long, {p}n long") for rows, p in ((lefts, ""), (rights, "r_"))]
    met = spark.createDataFrame(pairs, "shape long, r_shape long, overlap double")
    got = G.key_pairs(met, *frames, "k", "shape", "n").select("k", "r_k", "overlap").collect()
    expected = [(k, r, o) for s, t, o in pairs for k, s2, _ in lefts if s2 == s for r, t2, _ in rights if t2 == t]
    assert Counter(map(tuple, got)) == Counter(expected)
    assert G.key_pairs(met.limit(0), *frames, "k", "shape", "n").count() == 0


def test_overlaps_of_two_shapes_are_many_tasks(spark, tmp_path, monkeypatch):
    """A million overlaps of only two shapes are dealt by their number, with the right values and each once (F1)."""
    monkeypatch.setattr(G, "KEYS_EACH", 100_000, raising=False)
    monkeypatch.setattr(G, "LEFT_EACH", 64, raising=False)
    spark.range(1000).select(F.explode(F.array(F.col("id") * 1000 + 738, F.col("id") * 1000 + 35)).alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    every = QUERIES["j09_overlap_join"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    tasks = every.groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("k", "r_k").alias("pairs"), F.collect_set(F.struct("overlap", "share")).alias("as")).collect()
    assert sum(t["n"] for t in tasks) == sum(t["pairs"] for t in tasks) == 1_000_000 and max(t["n"] for t in tasks) < 500_000
    assert {tuple(v) for t in tasks for v in t["as"]} == {(770.0, 0.3207)}


def test_files_of_overlaps_hold_runs_and_repeats(spark, tmp_path):
    """Four million overlaps of only two shapes: the rows are many, and so their order counts (F1)."""
    spark.range(2001).select(F.explode(F.array(F.col("id") * 1000 + 738, F.col("id") * 1000 + 35)).alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    QUERIES["j09_overlap_join"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out", compression="snappy")
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.2 * 2001 * 2001, size
