"""Deduplication, ranking, concentration, ledgers, funnels, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrework.operators.aggregates import prefix_sums


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = (), keep: str = "first") -> DataFrame:
    """One row for each key: ``first`` in the order, or ``unique`` (only keys with a single row)."""
    if keep == "unique":
        return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def concentration(df: DataFrame, amount: str, base: str, tie: str) -> DataFrame:
    """Running shares of base and amount, from the highest amount per base down, over the whole table in two passes."""
    rated = df.filter((F.col(base) > 0) & F.col(amount).isNotNull()).select(tie, amount, base, (F.col(amount) / F.col(base)).alias("rate"))
    order = [F.desc("rate"), F.asc(tie)]
    both = prefix_sums(rated, order, [amount, base], ["_a", "_b"])
    totals = rated.agg(F.sum(amount).alias("_ta"), F.sum(base).alias("_tb"))
    return both.crossJoin(totals).withColumns({"base_share": F.col("_b") / F.col("_tb"), "amount_share": F.col("_a") / F.col("_ta")}).drop("_a", "_b", "_ta", "_tb")


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Descending rank of each value, ties averaged; ranks come from the counts of values, not from a sort of all rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    ranked = prefix_sums(counts, [F.desc(value)], "_c", "_upto").select(value, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranked, value)


def index_to_peak(df: DataFrame, series: str, value: str) -> DataFrame:
    """Values of each series with its own peak as 100."""
    return df.withColumn("index", 100 * F.col(value) / F.max(value).over(Window.partitionBy(series)))


def version_ledger(df: DataFrame, key: str, order: Sequence[str], fingerprint: Column) -> DataFrame:
    """Rows at which the fingerprint of a key changes, numbered v1, v2, ..."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_fp", fingerprint).withColumn("_new", F.coalesce(F.col("_fp") != F.lag("_fp").over(w), F.lit(True)))
    return marked.filter("_new").withColumn("version", F.concat(F.lit("v"), F.row_number().over(w).cast("string"))).drop("_fp", "_new")


def ledger_additions(ledger: DataFrame, batch: DataFrame, key: str, order: Sequence[str], fingerprint: Column) -> DataFrame:
    """The versions that a batch adds to a ledger: its rows at which a key's fingerprint differs from the one before.

    Rows of a batch count as later than the ledger's.  Only the last version of keys in the batch is read from the ledger
    (columns of the key, ``number`` and ``fingerprint``); the rows returned are to be appended, with both columns and
    ``version``.  Nothing already in the ledger changes.
    """
    last = ledger.join(batch.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(F.struct("number", "fingerprint")).alias("_last"))
    w = Window.partitionBy(key).orderBy(*order)
    rows = batch.withColumn("fingerprint", fingerprint).join(last, key, "left")
    before = F.coalesce(F.lag("fingerprint").over(w), "_last.fingerprint")
    changed = rows.withColumn("_new", F.coalesce(F.col("fingerprint") != before, F.lit(True))).filter("_new")
    number = F.coalesce(F.col("_last.number"), F.lit(0).cast("long")) + F.row_number().over(w)
    return changed.withColumn("number", number).withColumn("version", F.concat(F.lit("v"), F.col("number").cast("string"))).drop("_last", "_new")


def funnel(df: DataFrame, gates: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each gate in turn, their share of all, and the cut against the gate before; one pass."""
    passed, aggs = F.lit(True), [F.count("*").alias("g0")]
    for i, (_, gate) in enumerate(gates, 1):
        passed = passed & F.coalesce(gate, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"g{i}"))
    names = ["all", *(name for name, _ in gates)]
    steps = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("gate"), F.col(f"g{i}").alias("remaining"), (F.col(f"g{i}") / F.nullif("g0", F.lit(0))).alias("share"), (F.col(f"g{i - 1}") - F.col(f"g{i}") if i else F.lit(0).cast("long")).alias("cut")) for i, n in enumerate(names)]
    return df.agg(*aggs).select(F.inline(F.array(*steps)))


def impute_group_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Missing values take the median of their group's measured ones; ``source`` tells which.  Groups may have any size."""
    from acrework.operators.aggregates import exact_quantiles

    medians = exact_quantiles(df, keys, value, [0.5]).select(*keys, F.get("quantiles", 0).alias("_m"))
    filled = df.join(medians, list(keys), "left")
    source = F.when(F.col(value).isNotNull(), "measured").when(F.col("_m").isNotNull(), "group median").otherwise("missing")
    return filled.withColumns({"source": source, value: F.coalesce(value, "_m")}).drop("_m")


def first_recorded(cases: DataFrame, listed: DataFrame, key: str, listing: str, category: str, rank: dict[str, int], parents: dict[str, str] | None = None) -> DataFrame:
    """The first category of a pipe-joined list that the case really has, else its best-ranked one, else unspecified."""
    own = listed.select(key, category).distinct()
    order = cases.select(key, F.posexplode(F.split(listing, r"\|")).alias("_pos", category))
    first = order.join(own, [key, category]).groupBy(key).agg(F.min_by(category, "_pos").alias("_first"))
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    best = own.groupBy(key).agg(F.min_by(category, F.coalesce(F.try_element_at(ranks, F.col(category)), F.lit(1 << 30))).alias("_best"))
    out = cases.join(first, key, "left").join(best, key, "left").withColumn("primary", F.coalesce("_first", "_best", F.lit("unspecified"))).drop("_first", "_best")
    if parents:
        up = F.create_map(*[F.lit(x) for pair in parents.items() for x in pair])
        out = out.withColumn("parent", F.coalesce(F.try_element_at(up, F.col("primary")), F.col("primary")))
    return out


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Exactly n rows (all, if fewer), the same for any partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)
