"""Joins: lookups, fallbacks, bands, similarity.

Small reference tables are left to Spark's own size check (``autoBroadcastJoinThreshold`` and adaptive execution);
nothing here forces a broadcast of data that grows with the input, but for groups of more than a million rows (``join_groups``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrework.functions.storage import cut_lineage

from acrework.operators.audits import assert_single_value, assert_unique


#: Rows of one task where joins are dealt by the number of their rows, rows from which they are, and rows of a group from which it is joined by broadcast.
ROWS_EACH, DEALT_FROM, MANY = 500_000, 6_000_000, 1_000_000


def dealt_by(keys: Sequence[str], *sides: DataFrame, rows: int | None = None) -> list[DataFrame]:
    """The sides of a join, dealt by its keys to as many tasks as their rows need.

    Spark would fill a task with 64 MB of compressed keys, which may be tens of millions of rows to sort; few rows are left
    to it.  ``rows`` is the number of rows of all sides; they are counted without it, which costs little for stored tables.
    """
    rows = sum(df.count() for df in sides) if rows is None else rows
    return [df.repartition(-(-rows // ROWS_EACH), *keys) for df in sides] if rows > DEALT_FROM else list(sides)


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], n: str, rows: int, many: int = MANY) -> DataFrame:
    """Inner join of ``rows`` rows with one stored row for each group of them; ``n`` counts its rows in ``df`` (or more) and is dropped.

    Rows of the few groups that are too large for one task never meet in one: such groups are broadcast, one for each
    ``many`` of the counted rows at most.  The rest is dealt by the number of rows.
    """
    keys, large = list(keys), F.col(n) > many
    few, hot, rest = groups.drop(n), None, df
    if 2 * rows > many and not groups.filter(large).isEmpty():
        few, hot = groups.filter(~large).drop(n), F.broadcast(groups.filter(large).drop(n))
        rest = df.join(hot, keys, "left_anti")
    a, b = dealt_by(keys, rest, few, rows=rows)
    joined = a.join(b.hint("merge"), keys)
    return joined if hot is None else df.join(hot, keys).unionByName(joined)


def lookup_join(df: DataFrame, reference: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """Left join of one value; missing keys get the default."""
    return df.join(reference.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that refuses repeated keys on either side."""
    return assert_unique(left, key).join(assert_unique(right, key), key)


def fallback_join(left: DataFrame, right: DataFrame, exact: Sequence[str], loose: Sequence[str], value: str) -> DataFrame:
    """Left join on the exact keys; rows without a match try looser keys that only one right row has.

    Adds ``value`` and ``matched`` (exact, loose, none).  Null keys match nothing.
    """
    first = right.groupBy(*exact).agg(F.min(value).alias("_exact"))
    single = right.groupBy(*loose).agg(F.count("*").alias("_n"), F.min(value).alias("_loose")).filter("_n = 1").drop("_n")
    joined = left.join(first, list(exact), "left").join(single, list(loose), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "loose").otherwise("none")
    return joined.withColumns({value: F.coalesce("_exact", "_loose"), "matched": how}).drop("_exact", "_loose")


def band_join(df: DataFrame, value: Column, bands: DataFrame) -> DataFrame:
    """Each row with its (lower, upper] band; an open end is null.  Bands are a handful of rows with lower, upper, label."""
    inside = (F.col("lower").isNull() | (value > F.col("lower"))) & (F.col("upper").isNull() | (value <= F.col("upper")))
    return df.join(bands, inside, "left")


def on_domain(domain: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Every member of a fixed domain with its totals, missing ones as zero."""
    joined = domain.join(totals, key, "left")
    return joined.fillna(0, [c for c in totals.columns if c != key])


def matching_tier(score: Column) -> Column:
    """Confidence of a similarity match."""
    return F.when(score >= 0.75, "high").when(score >= 0.60, "medium").otherwise("low")


def similarity_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str, k: int) -> DataFrame:
    """The k right rows of largest cosine for each left row (see ``nearest_by_cosine``), with tier and auto_accept."""
    from acrework.operators.similarity import nearest_by_cosine

    ranked = nearest_by_cosine(left, right, left_id, right_id, vector, k)
    return ranked.withColumns({"tier": matching_tier(F.col("score")), "auto_accept": F.col("score") >= 0.75})


def cohort(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each key in both vintages with finite positive values; a key with two values in a vintage is an error."""
    sides = []
    for df, name in ((old, "before"), (new, "after")):
        clean = assert_single_value(df.filter(F.col(key).isNotNull()), key, value).groupBy(key).agg(F.first(value).alias(name))
        sides.append(clean.filter((F.col(name) > 0) & (F.col(name) < float("inf"))))
    return sides[0].join(sides[1], key)


#: Least width of an interval's level, as a power of two; narrower ones share it.
LEAST_LEVEL = -30


def interval_join(df: DataFrame, value: str, intervals: DataFrame, low: str = "low", high: str = "high", low_open: str | None = None, high_open: str | None = None) -> DataFrame:
    """Inner join of each row with all intervals that hold its value, by equality of level and bin.

    An interval lies on the level of the power of two from its width up, where it meets two bins or one; a value meets one
    bin of each level in use (a few dozen at most).  So neither side is compared with all of the other.  An end that is
    null is open-ended (such intervals reach to the data's ends); ends count as inside unless a flag column (``low_open``,
    ``high_open``) is true.  Values that are null or NaN, and intervals that hold nothing, meet nothing.  Interval columns
    get the prefix ``r_``.
    """
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ends = known.agg(F.min(value).cast("double").alias("_min"), F.max(value).cast("double").alias("_max"))  # one row
    a, b = F.coalesce(F.greatest(F.col(low).cast("double"), "_min"), "_min"), F.coalesce(F.least(F.col(high).cast("double"), "_max"), "_max")
    placed = intervals.crossJoin(ends).withColumns({"_a": a, "_b": b}).filter("_a <= _b")
    level = F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))))).cast("int")
    placed = placed.withColumn("_level", F.coalesce(level, F.lit(LEAST_LEVEL)))
    bin_ = lambda at: F.floor(at / F.pow(F.lit(2.0), F.col("_level")))
    right = placed.withColumn("_bin", F.explode(F.sequence(bin_(F.col("_a")), bin_(F.col("_b"))))).select("_level", "_bin", *(F.col(c).alias(f"r_{c}") for c in intervals.columns))
    levels = [r[0] for r in placed.select("_level").distinct().collect()]
    left = known.withColumn("_level", F.explode(F.array(*map(F.lit, levels or [LEAST_LEVEL])))).withColumn("_bin", bin_(F.col(value).cast("double")))

    def beyond(end: str, flag: str | None, strict: Column, loose: Column) -> Column:
        inside = loose if flag is None else F.when(F.coalesce(F.col(f"r_{flag}"), F.lit(False)), strict).otherwise(loose)
        return F.col(f"r_{end}").isNull() | inside

    v, lo, hi = F.col(value), F.col(f"r_{low}"), F.col(f"r_{high}")
    met = left.join(right, ["_level", "_bin"]).filter(beyond(low, low_open, v > lo, v >= lo) & beyond(high, high_open, v < hi, v <= hi))
    return met.select(*df.columns, *(f"r_{c}" for c in intervals.columns))


def interval_totals(df: DataFrame, value: str, intervals: DataFrame, number: str, low: str = "low", high: str = "high", low_open: str | None = None, high_open: str | None = None) -> DataFrame:
    """For each different value (``value``, as double) the count ``n`` of the intervals that hold it, and the least ``number`` of them.

    Means what ``interval_join`` means, but no pair is built: the different values and ends are put in order together, an
    interval becomes the few blocks of ranks (aligned, their lengths powers of two) that make it up, and a value meets one
    block of each length.  So the work grows with both sides, not with their product.  Values in no interval are left out.
    """
    from acrework.operators.aggregates import prefix_sums

    number_of = lambda c: F.col(c).cast("double") + 0.0
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(number_of(value).alias("at"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("one")).distinct()
    ends = intervals.select(F.col(number).alias("_number"), number_of(low).alias("_low"), F.when(flag(low_open), 2).otherwise(0).alias("_low_kind"), number_of(high).alias("_high"), F.when(flag(high_open), 0).otherwise(2).alias("_high_kind"))
    marks = [ends.select(F.col(f"_{e}").alias("at"), F.col(f"_{e}_kind").alias("kind"), F.lit(0).cast("long").alias("one")).filter("at IS NOT NULL") for e in ("low", "high")]
    placed = cut_lineage(prefix_sums(known.union(marks[0].union(marks[1]).distinct()), ["at", "kind"], "one", "upto"), "interval-ends")
    total = placed.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("_total"))  # one row
    upto = lambda e: placed.filter("kind <> 1").select(F.col("at").alias(f"_{e}"), F.col("kind").alias(f"_{e}_kind"), F.col("upto").alias(f"_{e}_upto"))
    spans = ends.join(upto("low"), ["_low", "_low_kind"], "left").join(upto("high"), ["_high", "_high_kind"], "left").crossJoin(total)
    spans = spans.select("_number", F.coalesce("_low_upto", F.lit(0)).alias("_a"), F.coalesce("_high_upto", "_total").alias("_b")).filter("_a < _b")
    halved = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_b") - F.col("_a") + 1)).cast("int"))))
    halved = halved.withColumns({"_l": F.expr("shiftright(_a + shiftleft(1L, level) - 1, level)"), "_r": F.expr("shiftright(_b, level)")}).filter("_l < _r")
    blocks = halved.select("_number", "level", F.explode(F.array_compact(F.array(F.when(F.col("_l") % 2 == 1, F.col("_l")), F.when(F.col("_r") % 2 == 1, F.col("_r") - 1)))).alias("block"))
    held = blocks.groupBy("level", "block").agg(F.count("*").alias("n"), F.min("_number").alias(number))
    ranked = placed.filter("kind = 1").crossJoin(total).withColumn("level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("_total") + 1)).cast("int")))).withColumn("block", F.expr("shiftright(upto - 1, level)"))
    return ranked.join(held, ["level", "block"]).groupBy(F.col("at").alias(value)).agg(F.sum("n").alias("n"), F.min(number).alias(number))
