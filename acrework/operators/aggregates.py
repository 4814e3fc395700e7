"""Aggregations: minimum support, shares, weighted means, histograms, trims, holdout checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def support_median(df: DataFrame, key: str, value: str, least: int, large: bool = False) -> DataFrame:
    """Median and count of each key with at least ``least`` values; rows with a null key count for none.

    ``large``: few keys with very many values each, whose medians come from ``exact_quantiles``.
    """
    known = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    if large:
        return exact_quantiles(known, [key], value, [0.5]).select(key, F.col("quantiles")[0].alias("median"), "n").filter(F.col("n") >= least)
    return known.groupBy(key).agg(F.median(value).alias("median"), F.count(value).alias("n")).filter(F.col("n") >= least)


def counts_with_share(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value and their share of all rows; the total is summed over the few counts, not the rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("_all"))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of two keys as columns, missing ones as 0, with a total over all values of the column."""
    return df.groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("total"))


def distinct_where(identity: str, condition: Column) -> Column:
    """Number of different identities among rows that satisfy a condition."""
    return F.count_distinct(F.when(condition, F.col(identity)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over rows with a value and a positive weight; null without any."""
    valid = value.isNotNull() & (weight > 0)
    return F.sum(F.when(valid, value * weight)) / F.nullif(F.sum(F.when(valid, weight)), F.lit(0.0))


def ratio_of_sums(top: Column, bottom: Column) -> Column:
    """Percentage of two sums; null unless the lower sum is positive."""
    return F.when(F.sum(bottom) > 0, F.sum(top) / F.sum(bottom) * 100)


def quantile_trim(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose value lies within two quantiles (linear interpolation), bounds included."""
    bounds = exact_quantiles(df, [], value, [low, high]).select(F.col("quantiles").alias("_b"))
    return df.crossJoin(bounds).filter(F.col(value).between(F.col("_b")[0], F.col("_b")[1])).drop("_b")


def agreement(df: DataFrame, left: str, right: str, within: Sequence[float]) -> DataFrame:
    """How well two measures agree where both are positive: n, median absolute difference, shares within limits."""
    gaps = df.filter((F.col(left) > 0) & (F.col(right) > 0)).select(F.abs(F.col(left) - F.col(right)).alias("_gap"))
    shares = [F.avg((F.col("_gap") <= limit).cast("double")).alias(f"within_{limit:g}".replace(".", "_")) for limit in within]
    return with_median(gaps.agg(F.count("*").alias("n"), *shares), gaps, "_gap", "median_gap")


def explicit_histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts in the right-closed bins between edges, empty ones included."""
    spark = df.sparkSession
    labels = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lower double, upper double")
    which = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (F.col(value) > a) & (F.col(value) <= b)
        which = F.when(inside, i) if which is None else which.when(inside, i)
    counts = df.select(which.alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    return labels.join(counts, "bin", "left").fillna(0, ["n"])


def equal_width_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Each row with its ``bin`` of equal width from least to largest value (the last edge counts to the last bin).

    Rows without a value have no row here, nor has any if all values are equal.  The members of a bin are its rows; they
    are never gathered in one place.
    """
    known = df.filter(F.col(value).isNotNull())
    ends = known.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).filter("_hi > _lo")
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int")
    return known.crossJoin(ends).withColumn("bin", place).drop("_lo", "_hi")  # one row


def equal_width_histogram(df: DataFrame, value: str, identity: str, bins: int, selected: Column) -> DataFrame:
    """Counts in equal bins from least to largest value (the last edge counts to the last bin); no rows if they are equal."""
    return equal_width_bins(df, value, bins).groupBy("bin").agg(F.count("*").alias("n"), F.count_if(selected).alias("selected"), F.min(identity).alias("first_id"))


def assign_classes(df: DataFrame, value: str, breaks: DataFrame, name: str = "class") -> DataFrame:
    """Each row's class, from 0: the number of breaks (rows of ``break``, one for each class but the last) below its value.

    A value that equals a break belongs to the class that ends there; a row without a value has none.
    """
    ordered = breaks.agg(F.array_sort(F.collect_list("break")).alias("_breaks"))  # one row, of as many values as classes
    place = F.when(F.col(value).isNotNull(), F.size(F.filter("_breaks", lambda b: b < F.col(value))))
    return df.crossJoin(ordered).withColumn(name, place).drop("_breaks")


def ordered_breaks(df: DataFrame, value: str, classes: int) -> DataFrame:
    """Break i of n classes is element floor(N * i / n) of the sorted values (not interpolated)."""
    known = df.filter(F.col(value).isNotNull()).select(value)
    # equal values share a row, so what is ranked is the values' counts, and only break positions are kept
    counts = known.groupBy(value).agg(F.count("*").alias("_c"))
    upto = prefix_sums(counts, [value], "_c", "_upto")
    wanted = known.agg(F.count("*").alias("_n")).select(F.explode(F.sequence(F.lit(1), F.lit(classes - 1))).alias("i"), "_n").withColumn("_at", F.floor(F.col("_n") * F.col("i") / classes))
    return upto.join(F.broadcast(wanted), (F.col("_at") >= F.col("_upto") - F.col("_c")) & (F.col("_at") < F.col("_upto"))).select("i", F.col(value).alias("break"))


#: Accuracy of the sketches that bracket exact quantiles: a bracket holds about four in so many rows.
BRACKET = 2_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Of each key n, the number of values, and ``quantiles`` (linear interpolation), for groups of any size.

    A sketch brackets every quantile; then only the values inside a bracket are told apart, and all between two brackets
    are one count.  These few rows are summed over a global order in two passes, so no group is held in one task and no
    row but those counts is sorted or shuffled.  Where a quantile should lie outside of its bracket all values of its group
    are counted instead, so the result is exact.  Rows without a value count for none; a null key is a key of its own.
    """
    from acrework.functions.storage import cut_lineage

    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    wanted = sorted(set(map(float, probabilities)))
    around = [(max(0.0, p - 2 / BRACKET), min(1.0, p + 2 / BRACKET)) for p in wanted]
    near = F.percentile_approx("_v", [q for pair in around for q in pair], BRACKET)
    sketches = cut_lineage(known.groupBy(*keys).agg(near.alias("_near")), "brackets").withColumnsRenamed({k: f"_b{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    placed = known.join(sketches, same) if keys else known.crossJoin(sketches)  # without keys one row
    ends = [(F.lit(float("-inf")) if low == 0 else F.get("_near", 2 * i), F.lit(float("nan")) if high == 1 else F.get("_near", 2 * i + 1)) for i, (low, high) in enumerate(around)]  # NaN is above all
    inside = reduce(lambda x, y: x | y, ((F.col("_v") >= low) & (F.col("_v") <= high) for low, high in ends))
    gap = reduce(lambda x, y: x + y, ((F.col("_v") > high).cast("int") for _, high in ends))
    told = placed.select(*keys, "_v", F.when(inside, F.col("_v")).alias("_w"), F.when(~inside, gap).alias("_gap"))
    counted = told.groupBy(*keys, "_w", "_gap").agg(F.count("*").alias("_c"), F.min("_v").alias("_v")).withColumn("_told", F.col("_gap").isNull()).drop("_w", "_gap")
    found = cut_lineage(_picked(counted, keys, probabilities), "quantiles")
    missed = found.filter("NOT _sure").select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)), F.lit(1).alias("_missed"))
    if not missed.isEmpty():
        again = known.join(missed, same, "left_semi") if keys else known
        every = again.groupBy(*keys, "_v").agg(F.count("*").alias("_c")).withColumn("_told", F.lit(True))
        found = found.filter("_sure").unionByName(_picked(every, keys, probabilities))
    return found.drop("_sure")


def _picked(counts: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Quantiles from counts ``_c`` of values ``_v``; ``_sure`` unless one falls on a count of several values (not ``_told``)."""
    upto = prefix_sums(counts, [*keys, "_v"], "_c", "_upto")
    sizes = upto.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_c")).alias("_from"), F.sum("_c").alias("n"))
    at = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_from", "n", F.posexplode(F.array(*map(F.lit, map(float, probabilities)))).alias("_i", "_p"))
    at = at.withColumn("_at", F.col("_p") * (F.col("n") - 1)).withColumns({"_low": F.col("_from") + F.floor("_at"), "_high": F.col("_from") + F.ceil("_at")})
    holds = lambda place: (F.col(place) >= F.col("_upto") - F.col("_c")) & (F.col(place) < F.col("_upto"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = upto.join(at if keys else F.broadcast(at), same & (holds("_low") | holds("_high")))  # without keys one row for each probability
    ends = met.groupBy(*keys, "n", "_i", "_at").agg(F.max(F.when(holds("_low"), F.col("_v"))).alias("_a"), F.max(F.when(holds("_high"), F.col("_v"))).alias("_b"), F.bool_and("_told").alias("_sure"))
    part = F.col("_at") - F.floor("_at")
    found = F.struct("_i", (F.col("_a") * (1 - part) + F.col("_b") * part).alias("q"))
    return ends.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(found)), lambda e: e["q"]).alias("quantiles"), F.bool_and("_sure").alias("_sure"))


def with_median(summary: DataFrame, df: DataFrame, value: str, name: str) -> DataFrame:
    """A summary of one row with the exact median of a column of ``df`` (null without values)."""
    middle = exact_quantiles(df, [], value, [0.5]).select(F.col("quantiles")[0].alias(name))
    return summary.join(middle, how="left")


def prefix_sums(df: DataFrame, order: Sequence[Column | str], value: str | Sequence[str], name: str | Sequence[str]) -> DataFrame:
    """Running sums of one column or several over a global order in two passes: range-partitioned sums, then sums within each.

    Only one row of totals for each partition is ever ordered in a single task, and the rows are read once: they are
    written with their partition's number, from which both passes read.
    """
    from acrework.functions.storage import cut_lineage

    sums = dict(zip([name] if isinstance(name, str) else name, [value] if isinstance(value, str) else value))
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(*(F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.withColumns({n: F.sum(v).over(inside) for n, v in sums.items()})
    return within.join(base, "_part").withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in sums}).drop("_part", *(f"_base_{n}" for n in sums))


def level_medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Medians of every value of several keys, and of all rows, in one global order: ``level``, ``key``, ``median``, ``n``.

    Level i is that of the i-th key (as text; rows without it count for none), the last level is all rows (key null).
    """
    place = lambda i, key: F.struct(F.lit(i).alias("level"), key.cast("string").alias("key"))
    places = F.array(*(F.when(F.col(k).isNotNull(), place(i, F.col(k))) for i, k in enumerate(keys)), place(len(keys), F.lit(None)))
    rows = df.select(F.explode(F.array_compact(places)).alias("_l"), F.col(value).alias("_value")).select("_l.level", "_l.key", "_value")
    return exact_quantiles(rows, ["level", "key"], "_value", [0.5]).select("level", "key", F.col("quantiles")[0].alias("median"), "n")


def district_profile(df: DataFrame, selected: DataFrame, key: str, sums: Sequence[str], ratios: Mapping[str, tuple[str, str]], means: Sequence[str], weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums, percentages of two sums and weighted means of the selected rows, or of all rows where none is selected.

    ``ratios`` names each percentage with its upper and lower column.  Null values add nothing (a sum without values is
    0); a ratio without a positive lower sum and a mean without positive weight are null; a row with a null key is never
    selected, and repeated keys in ``selected`` count once.
    """
    marked = df.join(selected.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    chosen = marked.crossJoin(marked.agg(F.bool_or("_in").alias("_some"))).filter("_in OR _some IS NULL")  # one row
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    share = [ratio_of_sums(F.col(top), F.col(bottom)).alias(name) for name, (top, bottom) in ratios.items()]
    mean = [weighted_mean(F.col(c), F.col(weight)).alias(c) for c in means]
    return chosen.groupBy(*by).agg(F.count("*").alias("n"), *total, *share, *mean)


def present_value(amount: Column, period: Column, rate: float) -> Column:
    """Sum of amounts discounted by their period."""
    return F.sum(amount / F.pow(F.lit(1 + rate), period))


def fold(key: Column) -> Column:
    """A stable number from 0 to 99 for a key, for splits that any engine can repeat."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100


def hierarchical_estimate(df: DataFrame, fine: DataFrame, coarse: DataFrame, overall: DataFrame, fine_key: str, coarse_key: str) -> DataFrame:
    """Each row's estimate from the finest level that has one, with the name of the level."""
    joined = (
        df.join(fine.select(fine_key, F.col("median").alias("_f")), fine_key, "left")
        .join(coarse.select(coarse_key, F.col("median").alias("_c")), coarse_key, "left")
        .crossJoin(overall.select(F.col("median").alias("_g")))
    )
    method = F.when(F.col("_f").isNotNull(), "fine").when(F.col("_c").isNotNull(), "coarse").otherwise("overall")
    return joined.withColumns({"estimate": F.coalesce("_f", "_c", "_g"), "method": method}).drop("_f", "_c", "_g")


def peak_and_trough(df: DataFrame, series: str, year: str, value: str) -> DataFrame:
    """Peak, lowest point from the peak on, latest value, drop and recovered share of each series."""
    peak = df.groupBy(series).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(year)).alias("y"))).alias("p"), F.max_by(value, year).alias("latest")).select(series, F.col("p.v").alias("peak"), (-F.col("p.y")).alias("peak_year"), "latest")
    after = df.join(peak, series).filter(F.col(year) >= F.col("peak_year")).groupBy(series).agg(F.min(F.struct(F.col(value).alias("v"), F.col(year).alias("y"))).alias("t"))
    joined = peak.join(after, series).select(series, "peak", "peak_year", F.col("t.v").alias("trough"), F.col("t.y").alias("trough_year"), "latest")
    return joined.withColumns({"drop": 1 - F.col("trough") / F.col("peak"), "recovered": (F.col("latest") - F.col("trough")) / F.nullif(F.col("peak") - F.col("trough"), F.lit(0.0))})
