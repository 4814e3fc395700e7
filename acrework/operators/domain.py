"""Named pipelines over the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrework.functions.scalars import band, clip, lookup, resolve, threshold_label, whole_needed, with_default
from acrework.operators.aggregates import pivot_counts
from acrework.operators.joins import fallback_join
from acrework.operators.windows import first_recorded

#: Lane capacity by functional class, default last.
CAPACITY, CAPACITY_OTHER = {1: 2200, 2: 2000, 3: 1800, 4: 1700}, 1600
CROWDING = ([(0.3, "free"), (0.5, "light"), (0.7, "moderate"), (0.85, "heavy")], [(1.0, "near capacity")], "over capacity")


def volume_over_capacity(segments: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Peak volume over capacity of each road segment, its category, needed and excess lanes."""
    col = {k: resolve(segments, v, mandatory=k in ("volume", "lanes")) for k, v in names.items()}
    value = lambda k, default: with_default(segments, col[k], default) if col.get(k) else F.lit(default)
    per_direction = F.when(value("one_way", False), value("lanes", 1)).otherwise(value("lanes", 1) / 2)
    capacity = lookup(value("class", 0), CAPACITY, CAPACITY_OTHER)
    peak = value("volume", 0) * value("k", 0.1) * value("d", 0.55)
    needed = whole_needed(peak / capacity)
    out = segments.withColumns({"vc": peak / F.nullif(per_direction * capacity, F.lit(0)), "needed": needed, "excess": clip(per_direction - needed, 0)})
    return out.withColumns({"category": threshold_label(F.col("vc"), *CROWDING), "excess_miles": F.col("excess") * value("miles", 1.0)})


def value_per_area(parcels: DataFrame, value: str, area: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Value per unit of area where both are recorded and positive, and its band."""
    recorded = F.coalesce((F.col(value) > 0) & (F.col(area) > 0), F.lit(False))
    rate = F.when(recorded, F.col(value) / F.col(area))
    return parcels.withColumns({"recorded": recorded, "rate": rate, "band": band(rate, edges, labels)})


def tax_scenarios(parcels: DataFrame, key: str, land: Column, building: Column, rate: float, years: int = 20, abatement: float = 0.7, power: float = 1.5) -> DataFrame:
    """Per parcel and year: conventional, abated-building and land-only tax, with power-law depreciation of buildings."""
    t = F.col("year")
    rows = parcels.select(key, land.alias("_l"), building.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(years))).alias("year"))
    left = F.col("_b") * F.pow(1 - t / (years + 1), F.lit(power))
    return rows.select(key, "year", ((F.col("_l") + left) * rate).alias("conventional"), ((F.col("_l") + left * (1 - abatement)) * rate).alias("abated"), (F.col("_l") * rate).alias("land_only"))


def present_values(scenarios: DataFrame, key: str, discount: float) -> DataFrame:
    """Present value of each scenario per parcel, and the reduction against the conventional one."""
    weight = F.pow(F.lit(1 + discount), F.col("year"))
    sums = scenarios.groupBy(key).agg(*(F.sum(F.col(c) / weight).alias(c) for c in ("conventional", "abated", "land_only")))
    return sums.withColumn("reduction", 1 - F.col("land_only") / F.nullif("conventional", F.lit(0.0)))


def case_file(cases: DataFrame, hearings: DataFrame, key: str, day: str, fields: list[str]) -> DataFrame:
    """One row for each case with its hearings as an array in date order (empty where there is none)."""
    nested = hearings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(day, *fields))).alias("hearings"))
    return cases.join(nested, key, "left").withColumn("n_hearings", F.coalesce(F.size("hearings"), F.lit(0)))


def case_histories(hearings: DataFrame, key: str, day: str, outcome: str, overrides: DataFrame | None = None) -> DataFrame:
    """Appearances (different days), first and last day and final outcome of each case; reviewed overrides win."""
    out = hearings.groupBy(key).agg(F.count_distinct(day).alias("appearances"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.max(F.struct(day, outcome)).alias("_l"))
    out = out.withColumn("final_outcome", F.col(f"_l.{outcome}")).drop("_l")
    if overrides is not None:
        out = out.join(overrides.select(key, F.col(outcome).alias("_o")), key, "left").withColumn("final_outcome", F.coalesce("_o", "final_outcome")).drop("_o")
    return out


def burden(rows: DataFrame, by: str, cost: Column, income: Column, weight: Column) -> DataFrame:
    """Shares of households that pay over 30 and 50 percent of income, and the category of the area."""
    share = cost / F.nullif(income, F.lit(0))
    sums = rows.groupBy(by).agg(F.sum(F.when(share > 0.3, weight).otherwise(0)).alias("_a"), F.sum(F.when(share > 0.5, weight).otherwise(0)).alias("_b"), F.sum(weight).alias("_w"))
    over, severe = F.col("_a") / F.nullif("_w", F.lit(0)), F.col("_b") / F.nullif("_w", F.lit(0))
    category = F.when(over < 0.1, "low").when(over < 0.3, "moderate").when(severe < 0.3, "high").otherwise("severe")
    return sums.select(by, over.alias("over_30"), severe.alias("over_50"), category.alias("category"))


def ranked_candidates(sites: DataFrame, gates: Sequence[tuple[str, Column]], size: str, ties: str) -> DataFrame:
    """The sites that pass every gate (null fails), largest first."""
    passed = F.lit(True)
    for _, gate in gates:
        passed = passed & F.coalesce(gate, F.lit(False))
    return sites.filter(passed).orderBy(F.desc(size), ties)


def spacing_audit(cases: DataFrame, reviewed: DataFrame, excluded: DataFrame, key: str, outcome: str, granted: str, denied: str) -> DataFrame:
    """Cases with ``audit_status``, ``distance_share`` (actual by required) and ``outcome_label``.

    ``reviewed`` has key, required, actual and context, one row for each case; a reviewed case is an ``explicit_pair``,
    one in ``excluded`` is ``not_spacing_case`` whatever else is known, all others are ``not_stated``.
    """
    pairs = reviewed.select(key, "required", "actual", "context", F.lit(True).alias("_pair"))
    out = cases.join(pairs, key, "left").join(excluded.select(key, F.lit(True).alias("_not")).distinct(), key, "left")
    status = F.when(F.col("_not"), "not_spacing_case").when(F.col("_pair"), "explicit_pair").otherwise("not_stated")
    label = F.when(F.col(outcome) == granted, "Granted").when(F.col(outcome) == denied, "Denied").otherwise("Other")
    return out.withColumns({"audit_status": status, "distance_share": F.col("actual") / F.nullif("required", F.lit(0.0)), "outcome_label": label}).drop("_pair", "_not")


def repeat_sites(cases: DataFrame, records: DataFrame, case: str, day: str, record: str) -> DataFrame:
    """Cases linked to address records (number and street, else an unambiguous number and street without direction), by address.

    Both sides have ``number`` and ``street``.  Columns: number, street, record, appearances (different days), cases,
    first_seen, last_seen; cases without a record are left out.
    """
    bare = F.regexp_replace("street", r"^(?:N|S|E|W)\s+", "")
    linked = fallback_join(cases.withColumn("street_nodir", bare), records.withColumn("street_nodir", bare), ["number", "street"], ["number", "street_nodir"], record)
    found = linked.filter(F.col(record).isNotNull()).groupBy("number", "street")
    return found.agg(F.min(record).alias("record"), F.count_distinct(day).alias("appearances"), F.count_distinct(case).alias("cases"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))


def most_repeated(sites: DataFrame, n: int = 10) -> DataFrame:
    """The n addresses with most appearances, of those with more than one."""
    return sites.filter("appearances > 1").orderBy(F.desc("appearances"), F.desc("cases"), "street", "number").limit(n)


def request_outcomes(cases: DataFrame, listed: DataFrame, key: str, listing: str, category: str, outcome: str, granted: str, denied: str, rank: dict[str, int]) -> DataFrame:
    """Clear decisions by primary request: granted, denied, total and the share granted."""
    clear = first_recorded(cases, listed, key, listing, category, rank).filter(F.col(outcome).isin(granted, denied))
    counts = pivot_counts(clear, "primary", outcome, [granted, denied])
    return counts.select(F.col("primary").alias("request"), F.col(granted).alias("granted"), F.col(denied).alias("denied"), "total", (F.col(granted) / F.col("total")).alias("grant_share"))


def provision_ledger(blocks: DataFrame, effects: DataFrame, citations: DataFrame, rules: DataFrame, key: str, section: str) -> DataFrame:
    """Every block with its classes, citations and rules; none of them is lost for want of one.

    ``effects`` has key and effect, ``citations`` key, cited and times, ``rules`` one row for each reviewed executable
    rule of a section.  A section with rules is only ``partially_reviewed_executable``, the others ``source_encoded``.
    """
    classes = effects.groupBy(key).agg(F.array_sort(F.collect_set("effect")).alias("classes"))
    cited = citations.groupBy(key).agg(F.count("*").alias("cited"), F.sum("times").alias("mentions"))
    own = rules.groupBy(section).agg(F.count("*").alias("rules"))
    out = blocks.select(key, section).join(classes, key, "left").join(cited, key, "left").join(own, section, "left").fillna(0, ["cited", "mentions", "rules"])
    state = F.when(F.col("rules") > 0, "partially_reviewed_executable").otherwise("source_encoded")
    return out.withColumns({"classes": F.coalesce("classes", F.array().cast("array<string>")), "state": state})
