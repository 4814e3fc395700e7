"""Rules as data: many subjects against many rules, with "unknown" as a result of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrework.functions.scalars import holds
from acrework.operators.audits import contract_faults

STATES = ("meets", "fails", "unknown", "not_applicable")


def evaluate_minimum(value: Column, minimum: Column, applies: Column, tolerance: float = 0.0) -> Column:
    """State of a minimum rule; a missing measure or minimum is unknown and never passes."""
    return F.when(~holds(applies), "not_applicable").when(value.isNull() | minimum.isNull(), "unknown").when(value >= minimum * (1 - tolerance), "meets").otherwise("fails")


def evaluate_rules(subjects: DataFrame, rules: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Each subject with the rule of its keys (columns ``minimum`` and ``rule``); no rule means not applicable."""
    joined = subjects.join(rules, list(keys), "left")
    return joined.withColumn("state", evaluate_minimum(F.col(value), F.col("minimum"), F.col("rule").isNotNull(), tolerance))


def screen(in_scope: Column, measures: Sequence[tuple[Column, float]], tolerance: float = 0.01) -> dict[str, Column]:
    """Flags of a screen: scope, evaluated (scope and all measures known and positive), below some minimum less tolerance."""
    scope = holds(in_scope)
    known, below = F.lit(True), F.lit(False)
    for value, minimum in measures:
        known = known & holds(value > 0)
        below = below | holds(value < minimum * (1 - tolerance))
    return {"in_scope": scope, "evaluated": scope & known, "below": scope & known & below}


def maximum_coverage(kind: Column, area: Column) -> Column:
    """35 percent and one more for each full 100 square feet under the base of the building type, 45 at most."""
    base = F.when(kind == "single_family", 4000).when(kind == "two_family", 4300)
    return F.when(base.isNotNull() & area.isNotNull(), F.least(F.lit(45), 35 + F.greatest(F.lit(0), F.floor((base - area) / 100)))).cast("int")


def ordered_reason(reasons: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first condition that holds."""
    out = None
    for name, condition in reasons:
        out = F.when(holds(condition), name) if out is None else out.when(holds(condition), name)
    return out.otherwise(otherwise)


def ambiguous(parts: Column, dominant_share: Column, least: float = 0.90) -> Column:
    """More than one material part and no clear principal one."""
    return (parts > 1) & (dominant_share.isNull() | (dominant_share < least))


def least_count(members: Column, numerator: int, denominator: int, strict: bool) -> Column:
    """Whole members needed for at least (or, if strict, more than) a share, in exact integers."""
    product = members.cast("bigint") * numerator
    return F.floor(product / denominator) + 1 if strict else F.floor((product + (denominator - 1)) / denominator)


def vote_passes(members: Column, votes: Column, override: Column) -> Column:
    """Strict majority, or two thirds in the overriding matter."""
    return votes >= F.when(override, least_count(members, 2, 3, False)).otherwise(least_count(members, 1, 2, True))


def spacing_bar(near: DataFrame, subject: str, site: str, distance: str, radius: float, waivers: DataFrame, least: int = 2) -> DataFrame:
    """Subjects barred by ``least`` different sites within a radius (included) and no waiver."""
    inside = near.groupBy(subject).agg(F.count_distinct(F.when(F.col(distance) <= radius, F.col(site))).alias("sites"))
    waived = waivers.select(subject, F.lit(True).alias("_w")).distinct()
    return inside.join(waived, subject, "left").withColumn("barred", (F.col("sites") >= least) & F.col("_w").isNull()).drop("_w")


def waiver_finding(permitted: Column, centre: Column, improvement: Column) -> Column:
    """District bar, then both findings, one of them (ambiguous), none."""
    return F.when(~holds(permitted), "denied").when(holds(centre) & holds(improvement), "eligible").when(holds(centre) | holds(improvement), "ambiguous").otherwise("none")


def constraint(spec: dict, value: Column) -> Column:
    """A membership test from data: interval, equal, one_of, all, any, not."""
    kind = spec["kind"]
    if kind == "interval":
        out = F.lit(True)
        if spec.get("low") is not None:
            out = out & (value > spec["low"] if spec.get("low_open") else value >= spec["low"])
        if spec.get("high") is not None:
            out = out & (value < spec["high"] if spec.get("high_open") else value <= spec["high"])
        return out
    if kind == "equal":
        return value == spec["value"]
    if kind == "one_of":
        return value.isin(*spec["values"])
    parts = [constraint(s, value) for s in spec.get("of", [])]
    if kind == "not":
        return ~parts[0]
    out = F.lit(kind == "all")
    for p in parts:
        out = out & p if kind == "all" else out | p
    return out


def interval_fault(low: Column, high: Column, low_open: Column, high_open: Column) -> Column:
    """``inverted`` or ``empty`` for intervals that hold nothing, ``incomparable`` for ends that are no numbers, else null."""
    return F.when(F.isnan(low) | F.isnan(high), "incomparable").when(low > high, "inverted").when((low == high) & (low_open | high_open), "empty")


#: Parts of a metre's 1/32,000,000 in a foot and in an inch.
LATTICE_FOOT, LATTICE_INCH = 9_753_600, 812_800


def lattice_length(feet: Column, inches: Column) -> Column:
    """Feet and inches on the exact lattice; null if a length falls between its points."""
    wide = "decimal(38,6)"
    total = feet.cast("decimal(18,6)") * F.lit(LATTICE_FOOT).cast("decimal(19,0)") + inches.cast("decimal(18,6)") * F.lit(LATTICE_INCH).cast("decimal(19,0)")
    total = total.cast(wide)
    return F.when(total == F.floor(total), total.cast("decimal(38,0)"))


def ratio_at_most(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a / b <= c / d for positive denominators, by cross products."""
    return a.cast("decimal(19,0)") * d.cast("decimal(19,0)") <= c.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def fact_errors(facts: DataFrame, relations: DataFrame, kinds: DataFrame) -> DataFrame:
    """Facts (s, p, o) that no definition allows: unknown relation, unknown individual, wrong domain or range.

    ``relations`` has p, domain, range; ``kinds`` has node and every kind it is (ancestors included).
    """
    of = lambda side, name: kinds.select(F.col("node").alias(side), F.col("kind").alias(name)).distinct()
    known = kinds.select("node").distinct()
    out = facts.join(relations, "p", "left").join(known.select(F.col("node").alias("s"), F.lit(True).alias("_s")), "s", "left").join(known.select(F.col("node").alias("o"), F.lit(True).alias("_o")), "o", "left")
    out = out.join(of("s", "domain").withColumn("_d", F.lit(True)), ["s", "domain"], "left").join(of("o", "range").withColumn("_r", F.lit(True)), ["o", "range"], "left")
    error = F.when(F.col("domain").isNull(), "unknown relation").when(F.col("_s").isNull() | F.col("_o").isNull(), "unknown individual").when(F.col("_d").isNull(), "wrong domain").when(F.col("_r").isNull(), "wrong range")
    return out.withColumn("error", error).filter("error IS NOT NULL").select("s", "p", "o", "error")


def missing_fact(fact: Column, closed: Column) -> Column:
    """True or false as recorded; an unrecorded fact is false where the predicate is closed, else unknown."""
    return F.when(fact.isNotNull(), F.when(fact, "true").otherwise("false")).when(holds(closed), "false").otherwise("unknown")


def blocked(rules: DataFrame, status: str, interpretation: str) -> DataFrame:
    """Adds ``blocked``: a rule that is not reviewed, or whose interpretation is open, does not run."""
    return rules.withColumn("blocked", ~holds(F.col(status) == "reviewed") | holds(F.col(interpretation) == "open"))


def branch_effect(share: Column, permitted: Column) -> Column:
    """By right under half, conditional over it; a missing fact is unknown and the exact half unresolved."""
    return F.when(share.isNull() | permitted.isNull(), "unknown").when(~permitted, "not allowed").when(share < 0.5, "by right").when(share > 0.5, "conditional").otherwise("unresolved")


def formula_setback(length: Column, height: Column, divisor: int, floor: float = 5.0) -> Column:
    """(length + height) / divisor, at least a floor; unknown (null) if an input is missing."""
    total = (length + height) / divisor
    return F.when(total.isNotNull(), F.greatest(F.lit(floor), total))


def overlay_prohibitions(subjects: DataFrame, rules: DataFrame, district: str) -> DataFrame:
    """Prohibitions by district or by the wildcard ``*``, as two plain joins."""
    own = subjects.join(rules.filter("scope <> '*'"), F.col(district) == F.col("scope"))
    everywhere = subjects.withColumn("_all", F.lit("*")).join(rules.filter("scope = '*'"), F.col("_all") == F.col("scope")).drop("_all")
    return own.unionByName(everywhere)


def chapter_applies(in_city: Column, exempt: Column) -> Column:
    """Land in the city, unless it is known to be exempt from local zoning."""
    return holds(in_city) & ~holds(exempt)


def controlling_rule(own_stricter: Column, table_against_list: Column, other: str) -> Column:
    """Which rule controls: in a conflict of a use table with a use list the list, else the stricter one.

    An unknown comparison is ``unknown``; ``other`` names the rule the chapter is compared with.
    """
    return F.when(holds(table_against_list), "use list").when(own_stricter.isNull(), "unknown").when(own_stricter, "chapter").otherwise(other)


def nonconformity_continues(was_legal: Column, situation_continues: Column, conforms_now: Column) -> Column:
    """A legal nonconformity goes on while its situation does and until it conforms."""
    return holds(was_legal) & holds(situation_continues) & ~holds(conforms_now)


def may_extend(original_body: Column, findings_valid: Column, earlier: Column, months: Column, most_months: int = 12) -> Column:
    """A prior approval may be extended once, by the body that gave it, on valid findings, for a year at most."""
    return holds(original_body) & holds(findings_valid) & holds(earlier == 0) & holds(months <= most_months)


def may_choose_prior_rules(submitted: Column, effective: Column, decided: Column, complete: Column) -> Column:
    """Complete before the effective date and still pending on it (decided on it or later, or not at all)."""
    return holds(submitted < effective) & holds(complete) & holds(F.coalesce(decided >= effective, F.lit(True)))


def ledger_faults(ledger: DataFrame, manifest: DataFrame, key: str, section: str, disposition: str, allowed: Sequence[str], filled: Sequence[str], columns: Sequence[str], digest: str = "digest") -> DataFrame:
    """Faults of a ledger against its manifest as rows (at, fault); a clean ledger gives none.

    Rows: a blank ``filled`` column, ``disposition`` (not allowed), ``repeated`` ids.  Sections: ``uncovered`` (only in
    the manifest), ``unlisted`` (only in the ledger), ``digest`` (not 64 lower-case hexadecimal digits).  The whole
    ledger: ``columns``, if its columns are not those expected.
    """
    at = lambda c: F.col(c).cast("string").alias("at")
    rows = contract_faults(ledger, key, list(filled), {"disposition": F.col(disposition).isin(*allowed)}).select(at(key), "fault")
    there, listed = ledger.select(section).distinct(), manifest.select(section).distinct()
    uncovered = listed.join(there, section, "left_anti").select(at(section), F.lit("uncovered").alias("fault"))
    unlisted = there.join(listed, section, "left_anti").select(at(section), F.lit("unlisted").alias("fault"))
    bad = manifest.filter(~holds(F.col(digest).rlike("^[0-9a-f]{64}$"))).select(at(section), F.lit("digest").alias("fault"))
    out = rows.union(uncovered).union(unlisted).union(bad)
    if list(ledger.columns) != list(columns):
        out = out.union(ledger.sparkSession.createDataFrame([(None, "columns")], "at string, fault string"))
    return out


def resolve_uses(entries: DataFrame, groups: DataFrame, district: str, entry: str, group: str, use: str) -> DataFrame:
    """District and specific use, each pair once: an entry that names a broad group stands for all its uses."""
    named = groups.select(F.col(group).alias("_group"), F.col(use).alias("_use")).distinct()
    return entries.join(named, F.col(entry) == F.col("_group"), "left").select(district, F.coalesce("_use", entry).alias(use)).distinct()
