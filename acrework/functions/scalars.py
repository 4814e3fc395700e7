"""Column expressions: coercion, normalisation, bands, guards.  All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """Text as double; text that is no number, and NaN, become null."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def holds(condition: Column) -> Column:
    """A comparison in which a missing value counts as false."""
    return F.coalesce(condition, F.lit(False))


def resolve(df: DataFrame, candidates: Sequence[str], mandatory: bool = True) -> str | None:
    """The first candidate that is a column, whatever its case; an error if none is and one must be."""
    present = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in present:
            return present[name.lower()]
    if mandatory:
        raise ValueError(f"none of {list(candidates)} among the columns {df.columns}")
    return None


def with_default(df: DataFrame, column: str, default) -> Column:
    """The column with nulls filled, or the constant where the column is absent."""
    return F.coalesce(F.col(column), F.lit(default)) if column in df.columns else F.lit(default)


def first_positive(*values: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*(F.nullif(v, F.lit(0)) for v in values))


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the band (lower, upper] that holds the value; the last band is open; null outside and for null."""
    out = None
    for low, high, label in zip(edges, [*edges[1:], None], labels):
        inside = (value > low) & (F.lit(True) if high is None else value <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def threshold_label(value: Column, below: Sequence[tuple[float, str]], up_to: Sequence[tuple[float, str]] = (), otherwise: str | None = None) -> Column:
    """The first label whose limit is above (``below``) or not under (``up_to``) the value, in that order."""
    out = F.when(value.isNull(), None)
    for limit, label in below:
        out = out.when(value < limit, label)
    for limit, label in up_to:
        out = out.when(value <= limit, label)
    return out.otherwise(otherwise)


def lookup(key: Column, pairs: dict, default=None) -> Column:
    """Value of a fixed mapping, or the default."""
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def identifier(value: Column) -> Column:
    """Letters and digits in upper case; nothing left becomes null."""
    return F.nullif(F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", "")), F.lit(""))


def clip(value: Column, low=None, high=None) -> Column:
    """Keep within bounds; null stays null."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def bucket(value: Column, width: float) -> Column:
    """The nearest multiple of the width; halves go to the even one."""
    return F.bround(value / width) * width


def whole_needed(value: Column) -> Column:
    """Rounded up, one at least; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.ceil(value)))


def numbers_in(text: Column, low: float, high: float) -> Column:
    """All plain numbers in a text that lie within bounds."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.try_cast("double"))
    return F.filter(found, lambda x: (x >= low) & (x <= high))


def first_of_hierarchy(values: Column, order: Sequence[str]) -> Column:
    """The first name in ``order`` that the array holds, else its first element."""
    out = F.when(F.array_contains(values, order[0]), order[0])
    for name in order[1:]:
        out = out.when(F.array_contains(values, name), name)
    return out.otherwise(F.get(values, 0))


def tagged(choices: Sequence[tuple[Column, str]]) -> Column:
    """(value, source) of the first choice with a value."""
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(v.cast("double").alias("value"), F.lit(tag).alias("source"))) for v, tag in choices))


def joined_key(values: Column) -> Column:
    """A set of texts as one sorted, pipe-joined key."""
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def shortened(text: Column, separators: str, length: int) -> Column:
    """The text before the first separator, trimmed and cut to a length."""
    return F.substring(F.trim(F.get(F.split(text, f"[{separators}]", 2), 0)), 1, length)


def feet_and_inches(feet: Column) -> Column:
    """A length in feet as F' I", inches to the nearest whole."""
    inches = F.bround(feet * 12).cast("long")
    return F.concat(F.floor(inches / 12).cast("string"), F.lit("' "), F.pmod(inches, F.lit(12)).cast("string"), F.lit('"'))


def or_label(text: Column, label: str) -> Column:
    """Blank or missing text becomes a label."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(label))


def spreadsheet_safe(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(text.rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def web_url(text: Column) -> Column:
    """The address if its scheme is http or https, else null."""
    return F.when(F.lower(F.try_parse_url(text, F.lit("PROTOCOL"))).isin("http", "https"), text)


def matches_filter(fields: Sequence[Column], needle: str = "", label: Column | None = None, labels: Sequence[str] = (), year: Column | None = None, years: Sequence[int] = ()) -> Column:
    """Substring over joined fields, label in a set, year in a set; an empty set or needle filters nothing."""
    out = F.lit(True)
    if needle:
        out = out & (F.instr(F.lower(F.concat_ws(" ", *fields)), needle.lower()) > 0)
    if labels:
        out = out & label.isin(*labels)
    if years:
        out = out & year.isin(*years)
    return holds(out)


def all_conditions(conditions: Sequence[tuple[str, str, float | None]]) -> Column:
    """Conjunction of (column, operator, number); blank numbers are ignored, equality has a tolerance, null fails."""
    out = F.lit(True)
    for name, op, value in conditions:
        if value is None:
            continue
        c = F.col(name)
        test = {"=": F.abs(c - value) < 1e-9, "!=": F.abs(c - value) >= 1e-9, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
        out = out & holds(test)
    return out


def boxes_meet(box: dict[str, float], xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """True where a feature's box touches or overlaps a fixed box."""
    return (xmin <= box["xmax"]) & (xmax >= box["xmin"]) & (ymin <= box["ymax"]) & (ymax >= box["ymin"])
