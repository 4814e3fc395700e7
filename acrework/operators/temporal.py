"""Calendar and deadline operators; policies are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instants(start: str, end: str, minutes: int):
    """Instants from start to end, both included."""
    return F.explode(F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr(f"INTERVAL {minutes} MINUTES")))


def add_business_days(day: Column, n: int) -> Column:
    """The n-th open day (Monday to Friday) after a day; n is at least 1."""
    weekday = F.weekday(day)  # Monday is 0
    from_friday = F.when(weekday > 4, F.lit(4)).otherwise(weekday)
    base = F.date_sub(F.to_date(day), (weekday - from_friday).cast("int"))
    steps = from_friday + n
    return F.date_add(base, (n + 2 * F.floor(steps / 5)).cast("int"))


def finality(decided: Column, findings: Column, days: int = 3, hour: int = 16) -> Column:
    """A decision with all findings is final at once, else after open days at a set hour."""
    later = add_business_days(decided, days).cast("timestamp") + F.make_dt_interval(hours=F.lit(hour))
    return F.when(findings, decided).otherwise(later)


def lapsed(approved: Column, permit: Column, months: int, extension: Column, most: int = 18) -> Column:
    """An approval lapses without a permit by its deadline; an extension counts only up to a cap."""
    allowed = F.when(extension.isNotNull() & (extension <= most), extension).otherwise(F.lit(months))
    deadline = F.add_months(approved, allowed)
    return ~F.coalesce(F.to_date(permit) <= deadline, F.lit(False))


def renewable(filed: Column, heard: Column) -> Column:
    """Renewal needs a filed application and a held hearing."""
    return F.coalesce(filed & heard, F.lit(False))


def elapsed_at_least(start: Column, end: Column, days: int = 15) -> Column:
    """At least so many days lie between, the last one included."""
    return F.datediff(end, start) >= days


def is_iso_date(text: Column) -> Column:
    """Exactly YYYY-MM-DD and a day that exists."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text), F.lit(False))


def valid_parts(month: Column, day: Column, hour: Column) -> Column:
    """Parts of a date and time that can occur in any year."""
    longest = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & day.between(1, 31) & (day <= longest) & hour.between(0, 23)


def recovery_years(drop: Column, rate: float) -> Column:
    """Years of growth at a rate that make up for a drop."""
    return F.ln(1 / (1 - drop)) / F.ln(F.lit(1 + rate))


def year_bounds(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(F.year(day)).alias("first"), F.max(F.year(day)).alias("last"))
