"""Checks whose violations are rows; a clean table gives none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrework.functions.scalars import holds


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The frame itself, or an error naming some keys that occur twice."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys occur more than once: {[tuple(r)[:-1] for r in twice]}")
    return df


def assert_single_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The frame itself, or an error if a key has two different values."""
    mixed = df.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high")).filter("low <> high").limit(5).collect()
    if mixed:
        raise ValueError(f"keys with conflicting {value}: {[r[0] for r in mixed]}")
    return df


def contract_faults(df: DataFrame, key: str, required: Sequence[str], valid: dict[str, Column], most_per_key: int = 1) -> DataFrame:
    """Rows that break a contract, each with the name of its first fault.

    Faults are tested in order: blank required texts, failed conditions (null fails), too many rows of one key.
    """
    repeated = df.groupBy(key).count().filter(F.col("count") > most_per_key).select(F.col(key).alias("_k"), F.lit(True).alias("_repeated"))
    fault = F.lit(None).cast("string")
    fault = F.when(holds(F.col("_repeated")), "repeated")
    for name, condition in reversed(list(valid.items())):
        fault = F.when(~holds(condition), name).otherwise(fault)
    for name in reversed(list(required)):
        fault = F.when(F.coalesce(F.trim(name), F.lit("")) == "", name).otherwise(fault)
    joined = df.join(repeated, F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn("fault", fault).filter("fault IS NOT NULL").drop("_k", "_repeated")


def crosswalk_faults(items: DataFrame, crosswalk: DataFrame, key: str) -> DataFrame:
    """Keys not classified, classified twice, or classified without being there; all keys right gives no row."""
    classes = crosswalk.groupBy(key).count()
    known = items.select(key).distinct()
    missing = known.join(classes, key, "left_anti").select(key, F.lit("unclassified").alias("fault"))
    unknown = classes.join(known, key, "left_anti").select(key, F.lit("unknown").alias("fault"))
    return missing.union(unknown).union(classes.filter("count > 1").select(key, F.lit("twice").alias("fault")))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, labelled; equal sets give no row."""
    return left.exceptAll(right).distinct().withColumn("side", F.lit("left")).union(right.exceptAll(left).distinct().withColumn("side", F.lit("right")))
