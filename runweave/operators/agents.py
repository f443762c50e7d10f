"""Reflection rounds of a critic over proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def critiqued(proposals: DataFrame, least: int, even: bool = True) -> DataFrame:
    """(key, round, value) with ``violations``: the names of the constraints that a value breaks."""
    checks = [F.when(F.col("value") < least, F.lit("too_small"))] + ([F.when(F.col("value") % 2 != 0, F.lit("odd"))] if even else [])
    return proposals.withColumn("violations", F.array_compact(F.array(*checks)))


def rounds(critiques: DataFrame, max_depth: int) -> DataFrame:
    """Per key: rounds until the first proposal without violations, and whether one came in time."""
    passed = F.min(F.when(F.size("violations") == 0, F.col("round")))
    per_key = critiques.where(F.col("round") <= max_depth).groupBy("key").agg(passed.alias("passed"), F.max("round").alias("last"))
    return per_key.select("key", (F.coalesce("passed", "last") + 1).cast("long").alias("rounds"), F.col("passed").isNotNull().alias("converged"))
