"""Tool calls by idempotency key, and what to do with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resolved(log: DataFrame) -> DataFrame:
    """Per key: the tool that its last request names (null without one), which events it has and the
    last completion's result."""
    has = lambda t: F.bool_or(F.col("event_type") == f"tool.{t}").alias(t)
    at = lambda t, c: F.max_by(F.when(F.col("event_type") == f"tool.{t}", F.col(c)), F.when(F.col("event_type") == f"tool.{t}", F.col("seq")))
    return log.groupBy("idempotency_key").agg(at("requested", "tool").alias("tool"), has("requested"), has("completed"), has("failed"), has("indeterminate"), at("completed", "result").alias("result"))


def outcomes(keys: DataFrame, specs: DataFrame) -> DataFrame:
    """completed > indeterminate > failed > in flight; a call in flight is sent again only if its
    tool is idempotent; a tool without a spec is unknown."""
    known = keys.join(F.broadcast(specs), "tool", "left")
    outcome = (
        F.when(F.col("completed"), "reused")
        .when(F.col("indeterminate"), "indeterminate")
        .when(F.col("failed"), "failed")
        .when(F.col("requested"), F.when(F.coalesce("idempotency", F.lit("unknown")) == "idempotent", "redispatch").otherwise("mark_indeterminate"))
        .otherwise("fresh")
    )
    return known.select("idempotency_key", "tool", outcome.alias("outcome"))


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("t0", "idempotent"), ("t1", "non_idempotent")], "tool string, idempotency string")


def intent_violations(log: DataFrame) -> DataFrame:
    """Keys that were resolved before they were requested, never requested, or resolved more than once."""
    asked = F.col("event_type") == "tool.requested"
    per_key = log.groupBy("idempotency_key").agg(F.min(F.when(asked, F.col("seq"))).alias("asked"), F.min(F.when(~asked, F.col("seq"))).alias("answered"), F.sum((~asked).cast("int")).alias("answers"))
    return per_key.where("answers > 0 and (asked is null or answered < asked or answers > 1)").select("idempotency_key", F.col("answers").cast("long").alias("answers"))
