"""Snapshots: a cache of run states, keyed by run and seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.operators.runs import LIFECYCLE


def due(heads: DataFrame, stored: DataFrame, every: int) -> DataFrame:
    """``heads`` (run_id, last_seq) with ``at_seq`` of the newest stored snapshot and whether another is
    due: the run has gone on by ``every`` events and more since then, or since its begin."""
    if every < 1:
        raise ValueError("every must be at least 1")
    newest = stored.groupBy("run_id").agg(F.max("at_seq").alias("at_seq"))
    return heads.join(newest, "run_id", "left").withColumn("due", F.col("last_seq") - F.coalesce("at_seq", F.lit(0)) >= every)


def taken(log: DataFrame, every: int) -> DataFrame:
    """(run_id, at_seq, status, last_lifecycle_seq): what the policy, asked after each event of a log with
    contiguous seqs, would have saved. One window carries the state along, over a run's lifecycle events and
    the seqs at which it is saved; the others are left out before the sort."""
    if every < 1:
        raise ValueError("every must be at least 1")
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    life = F.when(F.col("event_type").isin(*LIFECYCLE), F.struct("event_type", "seq"))
    log = log.where(F.col("event_type").isin(*LIFECYCLE) | (F.col("seq") % every == 0))
    seen = log.select("run_id", "seq", F.last(life, ignorenulls=True).over(w).alias("at")).where(F.col("seq") % every == 0)
    name = F.when(F.col("at.event_type") == "run.created", "pending").when(F.col("at.event_type") == "run.started", "running").otherwise(F.regexp_replace("at.event_type", "run\\.", ""))
    return seen.select("run_id", F.col("seq").alias("at_seq"), name.alias("status"), F.col("at.seq").alias("last_lifecycle_seq"))


def saved(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` and those of ``new`` whose (run_id, at_seq) is not there: the first write wins."""
    w = Window.partitionBy("run_id", "at_seq").orderBy("written")
    once = new.join(stored, ["run_id", "at_seq"], "left_anti").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return stored.unionByName(once)


def latest(stored: DataFrame) -> DataFrame:
    """The newest snapshot of each run, in its columns."""
    rest = [c for c in stored.columns if c not in ("run_id", "at_seq")]
    newest = stored.groupBy("run_id").agg(F.max(F.struct("at_seq", *rest)).alias("s"))
    return newest.select("run_id", *[f"s.{c}" for c in ("at_seq", *rest)])


def pruned(stored: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` snapshots of each run."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    w = Window.partitionBy("run_id").orderBy(F.desc("at_seq"))
    return stored.withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).drop("k")
