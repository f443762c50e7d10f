"""The event log as a table: append with contiguous seqs, replay, tenancy, monthly partitions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("partition_key", T.DateType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("payload_version", T.IntegerType(), False),
        T.StructField("payload", T.StringType(), False),
        T.StructField("occurred_at", T.TimestampType(), False),
        T.StructField("recorded_at", T.TimestampType(), False),
        T.StructField("causation_id", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
    ]
)


def numbered(new: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """``new`` events with the seqs that follow each run's last one in ``log``, of which only the batch's
    runs are added up."""
    last = log.join(new.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id").agg(F.max("seq").alias("last_seq"))
    w = Window.partitionBy("run_id").orderBy(*order)
    return new.join(last, "run_id", "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)) + F.row_number().over(w)).drop("last_seq")


def of_run(log: DataFrame, run_id: str) -> DataFrame:
    """A run's events. The month of its version-7 id names the partition, so only that one is read; of
    another id all are."""
    rows = log.where(F.col("run_id") == run_id)
    hexes = run_id.replace("-", "")
    if len(hexes) != 32 or hexes[12] != "7":
        return rows
    made = datetime.datetime.fromtimestamp(int(hexes[:12], 16) / 1000, datetime.timezone.utc)
    return rows.where(F.col("partition_key") == F.lit(made.date().replace(day=1)))


def conflicts(new: DataFrame, log: DataFrame) -> DataFrame:
    """Events of ``new`` whose (run_id, seq) the log holds already: the batch must not be written."""
    return new.join(log.select("run_id", "seq"), ["run_id", "seq"], "left_semi")


def append(new: DataFrame, path: str) -> None:
    """Write a numbered batch, partitioned by month and sorted by run and seq inside files."""
    (
        new.repartition("partition_key", "run_id")
        .sortWithinPartitions("partition_key", "run_id", "seq")
        .write.mode("append")
        .partitionBy("partition_key")
        .parquet(path)
    )


def replay(log: DataFrame, from_seq: int = 0, to_seq: int | None = None) -> DataFrame:
    """Events after ``from_seq`` and up to ``to_seq`` with it, ordered inside each run."""
    part = log.where(F.col("seq") > from_seq)
    return (part.where(F.col("seq") <= to_seq) if to_seq is not None else part).sortWithinPartitions("run_id", "seq")


def of_tenant(rows: DataFrame, tenant: int | str | None) -> DataFrame:
    """What a tenant may see; without a tenant nothing."""
    return rows.where(F.lit(False)) if tenant is None else rows.where(F.col("tenant_id") == tenant)


def until_terminal(log: DataFrame, after_seq: int = 0) -> DataFrame:
    """Subscription in batch: events after ``after_seq`` up to each run's first terminal event."""
    ends = F.col("event_type").isin("run.succeeded", "run.failed", "run.cancelled")
    last = F.min(F.when(ends, F.col("seq"))).over(Window.partitionBy("run_id"))
    return log.withColumn("end_seq", last).where((F.col("seq") > after_seq) & (F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))).drop("end_seq")


def newest(log: DataFrame, most: int) -> DataFrame:
    """The bounded stream of each run: its newest ``most`` events, exactly."""
    w = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    return log.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def month(moment: Column) -> Column:
    return F.trunc(moment.cast("date"), "month")
