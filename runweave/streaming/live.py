"""Structured Streaming over the event log: a live tail and run states kept by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.sources.staging import shared_dir


def stored(log: DataFrame) -> str:
    """Write a log as files that a stream can follow."""
    path = shared_dir(log.sparkSession)
    log.write.parquet(path)
    return path


def follow(spark: SparkSession, path: str, schema, after_seq: int = 0) -> DataFrame:
    """The stream of events after ``after_seq``; ``drained`` lets one that comes twice pass once."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("seq") > after_seq)


def unseen(batch: DataFrame, earlier: DataFrame | None, keys: list[str], at: str) -> DataFrame:
    """The rows of a batch, one for each key, whose key no row ``earlier`` has that lies a day at most from
    the batch's event time ``at``. No state of the stream is kept for that: keys are sorted, which spills,
    and of what was written only those days are read. A late event passes."""
    once = batch.repartition(*keys).dropDuplicates(keys)
    if earlier is None:
        return once
    first, last = batch.agg(F.min(at), F.max(at)).first()
    day = F.expr("interval 1 day")
    near = earlier.where(F.col(at).isNull() | F.col(at).between(F.lit(first) - day, F.lit(last) + day)) if first is not None else earlier
    return once.join(near.select(*keys), keys, "left_anti")


def drained(stream: DataFrame, mode: str = "append", once: list[str] | None = None, at: str = "occurred_at") -> DataFrame:
    """Run a stream over what is there and return all that it wrote, each batch in a folder of its own
    that a repeated batch overwrites; ``mode`` is the stream's output mode. With keys in ``once``, rows
    whose keys were written before, in event time ``at`` within a day, are left out."""
    spark = stream.sparkSession
    out = shared_dir(spark)

    def write(batch: DataFrame, number: int) -> None:
        if once:
            earlier = [f"{out}/batch={i}" for i in range(number)]  # without what a failed run of this batch left
            batch = unseen(batch, spark.read.schema(stream.schema).parquet(*earlier) if earlier else None, once, at)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", out).parquet(out).select(stream.columns)


def states(stream: DataFrame) -> DataFrame:
    """run_id, day, last_seq, and seq and type of the last lifecycle event, of each run and day of its
    events, to be written in update mode: a batch writes what it changed, and the state of a day
    leaves when the watermark has passed it. ``merged`` makes run states of it."""
    life = F.when(F.col("event_type").startswith("run."), F.struct("seq", "event_type"))
    days = stream.withWatermark("occurred_at", "1 day").groupBy("run_id", F.window("occurred_at", "1 day").alias("day"))
    return days.agg(F.max("seq").alias("last_seq"), F.max(life).alias("life")).select("run_id", F.col("day.start").alias("day"), "last_seq", "life")


def merged(updates: DataFrame) -> DataFrame:
    """run_id, last_seq and the type of the last lifecycle event, from all updates."""
    return updates.groupBy("run_id").agg(F.max("last_seq").alias("last_seq"), F.max("life")["event_type"].alias("last_lifecycle"))
