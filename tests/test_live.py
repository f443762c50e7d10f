"""The live tail over several batches: repeated and late events."""

import datetime

from runweave.streaming import live

SCHEMA = "run_id long, seq long, event_type string, occurred_at timestamp"


def test_a_tail_passes_each_event_once_and_keeps_late_ones(spark, tmp_path):
    """Late events come in a batch of their own, after the watermark of the batch before would have left them out."""
    day = lambda n: datetime.datetime(2024, 1, n)
    batches = [[(1, 4, "a", day(10)), (1, 4, "a", day(10)), (1, 2, "a", day(10))], [(2, 4, "b", day(1)), (1, 5, "b", day(10))], [(1, 4, "a", day(10)), (2, 4, "b", day(1)), (2, 5, "c", day(20)), (2, 5, "c", day(20))], [(3, 9, "d", None), (3, 9, "d", None)]]
    path = str(tmp_path / "log")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).where("seq > 3")
    rows = live.drained(stream, once=["run_id", "seq"])
    assert sorted((r["run_id"], r["seq"], r["event_type"]) for r in rows.collect()) == [(1, 4, "a"), (1, 5, "b"), (2, 4, "b"), (2, 5, "c"), (3, 9, "d")]


def test_a_tail_keeps_no_state(spark, tmp_path):
    spark.createDataFrame([(1, 4, "a", None)], SCHEMA).write.parquet(str(tmp_path / "log"))
    stream = live.follow(spark, str(tmp_path / "log"), SCHEMA)
    assert "Deduplicate" not in stream._jdf.queryExecution().logical().toString()
