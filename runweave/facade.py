"""The verbs of the control plane over a log table: create, status, cancel, replay, subscribe, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions import ids
from runweave.operators import cost, runs
from runweave.sources import event_log


class Runs:
    """Runs of one tenant in a log table at ``path``; whatever belongs to others is not visible.

    Appends assume one writer at a time: a batch whose (run_id, seq) is taken is refused."""

    def __init__(self, spark: SparkSession, path: str, tenant: str):
        self.spark, self.path, self.tenant = spark, path, tenant

    def log(self) -> DataFrame:
        probe = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = probe.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(probe)
        rows = self.spark.read.schema(event_log.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], event_log.SCHEMA)
        return event_log.of_tenant(rows, self.tenant)

    def append(self, events: DataFrame) -> None:
        """Append (run_id, event_type, payload, occurred_at, order): seqs follow each run's last one."""
        new = event_log.numbered(events, self.log(), ["order"])
        if event_log.conflicts(new, self.log()).limit(1).count():  # reads the log again, so sees what came since
            raise ValueError("another writer has appended to a run of this batch")
        null = F.lit(None).cast("string")
        rows = new.select(
            ids.month_of_run(F.col("run_id"), F.col("occurred_at")).alias("partition_key"), "run_id", F.col("seq").cast("long").alias("seq"),
            ids.uuid7(F.unix_millis("occurred_at"), F.concat_ws(":", "run_id", "seq")).alias("event_id"), F.lit(self.tenant).alias("tenant_id"),
            "event_type", F.lit(1).alias("payload_version"), "payload", "occurred_at", F.current_timestamp().alias("recorded_at"), null.alias("causation_id"), null.alias("correlation_id"),
        )
        event_log.append(rows, self.path)

    def create_runs(self, requests: DataFrame) -> None:
        """Create a run for each (run_id, payload, occurred_at); an id that is there already is refused."""
        if requests.join(self.log().select("run_id"), "run_id", "left_semi").limit(1).count():
            raise ValueError("a run of this batch exists")
        self.append(requests.withColumns({"event_type": F.lit("run.created"), "order": F.lit(0)}))

    def states(self) -> DataFrame:
        return runs.folded(self.log())

    def get_run(self, run_id: str) -> DataFrame:
        """Its state; no row if the tenant has no such run."""
        return runs.folded(event_log.of_run(self.log(), run_id))

    def cancel_runs(self, run_ids: DataFrame) -> None:
        """Append a cancellation to each (run_id, occurred_at) that is pending or running; others are left."""
        open_ = self.states().where("status in ('pending', 'running')").select("run_id")
        self.append(run_ids.join(open_, "run_id", "left_semi").withColumns({"event_type": F.lit("run.cancelled"), "payload": F.lit('{"reason": "cancelled"}'), "order": F.lit(0)}))

    def replay(self, run_id: str, from_seq: int = 0, to_seq: int | None = None) -> DataFrame:
        return event_log.replay(event_log.of_run(self.log(), run_id), from_seq, to_seq).orderBy("seq")

    def subscribe(self, run_id: str, after_seq: int = 0) -> DataFrame:
        return event_log.until_terminal(event_log.of_run(self.log(), run_id), after_seq).orderBy("seq")


class Ledger:
    """Cost of runs, nodes and tenants over a ledger of priced calls."""

    def __init__(self, calls: DataFrame):
        self.calls = calls

    def run_cost(self, run_id) -> DataFrame:
        return self.calls.where(F.col("run_id") == run_id).agg(*cost.summary())

    def node_cost(self, run_id, node_id) -> DataFrame:
        return self.calls.where((F.col("run_id") == run_id) & (F.col("node_id") == node_id)).agg(*cost.summary())

    def tenant_cost(self, tenant_id) -> DataFrame:
        return self.calls.where(F.col("tenant_id") == tenant_id).agg(*cost.summary())
