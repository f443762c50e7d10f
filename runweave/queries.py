"""Every registered query of the event-log operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.functions import egress, ids
from runweave.operators import agents, cost, dag, registry, runs, snapshots, tools
from runweave.plans import readonly
from runweave.sources import event_log, staging
from runweave.sources import fixtures as fx
from runweave.sqls import READONLY
from runweave.streaming import live

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return cost.priced(fx.llm_calls(spark, d), cost.price_book(spark, fx.PRICES))


# --- the log -------------------------------------------------------------------------------------


@query
def event_replay(spark, d):
    return _long(event_log.replay(fx.run_events(spark, d), 1, 6).select("run_id", "seq", "event_type"), "run_id", "seq")


@query
def event_append_and_read(spark, d):
    """Events written as a table of months and read back, of the runs of one month."""
    log = fx.run_events(spark, d)
    millis = F.unix_millis(F.col("t0").cast("timestamp"))
    rows = log.select(ids.month_of_run(ids.uuid7(millis, F.col("run_id")), F.col("t0")).alias("partition_key"), "run_id", F.col("seq").cast("long").alias("seq"), "event_type")
    path = staging.shared_dir(spark)
    event_log.append(rows, path)
    back = spark.read.schema(rows.schema).parquet(path).where("partition_key = date'1995-03-01'")
    return back.groupBy("run_id").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"))


@query
def batch_seq_assignment(spark, d):
    log = fx.run_events(spark, d)
    new = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), "l_returnflag").agg(F.count("*").alias("n"))
    return _long(event_log.numbered(new, log, ["l_returnflag"]).select("run_id", "l_returnflag", "seq"), "seq")


@query
def event_conflicts(spark, d):
    log = fx.run_events(spark, d)
    new = log.where("event_type = 'run.started'").select("run_id", (F.col("seq") + F.col("run_id") % 9).alias("seq"))
    return _long(event_log.conflicts(new, log).groupBy("run_id").agg(F.max("seq").alias("seq")), "seq")


def _payloads(spark, d):
    """Payloads of both versions, some of them broken in one of the ways that a registry tells apart."""
    e = fx.table(spark, d, "events")
    version = F.when(F.col("event_id") % 51 == 0, 3).otherwise(1 + F.col("event_id") % 2).cast("int")
    k = F.get_json_object("props", "$.k")
    count = F.when(version == 2, F.lit(', "count": 5')).otherwise(F.lit(""))
    extra = F.when(F.col("event_id") % 50 == 0, F.lit(', "extra": {"x": 1}')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"k": '), k, count, extra, F.lit("}"))
    body = F.when(F.col("event_id") % 53 == 0, F.lit("{}")).when(F.col("event_id") % 59 == 0, F.concat(F.lit('{"k": {"x": "}"}'), count, F.lit("}"))).when(F.col("event_id") % 61 == 0, F.lit("not json")).when(F.col("event_id") % 67 == 0, F.lit(None)).otherwise(body)
    return e.select("event_id", "event_type", body.alias("payload"), version.alias("payload_version"))


@query
def decode_events(spark, d):
    ok = registry.counted_registry().decoded(_payloads(spark, d)).where("decode_error is null")
    fields = F.from_json("payload", "k bigint, count bigint")
    return ok.select("event_id", "event_type", fields["k"].alias("k"), fields["count"].alias("n"))


@query
def decode_quarantine(spark, d):
    rows = registry.counted_registry().decoded(_payloads(spark, d))
    return rows.groupBy(F.coalesce("decode_error", F.lit("ok")).alias("decode_error")).agg(F.count("*").alias("n"))


@query
def upcast_payload(spark, d):
    rows = registry.counted_registry().decoded(_payloads(spark, d)).where("payload_version = 1 and decode_error is null")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("payload", "$.k").cast("long")).alias("sum_k"), F.sum(F.get_json_object("payload", "$.count").cast("long")).alias("sum_count"))


@query
def payload_unknown_fields(spark, d):
    rows = registry.counted_registry().decoded(_payloads(spark, d)).where("decode_error = 'unknown_field'")
    return rows.select("event_id", F.explode("unknown_fields").alias("unknown_field"))


@query
def event_current_version(spark, d):
    types = fx.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return types.select("event_type", registry.counted_registry().current_version(F.col("event_type")).cast("long").alias("version"), "n")


@query
def event_schema_catalog(spark, d):
    seen = fx.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    rows = registry.counted_registry().catalog(spark).join(seen, "event_type", "left")
    return rows.select("event_type", F.col("version").cast("long").alias("version"), "field", "type", F.coalesce("n", F.lit(0)).alias("n"))


@query
def stream_bounded_window(spark, d):
    return _long(event_log.newest(fx.run_events(spark, d), 5).select("run_id", "seq", "event_type"), "run_id", "seq")


def _stream(spark, d):
    log = fx.run_events(spark, d).select("run_id", F.col("seq").cast("long").alias("seq"), "event_type", F.col("t0").cast("timestamp").alias("occurred_at"))
    return live.stored(log), log.schema


@query
def stream_tail(spark, d):
    rows = live.drained(live.follow(spark, *_stream(spark, d), after_seq=3), once=["run_id", "seq"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("seq").alias("sum_seq"))


@query
def stream_run_state(spark, d):
    path, schema = _stream(spark, d)
    return live.merged(live.drained(live.states(spark.readStream.schema(schema).parquet(path)), "update")).select("run_id", "last_seq", "last_lifecycle")


@query
def subscribe_events(spark, d):
    return _long(event_log.until_terminal(fx.run_events(spark, d), 2).groupBy("run_id").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq")), "last_seq")


@query
def partition_month(spark, d):
    o = fx.table(spark, d, "orders")
    return o.groupBy(ids.month_of(F.col("o_orderdate")).alias("partition_key")).agg(F.count("*").alias("runs"), F.min("o_orderkey").alias("first_run"))


@query
def retention_partitions(spark, d):
    o = fx.table(spark, d, "orders").select(ids.month_of(F.col("o_orderdate")).alias("partition_key"))
    newest = o.agg(F.max("partition_key").alias("newest"))
    months = o.groupBy("partition_key").agg(F.count("*").alias("runs"))
    return months.join(F.broadcast(newest), F.col("partition_key") < F.add_months("newest", -12)).select("partition_key", "runs")


@query
def unprovisioned_partitions(spark, d):
    o = fx.table(spark, d, "orders").select(ids.month_of(F.col("o_orderdate")).alias("partition_key"))
    first = o.agg(F.min("partition_key").alias("first"))
    provisioned = first.select(F.explode(F.sequence("first", F.add_months("first", 12), F.expr("interval 1 month"))).alias("partition_key"))
    return o.groupBy("partition_key").agg(F.count("*").alias("runs")).join(provisioned, "partition_key", "left_anti")


def _ids(spark, d):
    e = fx.table(spark, d, "events")
    millis = F.unix_millis(F.to_timestamp(F.lit("2024-01-01 00:00:00+00:00"))) + F.col("event_id") * 1009
    return e.select("event_id", millis.alias("millis"), ids.uuid7(millis, F.col("event_id")).alias("id"))


@query
def uuid7_encode(spark, d):
    rows = _ids(spark, d)
    return rows.select("event_id", F.length("id").cast("long").alias("length"), F.substring("id", 1, 13).alias("time_part"), F.substring("id", 15, 1).alias("version"), F.substring("id", 20, 1).isin("8", "9", "a", "b").alias("variant_ok"))


@query
def uuid7_decode(spark, d):
    return _ids(spark, d).select("event_id", ids.uuid7_millis(F.col("id")).alias("millis"))


@query
def tenant_isolation(spark, d):
    rows = event_log.of_tenant(fx.run_events(spark, d), 3)
    return rows.groupBy("tenant_id", "event_type").agg(F.count("*").alias("n"))


@query
def tenant_unset(spark, d):
    return event_log.of_tenant(fx.run_events(spark, d), None).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query
def tenant_write_violations(spark, d):
    new = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 16).alias("tenant_id"), (F.col("o_orderkey") % 16).alias("writer"))
    return new.where("tenant_id <> writer").groupBy("writer").agg(F.count("*").alias("n"))


@query
def tenant_ownership(spark, d):
    own = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 16).alias("tenant_id")).where("tenant_id = 5")
    asked = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id")).distinct()
    return asked.join(own, "run_id", "left_semi")


# --- runs ----------------------------------------------------------------------------------------


@query
def run_state_fold(spark, d):
    log = fx.run_events(spark, d)
    tenants = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 16).alias("tenant_id"))
    return runs.folded(log).join(tenants, "run_id").groupBy("tenant_id", "status").agg(F.count("*").alias("runs"), F.sum("last_seq").cast("long").alias("events"))


@query
def run_states_of_raw_logs(spark, d):
    return _long(runs.folded(fx.lifecycles(spark, d)), "last_seq", "last_lifecycle_seq", "illegal_seq")


@query
def run_transitions(spark, d):
    return runs.transitions(fx.run_events(spark, d))


@query
def run_terminal_counts(spark, d):
    return runs.folded(fx.run_events(spark, d)).groupBy(runs.is_terminal(F.col("status")).alias("terminal")).agg(F.count("*").alias("n"))


@query
def run_invalid_transitions(spark, d):
    """The first illegal seq of each run, the state it met, and the types that events have there."""
    log = fx.lifecycles(spark, d)
    bad = runs.folded(log).where("illegal_seq is not null").select("run_id", "status", F.col("illegal_seq").alias("seq"))
    there = log.join(bad, ["run_id", "seq"]).groupBy("run_id", "seq", "status").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("event_types"))
    return _long(there, "seq")


@query
def duplicate_runs(spark, d):
    return fx.lifecycles(spark, d).where("event_type = 'run.created'").groupBy("run_id").agg(F.count("*").alias("created")).where("created > 1")


@query
def runs_projection(spark, d):
    return _long(runs.folded(fx.run_events(spark, d)).select("run_id", "status", "last_seq"), "last_seq")


@query
def run_status_view(spark, d):
    return _long(runs.folded(fx.run_events(spark, d)).select("run_id", "status", "last_lifecycle_seq"), "last_lifecycle_seq")


@query
def run_states(spark, d):
    states = runs.folded(fx.run_events(spark, d)).drop("illegal_seq")
    return _long(states, "last_seq", "last_lifecycle_seq", "created_at", "started_at", "finished_at")


@query
def find_pending(spark, d):
    o = fx.table(spark, d, "orders")
    expires = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_orderkey") % 7)
    rows = o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 16).alias("tenant_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), expires.alias("expires_at"), F.lit(3).alias("as_of"))
    return runs.pending_first(rows)


@query
def cancel_requested(spark, d):
    return fx.table(spark, d, "events").groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 90)).alias("cancel_requested"))


@query
def lease_acquisition(spark, d):
    e = fx.table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).cast("timestamp"))
    ttl = F.when(F.col("event_id") % 2 == 0, 300_000_000).otherwise(86_400_000_000)
    rows = e.select(F.col("user_id").alias("run_id"), at.alias("at"), F.col("event_id").alias("order"), F.col("event_type").alias("worker"), ttl.cast("long").alias("ttl"))
    return runs.leases(rows).select("run_id", "token", "owner", F.col("until").alias("until_micros"))


@query
def stale_lease_appends(spark, d):
    return runs.stale_appends(fx.fenced(spark, d)).groupBy("run_id").agg(F.count("*").alias("stale"), F.min("seq").alias("first_stale"), F.max(F.col("current").cast("long")).alias("last_token"))


# --- snapshots -----------------------------------------------------------------------------------


def _snapshots(spark, d):
    return snapshots.taken(fx.run_events(spark, d), 4)


@query
def snapshot_due(spark, d):
    """Whether a run that has snapshots of every sixth event at most is due for one after four more."""
    log = fx.run_events(spark, d)
    heads = log.groupBy("run_id").agg(F.max("seq").alias("last_seq"))
    return _long(snapshots.due(heads, snapshots.taken(log, 6), 4), "last_seq", "at_seq")


@query
def snapshot_save(spark, d):
    s = _snapshots(spark, d).withColumn("written", F.lit(1))
    again = s.where("at_seq <= 8").withColumns({"status": F.lit("late"), "written": F.lit(2)})
    first = s.where("at_seq % 8 = 0")
    return snapshots.saved(first, again).groupBy("status", "written").agg(F.count("*").alias("n")).select("status", F.col("written").cast("long").alias("written"), "n")


@query
def snapshot_latest(spark, d):
    return _long(snapshots.latest(_snapshots(spark, d)), "at_seq", "last_lifecycle_seq")


@query
def snapshot_prune(spark, d):
    return _long(snapshots.pruned(_snapshots(spark, d), 2).select("run_id", "at_seq"), "at_seq")


@query
def run_state_from_snapshot(spark, d):
    return _long(runs.resumed(snapshots.latest(_snapshots(spark, d)), fx.run_events(spark, d)).drop("illegal_seq"), "last_seq")


@query
def snapshot_equivalence(spark, d):
    """By status, the runs whose state from a snapshot is that of the full fold, and those where not."""
    log = fx.run_events(spark, d)
    whole = runs.folded(log).select("run_id", "status", "last_seq")
    part = runs.resumed(snapshots.latest(_snapshots(spark, d)), log).select("run_id", F.col("status").alias("other"), F.col("last_seq").alias("other_seq"))
    same = F.col("status").eqNullSafe(F.col("other")) & (F.col("last_seq") == F.col("other_seq"))
    return whole.join(part, "run_id", "full").groupBy("status").agg(F.count_if(same).alias("same"), F.count_if(~F.coalesce(same, F.lit(False))).alias("different"))


# --- task graphs ---------------------------------------------------------------------------------


@query
def dag_nodes(spark, d):
    return _long(dag.nodes(fx.run_events(spark, d)), "added_seq", "attempt", "failed_attempt", "node_id", "reflection_depth")


@query
def dag_edges(spark, d):
    return _long(dag.edges(fx.run_events(spark, d)), "from_node", "to_node", "seq")


def _odd_log(spark, d):
    """A log with nodes that are added twice or named before they are added, in events and by edges."""
    e = fx.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "node.added").when(F.col("event_type") == "error", "edge.added").otherwise("node.started")
    node, none = F.col("event_id") % 11, F.lit(None).cast("long")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("event_type"), F.when(kind != "edge.added", node).alias("node_id"),
        F.when(kind == "node.added", F.array((F.col("event_id") + 3) % 11)).alias("dependencies"), F.when(kind == "edge.added", node).otherwise(none).alias("from_node"),
        F.when(kind == "edge.added", (F.col("event_id") + 5) % 11).otherwise(none).alias("to_node"), F.lit("reject").alias("edge_type"),
    )


@query
def dag_duplicate_nodes(spark, d):
    return dag.duplicates(_odd_log(spark, d))


@query
def dag_unknown_nodes(spark, d):
    return dag.unknown(_odd_log(spark, d))


@query
def dag_reachability(spark, d):
    return dag.reachable(fx.run_events(spark, d)).groupBy("run_id").agg(F.count("*").alias("pairs"), F.sum(F.col("from_node") * 31 + F.col("to_node")).cast("long").alias("mark"))


@query
def dag_cycles(spark, d):
    """Two edges more for every run: from its first node to its last, a dependency in every other run, and back."""
    log = fx.run_events(spark, d)
    ends = log.groupBy("run_id").agg(F.max("seq").alias("last"), F.max("node_id").alias("node")).where("node is not null")
    first = ends.select("run_id", (F.col("last") + 1).alias("seq"), F.lit("edge.added").alias("event_type"), F.lit(0).alias("from_node"), F.col("node").alias("to_node"), F.when(F.col("run_id") % 2 == 0, "dependency").otherwise("reflection").alias("edge_type"))
    back = ends.select("run_id", (F.col("last") + 2).alias("seq"), F.lit("edge.added").alias("event_type"), F.col("node").alias("from_node"), F.lit(0).alias("to_node"), F.lit("dependency").alias("edge_type"))
    return _long(dag.cyclic(log.unionByName(first, True).unionByName(back, True)), "seq", "from_node", "to_node")


@query
def dag_levels(spark, d):
    return _long(dag.levels(fx.run_events(spark, d)), "node_id", "level")


@query
def dag_ready_set(spark, d):
    log = fx.run_events(spark, d)
    return _long(dag.ready(dag.nodes(log), dag.edges(log)), "node_id")


@query
def dag_outcome(spark, d):
    log = fx.run_events(spark, d)
    return dag.outcomes(log, dag.nodes(log)).groupBy("outcome").agg(F.count("*").alias("n"))


@query
def dag_dispatchable(spark, d):
    log = fx.run_events(spark, d)
    return _long(dag.dispatchable(dag.nodes(log), dag.edges(log)), "node_id", "next_attempt")


@query
def next_attempt(spark, d):
    log = fx.run_events(spark, d)
    return dag.dispatchable(dag.nodes(log), dag.edges(log)).groupBy(F.col("next_attempt").cast("long").alias("next_attempt")).agg(F.count("*").alias("n"))


@query
def dag_deadlocks(spark, d):
    log = fx.run_events(spark, d).where("not (event_type = 'node.started' and run_id % 4 = 0)")
    log = log.withColumn("event_type", F.when((F.col("run_id") % 4 == 0) & (F.col("event_type") == "node.succeeded"), "node.skipped").otherwise(F.col("event_type")))
    return dag.deadlocks(log, dag.nodes(log), dag.edges(log))


@query
def node_inputs(spark, d):
    log = fx.run_events(spark, d)
    return _long(dag.inputs(dag.nodes(log), dag.edges(log)), "node_id", "dependency")


@query
def run_failure_cause(spark, d):
    return _long(dag.failure_cause(dag.nodes(fx.run_events(spark, d))), "node_id", "attempt")


@query
def cancelled_skips(spark, d):
    log = fx.run_events(spark, d)
    over = runs.folded(log).where("status = 'cancelled'").select("run_id")
    return dag.nodes(log).where("status = 'skipped'").join(over, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("skipped"))


def _failures(spark, d):
    return fx.run_events(spark, d).where("event_type = 'node.failed'").select("run_id", "node_id", "attempt", "error_class")


@query
def error_categories(spark, d):
    return _failures(spark, d).groupBy("error_class", dag.category(F.col("error_class")).alias("category")).agg(F.count("*").alias("n"))


@query
def retry_decision(spark, d):
    f = _failures(spark, d)
    again = dag.retries(F.col("error_class"), F.col("error_class") != "ValueError", F.col("attempt"), 2, ("retryable", "terminal"))
    return f.groupBy("error_class", F.col("attempt").cast("long").alias("attempt"), again.alias("retry")).agg(F.count("*").alias("n"))


@query
def node_failures_by_class(spark, d):
    return _failures(spark, d).groupBy("error_class").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"))


def _spawns(spark, d):
    c = fx.table(spark, d, "conversations").where("role = 'assistant'")
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("node_id"), (F.col("turn") % 5).alias("depth"), (F.length("text") % 3).cast("long").alias("children"))


@query
def reflection_violations(spark, d):
    return _spawns(spark, d).where("children > 0 and depth + 1 > 3").select("run_id", "node_id", (F.col("depth") + 1).alias("depth"))


@query
def node_expansion(spark, d):
    s = _spawns(spark, d).where("children > 0 and depth + 1 <= 3")
    return s.select("run_id", "node_id", F.explode(F.sequence(F.lit(1).cast("long"), "children")).alias("child"), (F.col("depth") + 1).alias("depth"))


@query
def node_concurrency(spark, d):
    return _long(dag.concurrency(fx.run_events(spark, d)), "most")


@query
def spans(spark, d):
    return _long(dag.spans(fx.run_events(spark, d)), "node_id", "attempt", "start_seq", "end_seq")


# --- cost ----------------------------------------------------------------------------------------


@query
def llm_call_cost(spark, d):
    return _ledger(spark, d).where("cost_usd is not null").select("run_id", "call_no", "cost_usd")


@query
def unpriced_calls(spark, d):
    prices = cost.price_book(spark, fx.PRICES)
    return fx.llm_calls(spark, d).join(F.broadcast(prices), ["provider", "model"], "left_anti").groupBy("provider", "model").agg(F.count("*").alias("n"))


@query
def run_cost(spark, d):
    return cost.by(_ledger(spark, d).where("cost_usd is not null"), "run_id")


@query
def node_cost(spark, d):
    return cost.by(_ledger(spark, d).where("cost_usd is not null"), "run_id", "node_id")


@query
def tenant_cost(spark, d):
    return cost.by(_ledger(spark, d).where("cost_usd is not null"), "tenant_id")


@query
def cost_summary_empty(spark, d):
    """The summary of each tenant's unpriced calls, zero for the most part, beside the number of its runs."""
    rows = _ledger(spark, d)
    return rows.groupBy("tenant_id").agg(F.countDistinct("run_id").alias("runs")).join(rows.where("cost_usd > 1000").groupBy("tenant_id").agg(*cost.summary()), "tenant_id", "left").select(
        "tenant_id", "runs", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("cost_usd", "decimal(20,10)"), ("total_tokens", "long"), ("calls", "long"))]
    )


@query
def cost_rollup(spark, d):
    return cost.levels(_ledger(spark, d).where("cost_usd is not null"))


@query
def cost_by_model(spark, d):
    return cost.by(_ledger(spark, d).where("cost_usd is not null"), "provider", "model")


@query
def budget_violations(spark, d):
    """Per run and node the first call over 4,000 tokens or 12 dollars, the calls over, and the limit it broke."""
    calls = fx.llm_calls_big(spark, d).withColumn("cost_usd", (F.col("output_tokens").cast("decimal(12,0)") * F.lit("0.002").cast("decimal(4,3)")).cast("decimal(20,10)"))
    over = cost.over_budget(calls, ["run_id", "node_id"], ["call_no"], 4_000, "12")
    first = F.min(F.struct("call_no", "limit", "spent_tokens", "spent_usd")).alias("f")
    out = over.groupBy("run_id", "node_id").agg(F.count("*").alias("calls"), first).select("run_id", "node_id", "calls", "f.call_no", "f.limit", "f.spent_tokens", F.col("f.spent_usd").cast("decimal(20,10)").alias("spent_usd"))
    return _long(out, "call_no")


@query
def ledger_append(spark, d):
    """Priced calls appended to a ledger by month, and summed up from there."""
    path = staging.shared_dir(spark)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("run_id") * 3_600 + F.col("call_no"))
    cost.record(_ledger(spark, d).where("cost_usd is not null").withColumns({"created_at": at, "latency_ms": F.lit(12)}), path)
    return cost.by(cost.ledger(spark, path), "tenant_id", "provider")


# --- tools ---------------------------------------------------------------------------------------


@query
def idempotency_keys(spark, d):
    parts = ids.key_parts(F.col("idempotency_key"))
    return fx.tool_log(spark, d).groupBy(parts[1].cast("long").alias("node"), parts[3].cast("long").alias("call_index")).agg(F.count("*").alias("n"), F.countDistinct("idempotency_key").alias("keys"))


@query
def tool_call_resolution(spark, d):
    return tools.resolved(fx.tool_log(spark, d))


def _outcomes(spark, d):
    return tools.outcomes(tools.resolved(fx.tool_log(spark, d)), tools.specs(spark))


@query
def tool_call_outcome(spark, d):
    return _outcomes(spark, d)


@query
def tool_recovery_plan(spark, d):
    return _outcomes(spark, d).where("outcome in ('redispatch', 'mark_indeterminate')").groupBy("tool", "outcome").agg(F.count("*").alias("n"))


@query
def tool_in_flight(spark, d):
    return tools.resolved(fx.tool_log(spark, d)).where("requested and not completed and not failed and not indeterminate").select("idempotency_key")


@query
def tool_intent_violations(spark, d):
    return tools.intent_violations(fx.tool_log(spark, d))


def _allowed(spark, d):
    pages = fx.table(spark, d, "pages").withColumn("host", egress.host(F.col("url")))
    hosts = pages.where("page_id < 20").select("host").distinct()
    return pages, pages.where(egress.scheme(F.col("url")).isin("http", "https")).join(F.broadcast(hosts), "host", "left_semi")  # 20 hosts at most


@query
def egress_policy(spark, d):
    pages, allowed = _allowed(spark, d)
    yes = allowed.select("page_id", F.lit(True).alias("yes"))
    return pages.join(yes, "page_id", "left").select("page_id", "host", F.coalesce("yes", F.lit(False)).alias("allowed"))


@query
def web_fetch_pages(spark, d):
    _, allowed = _allowed(spark, d)
    return allowed.select("page_id", F.lit(200).cast("long").alias("status"), F.length(egress.body(F.col("html"))).cast("long").alias("body_length"), F.md5(egress.body(F.col("html"))).alias("body_md5"))


# --- metrics -------------------------------------------------------------------------------------


@query
def metrics_runs(spark, d):
    return runs.folded(fx.run_events(spark, d)).groupBy("status").agg(F.count("*").alias("runs_total"))


@query
def metrics_nodes(spark, d):
    return dag.nodes(fx.run_events(spark, d)).where("status in ('succeeded', 'failed')").groupBy("status").agg(F.count("*").alias("nodes_total"))


@query
def node_duration_histogram(spark, d):
    took = dag.spans(fx.run_events(spark, d)).where("end_seq is not null").groupBy("run_id", "node_id").agg((F.max("end_seq") - F.min("start_seq")).alias("seconds"))
    bounds = F.explode(F.array(*[F.lit(b) for b in (1, 2, 3, 5, 10, 1_000_000)])).alias("le")
    return took.select("seconds", bounds).groupBy(F.col("le").cast("long").alias("le")).agg(F.sum((F.col("seconds") <= F.col("le")).cast("long")).alias("n"))


@query
def metrics_llm(spark, d):
    sums = _ledger(spark, d).where("cost_usd is not null").groupBy("provider", "model").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("cost_usd").cast("double").alias("cost_usd")
    )
    return sums.unpivot(["provider", "model", "calls", "cost_usd"], ["input", "output"], "kind", "tokens")


@query
def metrics_tools(spark, d):
    return _outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


# --- agents and workloads ------------------------------------------------------------------------


def _proposals(spark, d):
    c = fx.table(spark, d, "conversations").where("role = 'assistant'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select(F.col("conv_id").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("round"), (F.length("text") % 20).cast("long").alias("value"))


@query
def cev_seed(spark, d):
    keys = _proposals(spark, d).select("key").distinct()
    rows = F.explode(F.array(F.struct(F.lit("executor").alias("role"), F.lit(0).cast("long").alias("dependencies")), F.struct(F.lit("critic").alias("role"), F.lit(1).cast("long").alias("dependencies"))))
    return keys.select("key", rows.alias("n")).select("key", "n.role", "n.dependencies")


@query
def cev_critique(spark, d):
    c = agents.critiqued(_proposals(spark, d), 5)
    return c.select("key", "round", F.array_join("violations", ",").alias("violations"), F.when(F.size("violations") == 0, "verify").otherwise("reflect").alias("next"))


@query
def cev_rounds(spark, d):
    return agents.rounds(agents.critiqued(_proposals(spark, d), 5), 3)


@query
def workload_linear(spark, d):
    size = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 10 + 1).alias("n"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return size.select("run_id", i.alias("node")).select("run_id", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("dependency"))


@query
def workload_fan(spark, d):
    size = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 5 + 1).alias("width"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") + 1))
    rows = size.select("run_id", "width", i.alias("node"))
    n = F.when(F.col("node") == 0, 0).when(F.col("node") <= F.col("width"), 1).otherwise(F.col("width"))
    return rows.select("run_id", "node", n.cast("long").alias("dependencies"))


# --- SQL that is passed through ------------------------------------------------------------------


def _passed(name: str, text: str) -> None:
    QUERIES[name] = lambda spark, d: readonly.query(spark, d, text)


for _name, _text in READONLY.items():
    _passed(_name, _text)
