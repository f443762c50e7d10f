"""The set-based fold against a sequential one, and the scenarios of the lifecycle."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from runweave.operators import cost, dag, runs, snapshots, tools
from runweave.operators.registry import Payload, Registry, counted_registry, run_registry

TYPES = ["run.created", "run.started", "run.succeeded", "run.failed", "run.cancelled", "node.started"]


def sequential(events):
    """(status, last lifecycle seq, illegal seq) one event at a time."""
    status, last = None, None
    for seq, kind in events:
        if status is None:
            if kind != "run.created":
                return None, None, seq
            status, last = "pending", seq
            continue
        if not kind.startswith("run."):
            continue
        step = kind[4:]
        legal = {"pending": ("started", "cancelled"), "running": ("succeeded", "failed", "cancelled")}.get(status, ())
        if step not in legal or seq <= last:
            return status, last, seq
        status, last = {"started": "running"}.get(step, step), seq
    return status, last, None


def test_fold_equals_a_sequential_one(spark):
    logs = [list(enumerate(x, 1)) for n in (1, 2, 3, 4) for x in itertools.product(TYPES, repeat=n)]
    rng = random.Random(1)
    for log in list(logs):  # some seqs repeat; events of one seq stand in order of type
        seqs = sorted(rng.randint(1, len(log)) for _ in log)
        logs.append(sorted(zip(seqs, (t for _, t in log), strict=True)))
    rows = [(i, s, t) for i, log in enumerate(logs) for s, t in log]
    rng.shuffle(rows)
    got = {r["run_id"]: (r["status"], r["last_lifecycle_seq"], r["illegal_seq"]) for r in runs.folded(spark.createDataFrame(rows, "run_id long, seq long, event_type string")).collect()}
    for i, log in enumerate(logs):
        assert got[i] == sequential(log), log


def test_state_fields(spark):
    schema = "run_id long, seq long, event_type string, occurred_at long, input string, worker string, result string, error_class string, message string, reason string"
    none = [None] * 6
    rows = [(1, 1, "run.created", 10, "{}", *none[1:]), (1, 2, "run.started", 11, None, "w", *none[2:]), (1, 3, "run.failed", 12, None, None, None, "E", "why", None)]
    rows += [(2, 1, "run.created", 20, "{}", *none[1:]), (2, 2, "run.cancelled", 21, *none[1:], "stop"), (2, 3, "run.started", 22, None, "w", *none[2:])]
    got = {r["run_id"]: r.asDict() for r in runs.folded(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == {
        "run_id": 1, "status": "failed", "last_seq": 3, "last_lifecycle_seq": 3, "illegal_seq": None, "input": "{}", "created_at": 10, "worker": "w", "started_at": 11,
        "result": None, "error_class": "E", "error_message": "why", "cancel_reason": None, "finished_at": 12,
    }
    # the start after the end is illegal, and what it carries is not in the state
    assert (got[2]["status"], got[2]["illegal_seq"], got[2]["worker"], got[2]["cancel_reason"], got[2]["finished_at"]) == ("cancelled", 3, None, "stop", 21)


def test_snapshot_and_tail_give_the_full_fold(spark):
    logs = [["run.created", "run.started", "node.started", t] for t in ("run.succeeded", "run.failed", "run.cancelled")] + [["run.created", "run.cancelled"], ["run.created"], ["run.created", "node.started", "run.started"]]
    logs += [["run.created", "node.started", "run.succeeded"], ["run.created", "run.started", "run.failed", "run.succeeded"], ["run.created", "run.cancelled", "node.started", "run.failed"]]  # illegal tails
    rows = [(i, s + 1, t) for i, log in enumerate(logs) for s, t in enumerate(log)]
    log = spark.createDataFrame(rows, "run_id long, seq long, event_type string")
    state = lambda df: {r["run_id"]: (r["status"], r["last_seq"], r["illegal_seq"]) for r in df.collect()}
    for at in (1, 2, 3):
        found = [(i, at, *sequential(list(enumerate(x[:at], 1)))) for i, x in enumerate(logs) if len(x) >= at]
        snaps = [f[:4] for f in found if f[4] is None]  # of legal logs only
        assert state(runs.resumed(spark.createDataFrame(snaps, "run_id long, at_seq long, status string, last_lifecycle_seq long"), log)) == state(runs.folded(log))


def test_leases(spark):
    rows = [(1, 0, 0, "a", 10), (1, 5, 1, "b", 10), (1, 10, 2, "b", 10), (1, 11, 3, "c", 10)]
    r = runs.leases(spark.createDataFrame(rows, "run_id long, at long, order long, worker string, ttl long")).first()
    assert (r["token"], r["owner"], r["until"]) == (2, "c", 21)  # expiry at 10 is not before 10


def test_appends_are_held_against_the_lease(spark):
    rows = [(1, 1, False, 0), (1, 2, True, 1), (1, 3, False, 1), (1, 4, True, 2), (1, 5, False, 1), (1, 6, False, 2), (1, 7, False, 3), (2, 1, False, 1)]
    out = runs.stale_appends(spark.createDataFrame(rows, "run_id long, seq long, takes boolean, token long")).collect()
    assert {(r["run_id"], r["seq"], r["current"]) for r in out} == {(1, 5, 2), (1, 7, 2), (2, 1, 0)}  # behind, and ahead


def log_of(spark, rows):
    """(event_type, node_id, attempt, dependencies, more) in order of seq."""
    out = [(1, s + 1, kind, node, attempt, deps, more.get("from"), more.get("to"), more.get("type"), more.get("output"), more.get("error"), more.get("error")) for s, (kind, node, attempt, deps, more) in enumerate(rows)]
    return spark.createDataFrame(out, "run_id long, seq long, event_type string, node_id long, attempt long, dependencies array<long>, from_node long, to_node long, edge_type string, output string, error_class string, message string")


def added(node, *deps):
    return "node.added", node, 0, list(deps), {}


def edge(a, b, kind="dependency"):
    return "edge.added", None, None, None, {"from": a, "to": b, "type": kind}


def event(kind, node, attempt=1, **more):
    return f"node.{kind}", node, attempt, None, more


def test_graph_scenarios(spark):
    log = log_of(spark, [added(0), added(1, 0), added(2, 0, 1), event("started", 0), event("failed", 0, error="E"), event("started", 0, 2)])
    nodes = {r["node_id"]: r for r in dag.nodes(log).collect()}
    assert (nodes[0]["status"], nodes[0]["attempt"], nodes[0]["failed_attempt"], nodes[0]["error_class"]) == ("running", 2, 1, "E")  # an error is not cleared
    assert dag.ready(dag.nodes(log), dag.edges(log)).count() == 0
    assert {(r["node_id"], r["level"]) for r in dag.levels(log).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {(r["from_node"], r["to_node"]) for r in dag.reachable(log).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_an_edge_added_later_makes_a_node_wait(spark):
    rows = [added(0), added(1), edge(0, 1, "reflection")]
    log = log_of(spark, rows)
    assert {r["node_id"] for r in dag.ready(dag.nodes(log), dag.edges(log)).collect()} == {0, 1}
    log = log_of(spark, [*rows, edge(0, 1)])
    assert {r["node_id"]: r["status"] for r in dag.nodes(log).collect()} == {0: "pending", 1: "pending"}
    assert [r["node_id"] for r in dag.ready(dag.nodes(log), dag.edges(log)).collect()] == [0]
    done = log_of(spark, [*rows, edge(0, 1), event("started", 0), event("succeeded", 0, output='{"x": 1}')])
    assert [r["node_id"] for r in dag.ready(dag.nodes(done), dag.edges(done)).collect()] == [1]
    assert [(r["node_id"], r["dependency"], r["output"]) for r in dag.inputs(dag.nodes(done), dag.edges(done)).collect()] == [(1, 0, '{"x": 1}')]


def test_cycles_edge_after_edge(spark):
    cases = [
        ([edge(0, 2)], None), ([edge(2, 0)], 4), ([edge(1, 1)], 4), ([edge(2, 0, "reject")], None), ([edge(1, 2), edge(2, 1)], 5), ([edge(2, 1), edge(1, 2)], 5),
        ([edge(2, 0, "reflection"), edge(2, 1), edge(1, 0)], 6), ([edge(1, 0), edge(0, 1)], 4),
    ]
    for edges, seq in cases:
        got = dag.cyclic(log_of(spark, [added(0), added(1, 0), added(2, 0), *edges])).collect()
        assert [r["seq"] for r in got] == ([seq] if seq else []), edges


def test_unknown_ends(spark):
    log = log_of(spark, [added(0, 9), edge(0, 7), event("started", 8), added(7)])
    assert {(r["node_id"], r["seq"]) for r in dag.unknown(log).collect()} == {(9, 1), (7, 2), (8, 3)}


def test_a_wide_graph(spark):
    n = 100_000
    ids = spark.range(n).select(F.lit(1).alias("run_id"), (F.col("id") + 1).alias("seq"), F.lit("node.added").alias("event_type"), F.col("id").alias("node_id"))
    log = ids.withColumns({"dependencies": F.when(F.col("node_id") > 0, F.when(F.col("node_id") < n - 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.lit(n - 2).cast("long")))), "from_node": F.lit(None).cast("long"), "to_node": F.lit(None).cast("long"), "edge_type": F.lit(None).cast("string")})
    assert {r["level"]: r["count"] for r in dag.levels(log).groupBy("level").count().collect()} == {0: 1, 1: n - 2, 2: 1}


def test_a_cycle_has_no_levels(spark):
    with pytest.raises(ValueError):
        dag.levels(log_of(spark, [added(0), added(1, 0), added(2, 1), edge(2, 1)]))


def test_a_skipped_dependency_blocks(spark):
    log = log_of(spark, [added(0), added(1, 0), event("skipped", 0)])
    nodes = dag.nodes(log)
    assert dag.ready(nodes, dag.edges(log)).count() == 0
    assert [r["run_id"] for r in dag.deadlocks(log, nodes, dag.edges(log)).collect()] == [1]


def test_first_added_failure_is_the_cause(spark):
    log = log_of(spark, [added(5), added(3), event("failed", 3, error="A"), event("failed", 5, error="B")])
    first = dag.failure_cause(dag.nodes(log)).first()
    assert (first["node_id"], first["error_class"], first["error_message"]) == (5, "B", "B")


def test_snapshot_rules(spark):
    stored = spark.createDataFrame([(1, 2, "a", 1)], "run_id long, at_seq long, status string, written long")
    again = spark.createDataFrame([(1, 2, "b", 2), (1, 4, "c", 2)], "run_id long, at_seq long, status string, written long")
    out = snapshots.saved(stored, again)
    assert {(r["at_seq"], r["status"]) for r in out.collect()} == {(2, "a"), (4, "c")}
    assert [r["at_seq"] for r in snapshots.pruned(out, 1).collect()] == [4]
    with pytest.raises(ValueError):
        snapshots.pruned(out, 0)


def test_snapshots_are_due_by_distance(spark):
    heads = spark.createDataFrame([(1, 9), (2, 9), (3, 3), (4, 4)], "run_id long, last_seq long")
    stored = spark.createDataFrame([(1, 2), (1, 5), (2, 6)], "run_id long, at_seq long")
    assert {r["run_id"]: r["due"] for r in snapshots.due(heads, stored, 4).collect()} == {1: True, 2: False, 3: False, 4: True}
    with pytest.raises(ValueError):
        snapshots.due(heads, stored, 0)


def test_budgets_are_strict(spark):
    rows = [(1, 1, 3, 2, "1"), (1, 2, 5, 0, "1"), (1, 3, 1, 0, "0.5"), (2, 1, 1, 1, "2.5"), (2, 2, 90, 0, "0")]
    calls = spark.createDataFrame(rows, "node_id long, call_no long, input_tokens long, output_tokens long, cost string").withColumn("cost_usd", F.col("cost").cast("decimal(20,10)"))
    over = lambda *limits: {(r["node_id"], r["call_no"], r["limit"]) for r in cost.over_budget(calls, ["node_id"], ["call_no"], *limits).collect()}
    assert over(10, None) == {(1, 3, "tokens"), (2, 2, "tokens")}
    assert over(10, "2.4") == {(1, 3, "cost"), (2, 1, "cost"), (2, 2, "cost")}
    assert over(None, "2.5") == set()


def test_ledger_records_priced_calls(spark, tmp_path):
    calls = spark.createDataFrame([("t", "r", None, "p", "m", 5, 6, 1), ("t", "r", "n", "p", "none", 5, 6, 2)], "tenant_id string, run_id string, node_id string, provider string, model string, input_tokens long, output_tokens long, call_no long")
    calls = cost.priced(calls, cost.price_book(spark, {("p", "m"): ("2", "1")})).withColumns({"latency_ms": F.lit(3), "created_at": F.lit("2024-05-06 07:08:09").cast("timestamp")})
    path = str(tmp_path / "ledger")
    with pytest.raises(ValueError):
        cost.record(calls, path)
    cost.record(calls.where("model = 'm'"), path)
    cost.record(calls.where("model = 'm'").withColumn("call_no", F.lit(7)), path)
    row = cost.ledger(spark, path).agg(*cost.summary(), F.countDistinct("id").alias("ids"), F.max("partition_key").cast("string").alias("month")).first()
    assert (row["calls"], row["ids"], row["total_tokens"], str(row["cost_usd"]), row["month"]) == (2, 2, 22, "0.0000320000", "2024-05-01")


def test_exact_cost(spark):
    calls = spark.createDataFrame([("p", "m", 1, 1), ("p", "none", 1, 1)], "provider string, model string, input_tokens long, output_tokens long")
    out = {r["model"]: r["cost_usd"] for r in cost.priced(calls, cost.price_book(spark, {("p", "m"): ("2.5", "10")})).collect()}
    assert str(out["m"]) == "0.0000125000" and out["none"] is None


def test_tool_precedence(spark):
    """Only requests name their tool; a completion and its request are one call."""
    rows = [("a", 1, "requested"), ("a", 2, "failed"), ("a", 3, "completed"), ("b", 1, "requested"), ("c", 1, "requested"), ("c", 2, "indeterminate"), ("c", 3, "failed"), ("d", 1, "completed")]
    log = spark.createDataFrame([(k, "t0" if e == "requested" else None, s, f"tool.{e}", float(s)) for k, s, e in rows], "idempotency_key string, tool string, seq long, event_type string, result double")
    out = {r["idempotency_key"]: (r["tool"], r["outcome"]) for r in tools.outcomes(tools.resolved(log), tools.specs(spark)).collect()}
    assert out == {"a": ("t0", "reused"), "b": ("t0", "redispatch"), "c": ("t0", "indeterminate"), "d": (None, "reused")}


def test_registry(spark):
    r = Registry()
    r.register("x", Payload(1, {"k": "bigint"}))
    with pytest.raises(ValueError):
        r.register("x", Payload(1, {"k": "bigint"}))
    with pytest.raises(ValueError):
        r.register("y", Payload(2, {"k": "bigint"}))
    cases = [
        ("view", '{"k": 1}', 1, None, {"k": 1, "count": 0}), ("view", '{"k": 1, "count": 3}', 2, None, {"k": 1, "count": 3}), ("view", '{"k": 1, "count": 3}', 1, None, {"k": 1, "count": 0}),
        ("view", '{"k": 1, "count": 2, "z": {"y": "}"}}', 2, "unknown_field", None), ("view", '{"k": 1}', 3, "future_version", '{"k": 1}'), ("click", "{}", 1, "unknown_type", "{}"),
        ("view", "not json", 1, "invalid_json", "not json"), ("view", None, 1, "invalid_json", None), ("view", "[1]", 1, "invalid_json", "[1]"), ("view", '{"k": 1, "k": 2}', 1, "invalid_json", None),
        ("view", "{}", 1, "missing_field", {"count": 0}), ("view", '{"k": 1}', 2, "missing_field", None), ("view", '{"k": "abc"}', 1, "wrong_type", None), ("view", '{"k": {"x": 1}}', 1, "wrong_type", {"k": {"x": 1}, "count": 0}),
        ("view", '{"k": null}', 1, "wrong_type", None),
    ]
    rows = [(i, *c[:3]) for i, c in enumerate(cases)]
    out = {x["i"]: x for x in counted_registry().decoded(spark.createDataFrame(rows, "i int, event_type string, payload string, payload_version int")).collect()}
    for i, (_, _, _, error, payload) in enumerate(cases):
        assert out[i]["decode_error"] == error, cases[i]
        if isinstance(payload, dict):
            assert json.loads(out[i]["payload"]) == payload
        elif payload is not None:
            assert out[i]["payload"] == payload


def test_run_payloads(spark):
    good = {"run.created": '{"input": {}}', "node.added": '{"node_id": "a", "role": "task", "dependencies": ["b"], "retry_policy": {"max_attempts": 1}, "budget": {}, "reflection_depth": 0}', "tool.completed": '{"idempotency_key": "k", "result": {"x": 1}}'}
    bad = {"run.created": '{"input": "text"}', "run.started": '{"worker": 5}', "node.added": '{"node_id": "a", "role": "task", "dependencies": "b", "retry_policy": {}, "budget": {}, "reflection_depth": "deep"}'}
    rows = [(t, p, 1, True) for t, p in good.items()] + [(t, p, 1, False) for t, p in bad.items()]
    out = run_registry().decoded(spark.createDataFrame(rows, "event_type string, payload string, payload_version int, fits boolean"))
    assert {(r["fits"], r["decode_error"]) for r in out.collect()} == {(True, None), (False, "wrong_type")}
