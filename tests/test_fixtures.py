"""The event log that Spark builds in one pass against the SQL that defines it."""

import random

import pytest

from runweave.operators import dag
from runweave.queries import QUERIES
from runweave.sources import fixtures as fx
from runweave.sources.fixtures import RUN_EVENTS


def of_sql(spark, d):
    log = fx.sql(spark, d, RUN_EVENTS + "SELECT * FROM run_events")
    return log.selectExpr("* except (deps)", "cast(split(deps, ',') as array<bigint>) as dependencies")


@pytest.fixture
def odd(spark, small, tmp_path):
    """Orders of odd and null status, customer and key, runs of one line and of none, lines of no order, null flags."""
    orders = fx.table(spark, small, "orders").limit(600)
    orders = orders.selectExpr(
        "* except (o_orderkey, o_custkey, o_orderstatus)", "if(o_orderkey % 97 = 0, null, o_orderkey * if(o_orderkey % 3 = 0, -1, 1)) as o_orderkey",
        "if(o_orderkey % 11 = 0, null, o_custkey) as o_custkey", "case when o_orderkey % 7 = 0 then null when o_orderkey % 13 = 0 then 'X' else o_orderstatus end as o_orderstatus",
    )
    lines = fx.table(spark, small, "lineitem")
    lines = lines.where("l_orderkey % 10 <> 0 or l_linenumber = 1").selectExpr(
        "* except (l_orderkey, l_linenumber, l_returnflag, l_linestatus)", "l_orderkey * if(l_orderkey % 3 = 0, -1, 1) as l_orderkey", "l_linenumber % 3 as l_linenumber",
        "if(l_partkey % 5 = 0, null, l_returnflag) as l_returnflag", "case when l_partkey % 6 = 0 then null when l_partkey % 4 = 0 then 'O' else l_linestatus end as l_linestatus",
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_run_events_are_those_of_the_sql(spark, small, odd):
    for d in (small, odd):
        got, want = fx.run_events(spark, d), of_sql(spark, d)
        assert {c: t for c, t in got.dtypes} == {c: t for c, t in want.dtypes}
        got, want = got.select(want.columns).cache(), want.cache()
        assert want.count() > 5_000 and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
        got.unpersist(), want.unpersist()


def test_a_log_deals_its_line_items_once(spark, small):
    """One exchange for each of the two tables; the fold by run and node adds none."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dag.nodes(fx.run_events(spark, small))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_edges_take_one_pass_of_the_log(spark, small):
    plan = dag.edges(fx.run_events(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_long_ways_and_cycles(spark):
    """A chain of 40 nodes with a cycle behind it, against a walk."""
    steps = {i: {i + 1} for i in range(40)} | {40: {41}, 41: {39}, 50: {3}}
    rows = [(1, 1 + n, "edge.added", None, None, a, b, "dependency") for n, (a, b) in enumerate((a, b) for a in steps for b in steps[a])]
    log = spark.createDataFrame(rows, "run_id long, seq long, event_type string, node_id long, dependencies array<long>, from_node long, to_node long, edge_type string")
    want = set()
    for a in steps:
        todo = list(steps[a])
        while todo:
            if (a, b := todo.pop()) not in want:
                want.add((a, b))
                todo += steps.get(b, ())
    got = [(r["from_node"], r["to_node"]) for r in dag.reachable(log).collect()]
    assert len(got) == len(want) and set(got) == want
    assert [(r["from_node"], r["to_node"]) for r in dag.cyclic(log).collect()] == [(41, 39)]


def test_a_task_of_the_log_takes_no_more_as_tables_grow(spark, small, monkeypatch):
    lines = fx.table(spark, small, "lineitem")
    n = lines.count()
    for task, most, want in ((n // 20, n, 21), (1, n, 200), (1, n // 250, 251), (n, n, 4)):
        monkeypatch.setattr(fx, "TASK_LINES", task), monkeypatch.setattr(fx, "MOST_LINES", most)
        assert abs(fx._parts(spark, lines) - want) <= 1
    monkeypatch.setattr(fx, "TASK_LINES", n // 20), monkeypatch.setattr(fx, "MOST_LINES", n)
    plan = dag.nodes(fx.run_events(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(run_id#") == 2 == plan.count(f", {fx._parts(spark, lines)}), REPARTITION_BY_NUM")


def exchanges(spark, df):
    """How often a plan without broadcasts deals rows, and how often it does so for a join or a group by run."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plan.count("Exchange "), len([x for x in plan.splitlines() if "Exchange hashpartitioning(run_id#" in x and "REPARTITION_BY_NUM" not in x])


def test_ready_and_dispatchable_nodes_deal_no_events(spark, small):
    log = fx.run_events(spark, small)
    for df in (dag.ready(dag.nodes(log), dag.edges(log)), dag.dispatchable(dag.nodes(log), dag.edges(log)), QUERIES["dag_dispatchable"](spark, small)):
        assert exchanges(spark, df) == (4, 0)
    assert exchanges(spark, QUERIES["next_attempt"](spark, small)) == (5, 0)


ODD_GRAPHS = "run_id long, seq long, event_type string, node_id long, attempt int, output string, dependencies array<long>, from_node long, to_node long, edge_type string"


def odd_graphs(spark):
    """Nodes added twice and never, edges of other types, repeated, to their own node, to and from nodes that are not there or null."""
    draw, rows = random.Random(7), []
    for run in range(60):
        n, seq = draw.randint(1, 9), 0
        for _ in range(draw.randint(1, 40)):
            seq, node, kind = seq + 1, draw.randrange(n), draw.choice(["node.added"] * 3 + ["node.started", "node.succeeded", "node.succeeded", "node.failed", "node.skipped", "edge.added"])
            deps = [draw.choice([*range(n + 2), None]) for _ in range(draw.randint(0, 2))] if kind == "node.added" else None
            ends = (draw.choice([*range(n + 2), None]), draw.choice([*range(n + 2), None]), draw.choice(["dependency", "reject"])) if kind == "edge.added" else (None, None, None)
            rows.append((run, seq, kind, None if ends[2] else node, draw.randint(0, 2), draw.choice([None, f"o{seq}"]), deps, *ends))
    return rows, spark.createDataFrame(rows, ODD_GRAPHS)


def by_walk(rows):
    """Status, attempt and output of nodes, and the dependencies, from an event at a time."""
    status, attempt, output, waits = {}, {}, {}, set()
    for run, _, kind, node, tried, out, deps, a, b, edge in rows:
        if kind != "edge.added":
            status[run, node] = dag.STATUS[kind]
            if kind in ("node.started", "node.failed"):
                attempt[run, node] = tried
            if kind == "node.succeeded":
                output[run, node] = out
            waits |= {(run, d, node) for d in deps or ()}
        elif edge == "dependency":
            waits.add((run, a, b))
    return status, attempt, output, waits


@pytest.mark.parametrize("parts", [1, 5])
def test_ready_and_dispatchable_on_odd_graphs(spark, parts):
    rows, log = odd_graphs(spark)
    log = log.repartition(parts, "run_id")
    status, attempt, _, waits = by_walk(rows)
    blocked = {(run, b) for run, a, b in waits if status.get((run, a), "succeeded") != "succeeded"}
    free = {k for k, v in status.items() if v == "pending" and k not in blocked}
    assert free and sorted(map(tuple, dag.ready(dag.nodes(log), dag.edges(log)).collect())) == sorted(free)
    want = [(*k, attempt.get(k, 0) + 1) for k in free] + [(*k, attempt[k]) for k, v in status.items() if v == "running"]
    assert sorted(map(tuple, dag.dispatchable(dag.nodes(log), dag.edges(log)).collect())) == sorted(want)


def test_done_nodes_are_not_grouped_by_what_they_wait_for(spark, small):
    log = fx.run_events(spark, small)
    nodes, edges = dag.nodes(log), dag.edges(log)
    for df in (dag.ready(nodes, edges), dag.dispatchable(nodes, edges)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        grouped, beside = (next(k for k, x in enumerate(plan) if name in x) for name in ("Aggregate [run_id", "Window ["))
        assert [x for x in plan[grouped:beside] if "+- Filter (" in x]


def test_what_is_sorted_to_find_ready_nodes_is_narrow(spark, small):
    log = fx.run_events(spark, small)
    for df in (dag.ready(dag.nodes(log), dag.edges(log)), dag.dispatchable(dag.nodes(log), dag.edges(log))):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        beside = next(k for k, x in enumerate(plan) if "Union" in x)
        assert plan[beside + 1].count(" AS ") <= 2


def test_inputs_of_nodes_deal_no_events(spark, small):
    log = fx.run_events(spark, small)
    for df in (dag.inputs(dag.nodes(log), dag.edges(log)), QUERIES["node_inputs"](spark, small)):
        assert exchanges(spark, df) == (4, 0)


@pytest.mark.parametrize("parts", [1, 5])
def test_inputs_of_nodes_on_odd_graphs(spark, parts):
    rows, log = odd_graphs(spark)
    log = log.repartition(parts, "run_id")
    status, _, output, waits = by_walk(rows)
    want = [(run, b, a, output.get((run, a)) or "{}") for run, a, b in waits if (run, a) in status]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert want and sorted(map(tuple, dag.inputs(dag.nodes(log), dag.edges(log)).collect()), key=order) == sorted(want, key=order)
