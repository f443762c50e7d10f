"""Task graphs from event logs: nodes, edges, readiness, outcomes, order and failures.

A log has run_id, seq, event_type; node events name a node_id, ``node.added`` lists its dependencies,
``edge.added`` has from_node, to_node and edge_type. Every fold groups by (run, node); walks go round
by round over the edges of all runs at once, each round a join, so no run's graph has to stand in
one task: levels take as many rounds as the longest path, reachability their logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.sources.staging import staged

#: Error classes that may be tried again, and those whose effect is not known.
RETRYABLE = ("ConcurrencyError", "LeaseHeldError", "ProviderUnavailableError", "ToolUnavailableError", "ToolTimeoutError")
INDETERMINATE = ("ToolIndeterminateError",)
STATUS = {"node.added": "pending", "node.started": "running", "node.succeeded": "succeeded", "node.failed": "failed", "node.skipped": "skipped"}
DEPENDENCY = "dependency"


def _last(value: Column, when: Column) -> Column:
    """The value at the greatest seq for which ``when`` holds."""
    return F.max_by(F.when(when, value), F.when(when, F.col("seq")))


def nodes(log: DataFrame) -> DataFrame:
    """run_id, node_id, added_seq, status (of the last node event), attempt, failed_attempt, and where the
    log has them: role and reflection_depth of the addition, output of the last success, error_class and
    error_message of the last failure. A later start clears none of them."""
    of = lambda *types: F.col("event_type").isin(*[f"node.{t}" for t in types])
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.max_by("event_type", "seq"))
    carried = {
        "role": ("role", "added"), "reflection_depth": ("reflection_depth", "added"), "output": ("output", "succeeded"),
        "error_class": ("error_class", "failed"), "error_message": ("message", "failed"),
    }
    return (
        log.where(F.col("event_type").isin(*STATUS) & F.col("node_id").isNotNull())
        .groupBy("run_id", "node_id")
        .agg(
            F.min(F.when(of("added"), F.col("seq"))).alias("added_seq"),
            status.alias("status"),
            F.coalesce(_last(F.col("attempt"), of("started", "failed")), F.lit(0)).alias("attempt"),
            _last(F.col("attempt"), of("failed")).alias("failed_attempt"),
            *[_last(F.col(c), of(t)).alias(name) for name, (c, t) in carried.items() if c in log.columns],
        )
    )


def edges(log: DataFrame) -> DataFrame:
    """run_id, from_node, to_node, edge_type, seq: declared dependencies and edges added later, in one pass of the log."""
    edge = lambda a, b, kind: F.struct(a.alias("from_node"), b.alias("to_node"), kind.alias("edge_type"))
    declared = F.transform("dependencies", lambda x: edge(x, F.col("node_id"), F.lit(DEPENDENCY)))
    added = F.array(edge(F.col("from_node"), F.col("to_node"), F.col("edge_type")))
    every = F.when(F.col("event_type") == "node.added", declared).when(F.col("event_type") == "edge.added", added)
    return log.where("event_type in ('node.added', 'edge.added')").select("run_id", "seq", F.explode(every).alias("e")).select("run_id", "e.from_node", "e.to_node", "e.edge_type", "seq")


def dependencies(edges: DataFrame) -> DataFrame:
    """run_id, from_node, to_node of the edges that make a node wait, each once."""
    return edges.where(F.col("edge_type") == DEPENDENCY).select("run_id", "from_node", "to_node").distinct()


def duplicates(log: DataFrame) -> DataFrame:
    return log.where("event_type = 'node.added'").groupBy("run_id", "node_id").agg(F.count("*").alias("added")).where("added > 1")


def unknown(log: DataFrame) -> DataFrame:
    """Node events, dependencies and ends of edges on a node that was not added earlier in the run."""
    first = log.where("event_type = 'node.added'").groupBy("run_id", "node_id").agg(F.min("seq").alias("added_seq"))
    named = log.where(F.col("event_type").isin(*STATUS) & (F.col("event_type") != "node.added")).select("run_id", "node_id", "seq")
    named = named.union(edges(log).select("run_id", F.col("from_node").alias("node_id"), "seq"))
    named = named.union(log.where("event_type = 'edge.added'").select("run_id", F.col("to_node").alias("node_id"), "seq"))
    return named.join(first, ["run_id", "node_id"], "left").where("added_seq is null or added_seq >= seq").select("run_id", "node_id", "seq").distinct()


#: States of a node where only these count: of the last, whatever else holds up, and what does not.
_PENDING, _RUNNING, _FAILED, _OPEN, _DONE = range(5)


def _standing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, node_id, state, attempt and blocked of every node that is pending, running or failed: blocked if a
    dependency, declared or added, is a node that has not succeeded; a skipped one blocks.

    Nodes stand beside the edges that leave them, so both are dealt once, and not at all if their log is dealt by run:
    joins by run and node would deal each side again. What is sorted for that is one number for a node's state, none
    for an edge. Nodes that are done and edges that hold nothing up, most of a log, end before they are grouped."""
    is_, state = lambda status: F.col("status") == status, F.col("state")
    code = F.when(is_("pending"), _PENDING).when(is_("running"), _RUNNING).when(is_("failed"), _FAILED).when(~is_("succeeded"), _OPEN).otherwise(_DONE)
    own = nodes.select("run_id", F.col("node_id").alias("at"), "node_id", code.alias("state"), "attempt")
    waits = edges.where(F.col("edge_type") == DEPENDENCY).select("run_id", F.col("from_node").alias("at"), F.col("to_node").alias("node_id"))
    rows = own.unionByName(waits, True).withColumn("of_at", F.min("state").over(Window.partitionBy("run_id", "at")))
    rows = rows.where((state <= _FAILED) | state.isNull() & (F.col("of_at") <= _OPEN))
    every = rows.groupBy("run_id", "node_id").agg(F.max("state").alias("state"), F.max("attempt").alias("attempt"), F.bool_or(state.isNull()).alias("blocked"))
    return every.where(state.isNotNull())


_READY, _ABLE = f"state = {_PENDING} and not blocked", f"state = {_RUNNING} or state = {_PENDING} and not blocked"


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending nodes all of whose dependencies, declared or added, succeeded; a skipped one blocks."""
    return _standing(nodes, edges).where(_READY).select("run_id", "node_id")


def outcomes(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """failed if any node failed; succeeded if all succeeded or were skipped; else, or empty, running."""
    per_run = nodes.groupBy("run_id").agg(F.bool_or(F.col("status") == "failed").alias("any_failed"), F.bool_and(F.col("status").isin("succeeded", "skipped")).alias("all_done"))
    outcome = F.when(F.col("any_failed"), F.lit("failed")).when(F.col("all_done"), F.lit("succeeded")).otherwise(F.lit("running"))
    return runs.select("run_id").distinct().join(per_run, "run_id", "left").select("run_id", outcome.alias("outcome"))


def dispatchable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ready nodes, and running ones (after a crash none is in flight); next_attempt keeps a running one's."""
    able = _standing(nodes, edges).where(_ABLE)
    return able.select("run_id", "node_id", F.when(F.col("state") == _RUNNING, F.col("attempt")).otherwise(F.col("attempt") + 1).alias("next_attempt"))


def deadlocks(runs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Runs with nodes whose outcome is open and of which none can be dispatched."""
    failed, able, idle = (F.bool_or(F.expr(x)) for x in (f"state = {_FAILED}", _ABLE, f"state = {_PENDING} and blocked"))
    stuck = _standing(nodes, edges).groupBy("run_id").agg(failed.alias("failed"), able.alias("able"), idle.alias("idle")).where("idle and not failed and not able")
    return stuck.select("run_id").join(runs.select("run_id").distinct(), "run_id", "left_semi")


def inputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, node_id, dependency and its output; an empty object if it has none."""
    own = nodes.select("run_id", F.col("node_id").alias("dependency"), F.lit(False).alias("waits"), F.coalesce("output", F.lit("{}")).alias("output"))
    waits = dependencies(edges).select("run_id", F.col("from_node").alias("dependency"), F.col("to_node").alias("node_id"), F.lit(True).alias("waits"))
    # side by side, as in _standing; the dependency has one row
    rows = own.unionByName(waits, True).withColumn("output", F.max("output").over(Window.partitionBy("run_id", "dependency")))
    return rows.where("waits and output is not null").select("run_id", "node_id", "dependency", "output")


def levels(log: DataFrame) -> DataFrame:
    """run_id, node_id, level: the longest path from a node without dependencies.

    A round takes all nodes that some path of its length reaches; the last round that does is the
    level. A cycle would never end, so more rounds than a run has nodes are an error."""
    added = log.where("event_type = 'node.added'").select("run_id", "node_id").distinct()
    waits = staged(dependencies(edges(log)))
    here = staged(added.join(waits.select("run_id", F.col("to_node").alias("node_id")), ["run_id", "node_id"], "left_anti"))
    most = added.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    found, k = here.withColumn("level", F.lit(0)), 0
    while True:
        here = staged(here.join(waits, (here["run_id"] == waits["run_id"]) & (here["node_id"] == waits["from_node"])).select(waits["run_id"], waits["to_node"].alias("node_id")).distinct())
        if here.isEmpty():
            return found.groupBy("run_id", "node_id").agg(F.max("level").alias("level"))
        k += 1
        if k > most:
            raise ValueError("the dependencies of a run have a cycle")
        found = found.union(here.withColumn("level", F.lit(k)))


def reachable(log: DataFrame) -> DataFrame:
    """run_id, from_node, to_node: to_node can be reached from from_node along dependencies.

    Each round goes on from the ways that the last one found, along all known: the first half of a shortest way
    was found in the last round, so lengths double, and a round deals what is new and what is known, not all
    known ways three times."""
    found, known, k = staged(dependencies(edges(log))), None, 0
    while True:
        known = found.withColumn("k", F.lit(0)) if known is None else known
        on = known.select(F.col("run_id").alias("r"), F.col("from_node").alias("via"), F.col("to_node").alias("end"))
        longer = found.join(on, (F.col("run_id") == F.col("r")) & (F.col("to_node") == F.col("via"))).select("run_id", "from_node", F.col("end").alias("to_node"))
        k += 1
        known = staged(known.union(longer.withColumn("k", F.lit(k))).groupBy("run_id", "from_node", "to_node").agg(F.min("k").alias("k")))
        found = known.where(F.col("k") == k).drop("k")
        if found.isEmpty():
            return known.drop("k")


def cyclic(log: DataFrame) -> DataFrame:
    """Of each run the first edge added later (run_id, seq, from_node, to_node) that closes a cycle of
    dependencies, taking the edges before it; an edge to its own node is one. Edges of other types
    close none.

    Steps and what was seen name the edge that is asked about by a number."""
    every = edges(log).where(F.col("edge_type") == DEPENDENCY)
    waits = staged(every.select("run_id", F.col("from_node").alias("node"), F.col("to_node").alias("next"), F.col("seq").alias("made")).distinct())
    asked = log.where((F.col("event_type") == "edge.added") & (F.col("edge_type") == DEPENDENCY))
    asked = staged(asked.select("run_id", "seq", "from_node", "to_node", F.monotonically_increasing_id().alias("edge")))
    here = asked.select("edge", "run_id", "seq", "from_node", F.col("to_node").alias("node"))
    seen, closed = here.select("edge", "node"), here.where("node = from_node").select("edge")
    while True:
        step = here.where("node <> from_node").join(waits, ["run_id", "node"]).where("made < seq").select("edge", "run_id", "seq", "from_node", F.col("next").alias("node")).distinct()
        here = staged(step.join(seen, ["edge", "node"], "left_anti"))
        if here.isEmpty():
            break
        seen, closed = seen.union(here.select("edge", "node")), closed.union(here.where("node = from_node").select("edge"))
    first = F.min(F.struct("seq", "from_node", "to_node")).alias("e")
    return asked.join(closed, "edge", "left_semi").groupBy("run_id").agg(first).select("run_id", "e.seq", "e.from_node", "e.to_node")


def failure_cause(nodes: DataFrame) -> DataFrame:
    """The failed node that was added first, of each run with one, and its error."""
    first = F.min(F.struct("added_seq", "node_id", F.col("failed_attempt").alias("attempt"), "error_class", "error_message")).alias("f")
    return nodes.where("status = 'failed'").groupBy("run_id").agg(first).select("run_id", "f.node_id", "f.attempt", "f.error_class", "f.error_message")


def category(error_class: Column) -> Column:
    return F.when(error_class.isin(*RETRYABLE), "retryable").when(error_class.isin(*INDETERMINATE), "indeterminate").otherwise("terminal")


def retries(error_class: Column, typed: Column, attempt: Column, max_attempts: int, retry_on: tuple[str, ...]) -> Column:
    """Whether a failure is tried again: typed, in a category to retry, and attempts are left."""
    return typed & (attempt < max_attempts) & category(error_class).isin(*retry_on)


def concurrency(log: DataFrame) -> DataFrame:
    """run_id and the most nodes that were in flight at once."""
    mine = Window.partitionBy("run_id", "node_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.max(F.when(F.col("event_type") == "node.started", F.lit(1))).over(mine), F.lit(0))
    change = F.when((F.col("event_type") == "node.started") & (begun == 0), 1).when(F.col("event_type").isin("node.succeeded", "node.failed"), -1).otherwise(0)
    steps = log.where("node_id is not null").select("run_id", "seq", change.alias("change"))
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("now", F.sum("change").over(w)).groupBy("run_id").agg(F.max("now").alias("most"))


def spans(log: DataFrame) -> DataFrame:
    """run_id, node_id, attempt, start_seq and end_seq of each attempt; an attempt that the next one
    or the node's end follows ends there."""
    w = Window.partitionBy("run_id", "node_id").orderBy("seq")
    timed = log.where(F.col("event_type").isin("node.started", "node.succeeded", "node.failed")).withColumn("end_seq", F.lead("seq").over(w))
    return timed.where("event_type = 'node.started'").select("run_id", "node_id", "attempt", F.col("seq").alias("start_seq"), "end_seq")
