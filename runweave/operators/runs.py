"""Run state from event logs: one set-based fold for all runs.

A log has run_id, seq, event_type; a legal run has at most three lifecycle events, so its state
follows from the first four in order of seq, without a sequential fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.sources.staging import staged

LIFECYCLE = ("run.created", "run.started", "run.succeeded", "run.failed", "run.cancelled")
TERMINAL = ("run.succeeded", "run.failed", "run.cancelled")


def is_terminal(status: Column) -> Column:
    return status.isin("succeeded", "failed", "cancelled")


#: Fields of a run's state, the event that sets each and the column it comes from.
FIELDS = {
    "input": ("run.created", "input"), "created_at": ("run.created", "occurred_at"), "worker": ("run.started", "worker"), "started_at": ("run.started", "occurred_at"),
    "result": ("run.succeeded", "result"), "error_class": ("run.failed", "error_class"), "error_message": ("run.failed", "message"), "cancel_reason": ("run.cancelled", "reason"),
}


def ordinals(log: DataFrame) -> DataFrame:
    """Per run: s0, seq of its first event, and made, whether that is a creation; s1..s4 and t1..t4 of its first
    lifecycle events, with what they carry as e1..e3; last_seq of any event.

    First and last event are added up in tasks, as numbers, so nothing is sorted for them; only the first four
    lifecycle events of a run, cut in tasks too, are sorted. Events that repeat a seq follow each other by type."""
    created, at_type = "run.created", lambda when: F.min(F.when(when, F.col("seq")))
    ends = log.groupBy("run_id").agg(F.min("seq").alias("s0"), at_type(F.col("event_type") == created).alias("c0"), at_type(F.col("event_type") < created).alias("b0"), F.max("seq").alias("last_seq"))
    made = F.coalesce(F.col("c0") == F.col("s0"), F.lit(False)) & F.coalesce(F.col("b0") > F.col("s0"), F.lit(True))
    ends = ends.select("run_id", "s0", made.alias("made"), "last_seq")
    carried = sorted({c for _, c in FIELDS.values() if c in log.columns})
    life = log.where(F.col("event_type").isin(*LIFECYCLE)).select("run_id", "seq", "event_type", *carried)
    w = Window.partitionBy("run_id").orderBy("seq", "event_type")
    life = life.withColumn("k", F.row_number().over(w)).where("k <= 4")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    pick = [at(k, c).alias(f"{n}{k}") for k in range(1, 5) for n, c in (("s", "seq"), ("t", "event_type"))]
    pick += [F.first(F.when(F.col("k") == k, F.struct(*carried)), ignorenulls=True).alias(f"e{k}") for k in range(1, 4) if carried]
    return ends.join(life.groupBy("run_id").agg(*pick), "run_id", "left")


def folded(log: DataFrame) -> DataFrame:
    """run_id, status, last_seq (any event), last_lifecycle_seq, illegal_seq (null if legal), and where
    the log has them the fields of the state: input, created_at, worker, started_at, finished_at, result,
    error_class, error_message, cancel_reason.

    The state is the one before the first illegal event: one that is no step from the state so far, or
    repeats its seq. A run whose first event is not a creation has none (null status)."""
    o = ordinals(log)
    made = F.col("made")
    two = made & F.col("t2").isin("run.started", "run.cancelled") & (F.col("s2") > F.col("s1"))
    three = two & (F.col("t2") == "run.started") & F.col("t3").isin(*TERMINAL) & (F.col("s3") > F.col("s2"))
    two, three = F.coalesce(two, F.lit(False)), F.coalesce(three, F.lit(False))
    steps = F.when(~made, 0).when(three, 3).when(two, 2).otherwise(1)  # legal lifecycle events
    name = lambda c: F.regexp_replace(c, "run\\.", "")
    status = F.when(~made, F.lit(None)).when(three, name("t3")).when(two, F.when(F.col("t2") == "run.cancelled", "cancelled").otherwise("running")).otherwise("pending")
    illegal = F.when(~made, F.col("s0")).when(three, F.col("s4")).when(two, F.col("s3")).otherwise(F.col("s2"))
    last = F.when(~made, F.lit(None)).when(three, F.col("s3")).when(two, F.col("s2")).otherwise(F.col("s1"))
    o = o.withColumn("steps", steps)

    def carried(types: tuple[str, ...], column: str) -> Column:
        """What the legal event of one of the types carries."""
        found = [F.when((F.col("steps") >= k) & F.col(f"t{k}").isin(*types), F.col(f"e{k}.{column}")) for k in range(1, 4)]
        return F.coalesce(*found)

    fields = [carried((t,), c).alias(n) for n, (t, c) in FIELDS.items() if c in log.columns]
    if "occurred_at" in log.columns:
        fields.append(carried(TERMINAL, "occurred_at").alias("finished_at"))
    return o.select("run_id", status.alias("status"), "last_seq", last.alias("last_lifecycle_seq"), illegal.alias("illegal_seq"), *fields)


def transitions(log: DataFrame) -> DataFrame:
    """from_status, event_type and how many legal lifecycle events of runs made that step."""
    w = Window.partitionBy("run_id").orderBy("seq")
    life = log.where(F.col("event_type").isin(*LIFECYCLE)).withColumn("before", F.lag("event_type").over(w))
    before = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (("run.created", "pending"), ("run.started", "running")) for x in kv]), F.col("before")), F.lit("none"))
    before = F.when(F.col("before").isin(*TERMINAL), F.regexp_replace("before", "run\\.", "")).otherwise(before)
    return life.groupBy(before.alias("from_status"), "event_type").agg(F.count("*").alias("n"))


def resumed(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """run_id, status, last_seq, illegal_seq from snapshots (run_id, at_seq, status, last_lifecycle_seq) and
    the events after them; a run without a snapshot from all its events.

    A snapshot stands for the legal lifecycle events that lead to it, and those and the tail fold as a
    whole log does, so an illegal tail is refused in the same way."""
    log = log.select("run_id", "seq", "event_type")
    seqs = staged(snapshots.select("run_id", "at_seq", "status", F.col("last_lifecycle_seq").alias("at")))  # read six times
    # one row a run is hashed, so the log is not sorted for the join
    tail = log.join(seqs.select("run_id", "at_seq").hint("shuffle_hash"), "run_id", "left").where("at_seq is null or seq > at_seq").select("run_id", "seq", "event_type")
    led = F.when(F.col("status") == "pending", F.array(F.lit("run.created"))).when(F.col("status") == "running", F.array(F.lit("run.created"), F.lit("run.started")))
    led = led.when(F.col("status") == "cancelled", F.array(F.lit("run.created"), F.lit("run.cancelled"))).otherwise(F.array(F.lit("run.created"), F.lit("run.started"), F.concat(F.lit("run."), F.col("status"))))
    before = seqs.select("run_id", "at", F.size(led).alias("n"), F.posexplode(led).alias("i", "event_type")).select("run_id", (F.col("at") - F.col("n") + 1 + F.col("i")).cast("long").alias("seq"), "event_type")
    reached = seqs.select("run_id", F.col("at_seq").alias("seq"), F.lit("snapshot").alias("event_type"))
    return folded(before.union(reached).union(tail)).select("run_id", "status", "last_seq", "illegal_seq")


def pending_first(runs: DataFrame) -> DataFrame:
    """The oldest pending run of each tenant whose lease is free or expired: (tenant_id, run_id)."""
    free = runs.where("status = 'pending' and (expires_at is null or expires_at < as_of)")
    return free.groupBy("tenant_id").agg(F.min(F.struct("created_at", "run_id")).alias("oldest")).select("tenant_id", "oldest.run_id")


def leases(attempts: DataFrame) -> DataFrame:
    """Greedy acquisition over attempts (run_id, at, order, worker, ttl): an attempt gets the lease if
    there is none or it expired before. Per run: token (acquisitions), the last owner and ``until``,
    when its lease ends; ``ttl`` and ``until`` are in the unit of ``at``.

    Acceptance depends on what was accepted last, so attempts fold in order, inside one array for
    each run and on the JVM: the attempts of one run have to fit a task."""
    attempt = F.struct("at", "order", "worker", "ttl")
    start = F.struct(F.lit(None).cast("long").alias("until"), F.lit(0).cast("long").alias("token"), F.lit(None).cast("string").alias("owner"))

    def step(s: Column, a: Column) -> Column:
        got = F.struct((a["at"] + a["ttl"]).cast("long").alias("until"), (s["token"] + 1).cast("long").alias("token"), a["worker"].alias("owner"))
        return F.when(s["until"].isNull() | (s["until"] < a["at"]), got).otherwise(s)

    fold = attempts.groupBy("run_id").agg(F.array_sort(F.collect_list(attempt)).alias("all"))
    return fold.select("run_id", F.aggregate("all", start, step).alias("s")).select("run_id", F.col("s.token").alias("token"), F.col("s.owner").alias("owner"), F.col("s.until").alias("until"))


def stale_appends(acts: DataFrame) -> DataFrame:
    """Appends whose token is not the run's current one, that of the last acquisition before them.

    ``acts`` (run_id, seq, takes, token) has acquisitions (``takes``) and appends in one order; before
    the first acquisition the token is 0."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    current = F.coalesce(F.last(F.when(F.col("takes"), F.col("token")), ignorenulls=True).over(w), F.lit(0))
    return acts.withColumn("current", current).where("not takes and token <> current").drop("takes")
