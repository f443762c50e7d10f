"""The cost ledger: exact decimals, one pass for all levels, budgets as running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.functions.ids import month_of, uuid7
from runweave.functions.pricing import COST, cost


def price_book(spark: SparkSession, prices: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    rows = [(*k, *v) for k, v in prices.items()]
    return spark.createDataFrame(rows, "provider string, model string, input_price string, output_price string")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with ``cost_usd``; null where the model has no price. The book is a small table of its own."""
    return calls.join(F.broadcast(prices), ["provider", "model"], "left").withColumn("cost_usd", cost(*map(F.col, ("input_tokens", "output_tokens", "input_price", "output_price"))))


def summary() -> list:
    """Sums that are zero over no rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    both = F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).cast("long").alias("total_tokens")
    return [F.coalesce(F.sum("cost_usd"), F.lit(0)).cast(COST).alias("cost_usd"), total("input_tokens"), total("output_tokens"), both, F.count("*").alias("calls")]


def by(ledger: DataFrame, *keys: str) -> DataFrame:
    """Cost per run, node or tenant; calls without a node count for no node."""
    rows = ledger.where("node_id is not null") if "node_id" in keys else ledger
    return rows.groupBy(*keys).agg(*summary())


def levels(ledger: DataFrame) -> DataFrame:
    """Tenant, run and node sums in one pass; ``level`` is the number of keys that are summed away."""
    return (
        ledger.groupingSets([["tenant_id"], ["tenant_id", "run_id"], ["tenant_id", "run_id", "node_id"]], "tenant_id", "run_id", "node_id")
        .agg((F.grouping("run_id") + F.grouping("node_id")).cast("long").alias("level"), *summary())
        .select("tenant_id", "run_id", "node_id", "level", "cost_usd", "input_tokens", "output_tokens", "total_tokens", "calls")
    )


def over_budget(calls: DataFrame, keys: list[str], order: list[str], max_tokens: int | None, max_cost: str | None) -> DataFrame:
    """Calls after which the spending of their key so far (``spent_tokens``, input and output, and
    ``spent_usd``, as recorded) is above a limit, strictly, and ``limit``: cost is looked at first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    calls = calls.withColumns({"spent_tokens": F.sum(F.col("input_tokens") + F.col("output_tokens")).over(w), "spent_usd": F.sum("cost_usd").over(w)})
    over = F.when(F.col("spent_usd") > F.lit(max_cost).cast(COST), "cost") if max_cost is not None else F.when(F.lit(False), "cost")
    if max_tokens is not None:
        over = over.when(F.col("spent_tokens") > max_tokens, "tokens")
    return calls.withColumn("limit", over).where("limit is not null")


#: Columns of the ledger.
LEDGER = "partition_key date, id string, tenant_id string, run_id string, node_id string, provider string, model string, input_tokens long, output_tokens long, cost_usd decimal(20,10), latency_ms int, created_at timestamp"


def record(calls: DataFrame, path: str) -> None:
    """Append priced calls (tenant_id, run_id, node_id, provider, model, input_tokens, output_tokens,
    cost_usd, latency_ms, created_at, and ``call_no`` in the run) to the ledger at ``path``, by month. An
    unpriced call is refused: nothing of the batch is written."""
    if calls.where("cost_usd is null").limit(1).count():
        raise ValueError("a call has no price")
    name = uuid7(F.unix_millis("created_at"), F.concat_ws(":", "run_id", "call_no"))
    rows = calls.withColumns({"id": name, "partition_key": month_of(F.col("created_at"))})
    kinds = [c.split() for c in LEDGER.split(", ")]
    rows.select(*[F.col(n).cast(t).alias(n) for n, t in kinds]).repartition("partition_key", "run_id").write.mode("append").partitionBy("partition_key").parquet(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)
