"""The verbs over a log on disk: create, append, status, cancel, replay, tenancy, cost."""

import pytest

from runweave.facade import Ledger, Runs
from runweave.operators import cost
from runweave.sources import event_log
from runweave.sources.fixtures import PRICES, llm_calls


def events(spark, rows):
    df = spark.createDataFrame(rows, "run_id string, event_type string, payload string, order int")
    return df.selectExpr("*", "timestamp'2024-03-01 10:00:00' as occurred_at")


def test_verbs(spark, tmp_path):
    mine, other = Runs(spark, str(tmp_path / "log"), "t1"), Runs(spark, str(tmp_path / "log"), "t2")
    new = events(spark, [("a", "", "{}", 0), ("b", "", "{}", 0)]).drop("event_type", "order")
    mine.create_runs(new)
    with pytest.raises(ValueError):
        mine.create_runs(new)
    mine.append(events(spark, [("a", "run.started", "{}", 1), ("a", "node.added", "{}", 2), ("a", "run.succeeded", "{}", 3)]))
    assert {r["run_id"]: r["status"] for r in mine.states().collect()} == {"a": "succeeded", "b": "pending"}
    mine.cancel_runs(new.select("run_id", "occurred_at"))
    assert mine.get_run("b").first()["status"] == "cancelled" and mine.get_run("a").first()["illegal_seq"] is None
    assert [r["seq"] for r in mine.replay("a", 1, 3).collect()] == [2, 3]
    assert [r["event_type"] for r in mine.subscribe("a", 2).collect()] == ["node.added", "run.succeeded"]
    assert other.log().count() == 0 and other.get_run("a").count() == 0


def test_ledger(spark, small):
    calls = cost.priced(llm_calls(spark, small), cost.price_book(spark, PRICES)).where("cost_usd is not null").cache()
    one = calls.where("node_id is not null").first()
    ledger = Ledger(calls)
    assert ledger.node_cost(one["run_id"], one["node_id"]).first()["calls"] >= 1
    assert ledger.run_cost(one["run_id"]).first()["cost_usd"] <= ledger.tenant_cost(one["tenant_id"]).first()["cost_usd"]
    assert str(ledger.run_cost(-1).first()["cost_usd"]) in ("0E-10", "0.0000000000")


def test_a_run_is_read_from_its_month(spark, tmp_path):
    path = str(tmp_path / "log")
    runs_of = Runs(spark, path, "t1")
    march, may = "018df9b1-0000-7000-8000-000000000001", "018f3246-0000-7000-8000-000000000002"
    rows = [(march, "", "{}", 0), (may, "", "{}", 0)]
    runs_of.create_runs(events(spark, rows).drop("event_type", "order"))
    runs_of.append(events(spark, [(may, "run.started", "{}", 1)]))  # in March, of a run of May
    assert [r["event_type"] for r in runs_of.replay(may).collect()] == ["run.created", "run.started"]
    assert {r["run_id"]: str(r["partition_key"]) for r in runs_of.log().collect()} == {march: "2024-03-01", may: "2024-05-01"}
    plan = event_log.of_run(runs_of.log(), may)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_key" in plan and "2024-05-01" in plan
