"""Versioned payloads: decode, upcast, and quarantine instead of exceptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Payload:
    """Field names and types of the current version, and a step up from each earlier one, over the
    payload as a map of variants. A type is one of Spark's, or ``object`` or ``array`` of anything."""

    version: int
    fields: dict[str, str]
    steps: dict[int, Callable[[Column], Column]] = field(default_factory=dict)


class Registry:
    def __init__(self):
        self.types: dict[str, Payload] = {}

    def register(self, event_type: str, payload: Payload) -> None:
        if event_type in self.types:
            raise ValueError(f"{event_type} is registered already")
        if set(payload.steps) != set(range(1, payload.version)):
            raise ValueError(f"{event_type}: a step up is missing or superfluous")
        self.types[event_type] = payload

    def current_version(self, event_type: Column) -> Column:
        return F.element_at(F.create_map(*[x for t, p in self.types.items() for x in (F.lit(t), F.lit(p.version))]), event_type)

    def catalog(self, spark: SparkSession) -> DataFrame:
        """event_type, version, field, type of every registered payload."""
        rows = [(t, p.version, n, k) for t, p in sorted(self.types.items()) for n, k in p.fields.items()]
        return spark.createDataFrame(rows, "event_type string, version int, field string, type string")

    def decoded(self, log: DataFrame) -> DataFrame:
        """``log`` with ``payload`` stepped up to the current version and ``decode_error``: null, or the
        first that holds of unknown_type, future_version, invalid_json (no object, or a field twice),
        unknown_field, missing_field, wrong_type. A payload with one of the first three stays as it is."""
        known = self.current_version(F.col("event_type"))
        object_ = F.when(F.try_parse_json("payload").isNotNull() & F.json_object_keys("payload").isNotNull(), F.col("payload"))
        fields = F.from_json(object_, "map<string,variant>")
        extra = missing = wrong = None
        log = log.withColumns({"known_version": known, "_fields": fields})
        current = F.col("_fields")
        alike: dict[tuple, list[str]] = {}  # types of equal payloads share their expressions
        for t, p in self.types.items():
            alike.setdefault((p.version, tuple(p.fields.items()), tuple(sorted(p.steps.items()))), []).append(t)
        for (_, _, steps), types in alike.items():
            up = F.col("_fields")
            for version, step in steps:
                up = F.when(F.col("payload_version") <= version, step(up)).otherwise(up)
            current = F.when(F.col("event_type").isin(types), up).otherwise(current)
        log = log.withColumn("_fields", F.when(F.col("payload_version") <= F.col("known_version"), current).otherwise(F.col("_fields")))
        names = F.map_keys("_fields")
        for (_, fields, _), types in alike.items():
            here, own = F.col("event_type").isin(types), F.array(*[F.lit(n) for n, _ in fields])
            bad = F.array_compact(F.array(*[F.when(~_fits(F.element_at("_fields", n), kind), F.lit(n)) for n, kind in fields]))
            extra = F.when(here, F.array_except(names, own)) if extra is None else extra.when(here, F.array_except(names, own))
            missing = F.when(here, F.array_except(own, names)) if missing is None else missing.when(here, F.array_except(own, names))
            wrong = F.when(here, bad) if wrong is None else wrong.when(here, bad)
        log = log.withColumns({"unknown_fields": extra, "_missing": missing, "_wrong": wrong})
        error = (
            F.when(F.col("known_version").isNull(), "unknown_type").when(F.col("payload_version") > F.col("known_version"), "future_version").when(F.col("_fields").isNull(), "invalid_json")
            .when(F.size("unknown_fields") > 0, "unknown_field").when(F.size("_missing") > 0, "missing_field").when(F.size("_wrong") > 0, "wrong_type")
        )
        log = log.withColumn("decode_error", error)
        stays = F.col("decode_error").isin("unknown_type", "future_version", "invalid_json")
        return log.withColumn("payload", F.when(stays, F.col("payload")).otherwise(F.to_json("_fields"))).drop("_fields", "_missing", "_wrong")


def _fits(value: Column, kind: str) -> Column:
    """Whether a field that is there has the type; an absent one is not judged here."""
    if kind in ("object", "array", "string"):
        fits = F.schema_of_variant(value).startswith(kind.upper())
    else:
        fits = F.try_variant_get(value, "$", kind).isNotNull()
    return F.coalesce(fits, F.lit(False)) | value.isNull()


def with_default(name: str, json: str) -> Callable[[Column], Column]:
    """A step up that adds a field, or sets it anew."""
    return lambda fields: F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), F.parse_json(F.lit(json))))


def counted_registry() -> Registry:
    """The payloads of the event stream: ``k`` in version 1, ``k`` and ``count`` in version 2."""
    registry, up = Registry(), with_default("count", "0")
    for t in ("signup", "view", "purchase", "error"):
        registry.register(t, Payload(2, {"k": "bigint", "count": "bigint"}, {1: up}))
    return registry


#: The payload fields of every event type of a run's log, in version 1.
RUN_PAYLOADS = {
    "run.created": {"input": "object"},
    "run.started": {"worker": "string"},
    "run.succeeded": {"result": "object"},
    "run.failed": {"error_class": "string", "message": "string"},
    "run.cancelled": {"reason": "string"},
    "node.added": {"node_id": "string", "role": "string", "dependencies": "array", "retry_policy": "object", "budget": "object", "reflection_depth": "bigint"},
    "edge.added": {"from_node": "string", "to_node": "string", "edge_type": "string"},
    "node.started": {"node_id": "string", "attempt": "bigint"},
    "node.succeeded": {"node_id": "string", "output": "object"},
    "node.failed": {"node_id": "string", "attempt": "bigint", "error_class": "string", "message": "string"},
    "node.skipped": {"node_id": "string", "reason": "string"},
    "tool.requested": {"node_id": "string", "tool": "string", "args": "object", "idempotency_key": "string"},
    "tool.completed": {"idempotency_key": "string", "result": "object"},
    "tool.failed": {"idempotency_key": "string", "error_class": "string", "message": "string"},
    "tool.indeterminate": {"idempotency_key": "string", "reason": "string"},
}


def run_registry() -> Registry:
    """The payloads of run, node, edge and tool events."""
    registry = Registry()
    for t, fields in RUN_PAYLOADS.items():
        registry.register(t, Payload(1, fields))
    return registry
