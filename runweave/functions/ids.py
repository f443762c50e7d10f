"""Time-ordered ids, month partitions and idempotency keys, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7(millis: Column, seed: Column) -> Column:
    """A version-7 UUID: 48 bits of milliseconds, the rest from a hash of ``seed``."""
    bits = F.lower(F.lpad(F.hex(F.xxhash64(seed)), 16, "0"))
    more = F.lower(F.lpad(F.hex(F.xxhash64(seed, F.lit(7))), 16, "0"))
    time = F.lower(F.lpad(F.hex(millis), 12, "0"))
    variant = F.substring(F.lit("89ab"), F.pmod(F.xxhash64(seed), F.lit(4)).cast("int") + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(bits, 1, 3)),
        F.concat(variant, F.substring(bits, 4, 3)), F.substring(more, 1, 12),
    )


def uuid7_millis(id_: Column) -> Column:
    """The milliseconds of a version-7 UUID; null for any other version or shape."""
    ok = id_.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return F.when(ok, F.conv(F.substring(F.replace(id_, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long"))


def month_of(moment: Column) -> Column:
    """The first day of the month: the partition that an id's time belongs to."""
    return F.trunc(moment.cast("date"), "month")


def month_of_run(run_id: Column, moment: Column) -> Column:
    """The partition of all of a run's events: the month (UTC) of its version-7 id, else of ``moment``."""
    made = F.timestamp_millis(uuid7_millis(run_id))
    return F.coalesce(F.trunc(F.to_utc_timestamp(made, F.current_timezone()).cast("date"), "month"), month_of(moment))


def idempotency_key(run: Column, node: Column, attempt: Column, call: Column) -> Column:
    return F.concat_ws(":", run, node, attempt, call)


def key_parts(key: Column) -> Column:
    return F.split(key, ":")
