"""Helpers that the corpus operators share: shared tables, Arrow batches, document keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runweave.sources.staging import forget_at_exit, shared_dir

#: Rows of one Arrow batch: long texts must not gather in a worker.
BATCH_ROWS = 400
BATCH_BYTES = 8 << 20
#: Words of 64 bits that tell which keys are among others: two million keys let one in nine of the others pass.
SIEVE = 1 << 18


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here. The
    table goes when the application ends."""
    path = f"{shared_dir(df.sparkSession)}-{name}"
    forget_at_exit(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of documents holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("text")


def text_hash() -> Column:
    """A text's 64-bit hash: with the doc_id it tells rows apart that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def over_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that is made once for each task and called for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def by_key(df: DataFrame, key: str, order: list[str], each: Callable, schema: str) -> DataFrame:
    """Deal rows by ``key``, sort them, and stream them through ``each(columns, new, state)``.

    ``new`` marks rows whose key differs from the row before, across batches too; ``state`` is a
    dict that stays between batches. Memory does not grow with the rows of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = columns[0]
            new = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
            last = keys[-1]
            yield each(columns, new, state)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def sifted(rows: DataFrame, keys: list[str], some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts, without a shuffle: all whose ``keys`` (not null) are in ``some``, with a few others that
    share a bit with one of those, and the rest. What is broadcast has SIEVE rows at most, however many ``some`` has."""
    hashed = F.xxhash64(*keys)
    word = F.pmod(hashed, F.lit(SIEVE)).alias("_runweave_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hashed, 40), F.lit(64)).cast("int"))
    sieve = written(some.select(word, bit.alias("bit")).groupBy("_runweave_word").agg(F.bit_or("bit").alias("_runweave_bits")), "sieve")
    met = rows.withColumns({"_runweave_word": word, "_runweave_bit": bit}).join(F.broadcast(sieve), "_runweave_word", "left")
    hit = F.coalesce(F.col("_runweave_bits").bitwiseAND(F.col("_runweave_bit")) != 0, F.lit(False))
    return tuple(met.where(x).drop("_runweave_word", "_runweave_bit", "_runweave_bits") for x in (hit, ~hit))


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def numbers(batch: pa.RecordBatch, name: str, missing: int = 0) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return (col.fill_null(missing) if col.null_count else col).to_numpy(zero_copy_only=False)


def held_out(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``, is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == 1


def running_total(sizes: DataFrame, part: str, amount: str) -> DataFrame:
    """Add ``before``, the sum over the partitions below, and ``total``, the sum over all.

    ``sizes`` has one row for each partition of a table, never one for each document, so the
    window's single task stays small."""
    w = Window.orderBy(part)
    below = F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumns({"before": below, "total": F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
