"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order (doc_id, size, crc32 of the text); null ids come first.
A keyed Feistel network over Z_a x Z_b, a = ceil(sqrt(N)), b = ceil(N / a), permutes a domain
that is less than ``a`` larger than N; values at or above N walk their cycle until they fall
below it. shard = p mod shards and slot = p div shards, so the counts of two shards differ by one
at most and both follow from a row's number alone, without a shuffle of the texts.

Defined cases: a null text has size 8 and the crc of the empty text; repeated rows get row
numbers of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import running_total, written

ROUNDS = 6


def feistel(x: Column, a: Column, b: Column, key: int) -> Column:
    """One pass of the network: a bijection of 0..a*b-1."""
    left, right = F.floor(x / b).cast("long"), x % b
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = (left + F.pmod(F.xxhash64(right, F.lit(key + i)), a)) % a
        else:
            right = (right + F.pmod(F.xxhash64(left, F.lit(key + i)), b)) % b
    return left * b + right


def walk(x: Column, n: Column, a: Column, b: Column, key: int, steps: Column) -> Column:
    """Follow the cycle of ``x`` for up to ``steps`` passes, or until it is below ``n``."""
    one = lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, key))
    return F.when(x < n, x).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), steps), x, one))


def permuted(rows: DataFrame, number: str, total: str, key: int) -> DataFrame:
    """Add ``position``: where row ``number`` of ``total`` stands after the shuffle.

    A walk visits each of the a*b - N values outside at most once, so that many steps and one
    always end it; eight steps end nearly all."""
    n, a, b = F.col(total), F.col("feistel_a"), F.col("feistel_b")
    rows = rows.withColumn("feistel_a", F.ceil(F.sqrt(F.col(total))).cast("long")).withColumn(
        "feistel_b", F.ceil(n / a).cast("long")
    )
    rows = rows.withColumn("position", feistel(F.col(number), a, b, key))
    rows = rows.withColumn("position", walk(F.col("position"), n, a, b, key, F.lit(8).cast("long")))
    rows = rows.withColumn("position", walk(F.col("position"), n, a, b, key, a * b - n + 1))
    return rows.drop("feistel_a", "feistel_b")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the global ``row_number`` of each row, with the total ``n_rows``.

    Only these narrow columns are sorted. Partition and place are written with the rows, so what
    is numbered cannot change when a lost task runs again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "size", "text_crc32"]
    place = F.monotonically_increasing_id()
    slim = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    slim = slim.withColumns({"part": F.spark_partition_id(), "place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    slim = written(slim, "sharding")
    parts = running_total(slim.groupBy("part").agg(F.count("*").alias("rows")), "part", "rows")
    parts = parts.select("part", "before", F.col("total").alias("n_rows"))  # one row for each partition of the sort
    return slim.join(F.broadcast(parts), "part").withColumn("row_number", F.col("before") + F.col("place")).drop("part", "place", "before")


def shard(docs: DataFrame, shards: int = 24, key: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every document."""
    out = permuted(numbered(docs), "row_number", "n_rows", key)
    return out.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / shards).cast("long")}).drop("position", "n_rows")
