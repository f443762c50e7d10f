"""I-Match fingerprints: terms of a document-frequency band, hashed over randomised lexicons.

A term is a word between ASCII white space, ASCII letters lowered, known by a 64-bit hash. Terms
in at least ``RARE`` and at most ``COMMON`` of all documents are kept, so their number is at most
the mean number of terms of a document divided by RARE, whatever the size of the corpus: that
bounds what is broadcast. A text's kept terms are sorted, each once. ``LEXICONS`` random lexicons
are nested in levels, a level holding half of the one before; a text takes the level at which a
lexicon holds a quarter to half of one of its terms, and hashes, for each lexicon, the sequence of
its terms there. Two fingerprints are as alike as the share of lexicons that agree, of those where
either has a term; for equal sizes that is close to the share of terms in common.

A text without a term of the band takes all its terms instead. Copies may hold up to COMMON of
all rows and keep their terms.

Defined cases: a null text is empty; texts without words share one fingerprint; doc_ids may repeat
(ordered by text then) or be null (after all others in descending order); an only document is its
own next one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm import windows
from runweave.llm.common import over_rows, text_bytes

#: Least and greatest share of documents that hold a kept term; random lexicons; levels stored.
RARE, COMMON, LEXICONS, LEVELS = 1 / 500, 0.4, 128, 3
FLUSH_TERMS = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and each text's first word."""
    units, _, _, first = windows.words(_LOWER[data], offsets)
    return units, first


def distinct_terms(units: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct terms, sorted."""
    for i in range(len(first) - 1):
        yield np.unique(units[first[i] : first[i + 1]])


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, n): in how many documents each term stands. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

        for batch in batches:
            for _, _, data, offsets in windows.pieces(batch, "text"):
                for own in distinct_terms(*terms_of(data, offsets)):
                    held.append(own)
                    size += len(own)
                if size >= FLUSH_TERMS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select(text_bytes()).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def band(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> np.ndarray:
    """The kept terms, sorted. At most (mean terms of a document) / rare of them."""
    n = docs.count()
    least = max(2, -(-n * rare // 1))
    kept = document_counts(docs).where((F.col("n") >= least) & (F.col("n") <= max(least, common * n))).select("term").toPandas()
    return np.sort(kept["term"].to_numpy(np.int64).view(np.uint64))


def depths(terms: np.ndarray) -> np.ndarray:
    """For each term and lexicon, the deepest level that holds it: half of the terms reach a level
    beyond another."""
    seeds = windows.mix(np.arange(1, LEXICONS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out = np.empty((len(terms), LEXICONS), np.uint8)
    for i in range(0, len(terms), 8192):
        x = windows.mix(terms[i : i + 8192, None] ^ seeds[None, :]) >> np.uint64(32)
        out[i : i + 8192] = 32 - np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)
    return out


class Lexicons:
    """Fingerprints of texts over the kept terms."""

    def __init__(self, kept: np.ndarray):
        self.kept, self.depth = kept, depths(kept)

    def fingerprint(self, terms: np.ndarray) -> str:
        """Of sorted distinct terms: the level, then for each stored level the lexicons that hold
        any of them, each with 16 bits of the hash of its terms in order."""
        if not len(terms):
            return "0"
        mark, depth = "", None
        if len(self.kept):
            at = np.minimum(np.searchsorted(self.kept, terms), len(self.kept) - 1)
            inside = self.kept[at] == terms
            if inside.any():
                terms, depth = terms[inside], self.depth[at[inside]]
        if depth is None:
            mark, depth = "*", depths(terms)
        level = max(1, int(np.ceil(np.log2(len(terms)))) + 1)
        which, lexicon = np.nonzero(depth >= level)
        order = np.argsort(lexicon, kind="stable")  # by lexicon, terms in order
        which, lexicon = which[order], lexicon[order]
        deepest, mixed, out = depth[which, lexicon], windows.mix(terms[which]), [f"{level}{mark}"]
        for j in range(level, level + LEVELS):
            take = np.flatnonzero(deepest >= j)
            own = lexicon[take]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            if not len(cuts):
                out.append("")
                continue
            place = np.arange(len(take)) - np.repeat(cuts, np.diff(np.append(cuts, len(take))))
            value = windows.mix(np.add.reduceat(mixed[take] * windows.powers(len(terms) + 1)[0][place], cuts))
            entry = np.stack([own[cuts], value >> np.uint64(8) & np.uint64(255), value & np.uint64(255)], axis=1)
            out.append(entry.astype(np.uint8).tobytes().hex())
        return ":".join(out)


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of lexicons that agree, where either fingerprint has a term, at the deeper
    of the two levels. Sizes that are more than two levels apart are not alike."""
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    if len(x) < 2 or len(y) < 2:
        return 0.0
    levels = [int(v[0].rstrip("*")) for v in (x, y)]
    deep = max(levels)
    if deep - min(levels) >= LEVELS:
        return 0.0
    own, other = ({s[i : i + 2]: s[i + 2 : i + 6] for i in range(0, len(s), 6)} for s in (v[1 + deep - n] for v, n in zip((x, y), levels, strict=True)))
    either = len(own.keys() | other.keys())
    return sum(other.get(k) == v for k, v in own.items()) / either if either else 0.0


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, edge, key, doc_id, text) of all documents: buckets are ranges of doc_id, and each
    also gets, marked ``edge``, the document that follows its last one in descending order.

    One row for each bucket comes to the driver; texts are shuffled once."""
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 100 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    shared = spark.sparkContext.broadcast(np.array(cuts, np.int64))  # four for each shuffle partition

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy()).astype(np.int32))

    rows = rows.withColumn("bucket", bucket("key"))
    ends = sorted(rows.groupBy("bucket").agg(F.min("key"), F.max("key")).collect())
    after = [(ends[i - 1][2], ends[i][0]) for i in range(len(ends))]  # the greatest key of the bucket below, the last for the first
    follow = spark.createDataFrame(after, "key long, bucket int")
    edges = rows.drop("bucket").join(F.broadcast(follow), "key").select("bucket", F.lit(True).alias("edge"), "key", "doc_id", "text")
    return rows.select("bucket", F.lit(False).alias("edge"), "key", "doc_id", "text").union(edges)


def compared(docs: DataFrame, kept: np.ndarray) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to that and to the
    next document's. Rows stream in descending doc_id order; one document waits for its next."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = Lexicons(shared.value)
        waiting = None  # (bucket, doc_id, text, fingerprint)

        def edited(now: tuple, text: str) -> tuple[tuple, bytes]:
            n = len(now[2])
            return now, (now[2][: n - n // 3] + text[: n // 3]).encode()

        for batch in batches:
            buckets, edges, _, ids, texts = (c.to_pylist() for c in batch.columns)
            prints = []
            for _, _, data, offsets in windows.pieces(batch, "text"):
                prints += [lexicons.fingerprint(t) for t in distinct_terms(*terms_of(data, offsets))]
            pairs = []
            for bucket, edge, name, raw, own in zip(buckets, edges, ids, texts, prints, strict=True):
                text = raw.decode()
                if waiting and waiting[0] == bucket:
                    pairs.append((*edited(waiting, text), own))
                waiting = None if edge else (bucket, name, text, own)
            if not pairs:
                continue
            again = pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.large_binary())], names=["text"])
            new = []
            for _, _, data, offsets in windows.pieces(again, "text"):
                new += [lexicons.fingerprint(t) for t in distinct_terms(*terms_of(data, offsets))]
            out = [
                (now[1], len(now[2]), hashlib.sha256(text).hexdigest(), now[3], changed, likeness(now[3], changed), likeness(now[3], following))
                for (now, text, following), changed in zip(pairs, new, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])

    ordered = in_order(docs).repartition("bucket").sortWithinPartitions("bucket", "edge", F.desc("key"), "text")
    return ordered.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, kept: np.ndarray) -> DataFrame:
    """doc_id and fingerprint of every document, without order."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def make():
        lexicons = Lexicons(shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for _, _, data, offsets in windows.pieces(batch, "text"):
                out += [lexicons.fingerprint(t) for t in distinct_terms(*terms_of(data, offsets))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

        return each

    return over_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), make, "doc_id long, fingerprint string")
