"""Substring dedup by seed and extend.

Seeds are winnowed anchors: word sequences shorter than a window, so chosen that equal windows
hold equal anchors. Documents meet at equal anchors and the match is extended both ways. First by
the whole context, which is all that windows around the anchor can hold: documents that share it
match as far as any window there reaches, so of each class of equal contexts only the first
document goes on. Where an anchor has several contexts, the first of each extends window by
window. What an earlier document also holds is marked; overlapping windows make maximal repeats,
all of them at least a window long. No pair of documents is ever listed: work is linear in the
anchors, and a group of copies of any size is one class.

Documents are matched by 128 bits: the hashes of an anchor and its context, or of a window and of its
halves. 2**43 windows, some 100 TB, leave a chance of 2**-43 that two different ones are taken for equal.

Defined cases: a null text has no words; a text shorter than a window keeps all; a null doc_id is
neither earlier nor later than another and keeps all; rows that share a doc_id are not earlier
than each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.llm import windows
from runweave.llm.common import by_key, numbers, over_rows, text_bytes, written

WINDOW, SEED = 50, 30


def _windows(data: np.ndarray, offsets: np.ndarray, window: int, seed: int) -> tuple[windows.Windows, np.ndarray, np.ndarray]:
    units, starts, ends, first = windows.words(data, offsets)
    return windows.Windows(units, first, window, seed), starts, ends


def seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(anchor, context, doc_id, told), each once for a document.

    Of documents of a batch that share a context only the first competes with those of other
    batches; the others hold what an earlier one has, whatever those do. They are ``told`` and dealt
    out by a key of their own, so copies are added up before the shuffle."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, found = numbers(batch, "doc_id"), []
            for row, end, data, offsets in windows.pieces(batch, "text"):
                w, _, _ = _windows(data, offsets, window, seed)
                at, anchor = w.anchors()
                rows = np.stack([anchor, w.contexts(at)[2], ids[row:end][w.doc[at]].astype(np.int64).view(np.uint64)])
                found.append(rows)
            anchor, context, doc = np.concatenate(found, axis=1)
            doc = doc.view(np.int64)
            order = np.lexsort((doc, context, anchor))
            anchor, context, doc = anchor[order], context[order], doc[order]
            fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]))[: len(doc)]
            once = fresh | np.append(True, doc[1:] != doc[:-1])[: len(doc)]
            first = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(doc) else doc
            told = doc > first
            anchor = np.where(told, windows.mix(context ^ doc.view(np.uint64)), anchor)
            columns = [anchor.view(np.int64), context.view(np.int64), doc, told]
            return pa.RecordBatch.from_arrays([pa.array(x[once]) for x in columns], names=["anchor", "context", "doc_id", "told"])

        return each

    return over_rows(docs, make, "anchor long, context long, doc_id long, told boolean")


def met(rows: DataFrame) -> DataFrame:
    """(doc_id, context, earlier): contexts that an earlier document also has (true), and those of
    a class's first documents where the anchor has other contexts too (false)."""

    def each(columns: list[np.ndarray], new: np.ndarray, state: dict) -> pa.RecordBatch:
        anchor, context, doc, known = columns
        # carried from the batch before: the class that is open, its first document, whether its
        # anchor has several classes, and the first rows of the anchor's first class if not
        if not new[0]:
            anchor = np.concatenate((np.full(len(state["context"]), anchor[0]), anchor))
            context, doc = np.concatenate((state["context"], context)), np.concatenate((state["doc"], doc))
            several, told = state["several"], len(state["context"])
            known = np.concatenate((np.zeros(told, bool), known))
            new = np.concatenate(([True], np.zeros(told - 1, bool), [False], new[1:]))
        else:
            several, told = False, 0
        begins = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        fresh = new | np.append(True, context[1:] != context[:-1])
        classes = np.add.reduceat(fresh, begins)
        many = classes > 1
        many[0] |= several
        first = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        earlier, rep = doc > first, (doc == first) & many[group]
        # rows told before: those of the open class; first rows that were told as such stay told
        old = np.arange(len(doc)) < told
        earlier = (earlier | known) & ~old
        rep &= ~known
        if several:
            rep &= ~old
        # the next batch may go on with the last anchor: keep its last class's first rows, and
        # while it is the only class also for telling them later
        tail = np.flatnonzero((np.arange(len(doc)) >= np.flatnonzero(fresh)[-1]) & (doc == first))
        state.update(context=context[tail], doc=doc[tail], several=bool(many[-1]))
        take = earlier | rep
        return pa.RecordBatch.from_arrays([pa.array(doc[take]), pa.array(context[take]), pa.array(earlier[take])], names=["doc_id", "context", "earlier"])

    return by_key(rows, "anchor", ["context", "doc_id"], each, "doc_id long, context long, earlier boolean")


def held_earlier(rows: DataFrame) -> DataFrame:
    """(doc_id, context): of (context, check, doc_id) rows those whose context and check an earlier
    document has."""

    def each(columns: list[np.ndarray], new: np.ndarray, state: dict) -> pa.RecordBatch:
        context, check, doc = columns
        fresh = new | np.append(new[0] or check[0] != state["check"], check[1:] != check[:-1])
        firsts = doc[fresh]
        if not fresh[0]:
            firsts = np.append(state["first"], firsts)
        first = firsts[np.cumsum(fresh) - int(fresh[0])]
        state.update(first=first[-1], check=check[-1])
        take = doc > first
        return pa.RecordBatch.from_arrays([pa.array(doc[take]), pa.array(context[take])], names=["doc_id", "context"])

    return by_key(rows, "context", ["check", "doc_id"], each, "doc_id long, context long")


def extended(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(context, check, doc_id): hashes of the windows that hold one of the row's ``contexts``, and
    further ones of their halves."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, lists = numbers(batch, "doc_id"), batch.column(batch.schema.get_field_index("contexts"))
            found = []
            for row, end, data, offsets in windows.pieces(batch, "text"):
                w, _, _ = _windows(data, offsets, window, seed)
                at, _ = w.anchors()
                start, stop, context = w.contexts(at)
                own = ranges_in(w.doc[at], end - row)
                for i in range(end - row):
                    s = slice(own[i], own[i + 1])
                    wanted = np.isin(context[s], lists[row + i].values.to_numpy().view(np.uint64))
                    marks = np.zeros(w.first[i + 1] - w.first[i] + 1, np.int64)
                    np.add.at(marks, start[s][wanted] - w.first[i], 1)
                    np.add.at(marks, stop[s][wanted] - window + 1 - w.first[i], -1)
                    p = w.first[i] + np.flatnonzero(np.cumsum(marks)[:-1])
                    whole, one = np.unique(w.at(p), return_index=True)
                    p, half = p[one], window // 2
                    check = windows.mix(windows.hashes(w.sums, p, p + half)) ^ windows.hashes(w.sums, p + half, p + window)
                    found.append((whole.view(np.int64), check.view(np.int64), np.full(len(p), ids[row + i], np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["context", "check", "doc_id"])

        return each

    return over_rows(docs, make, "context long, check long, doc_id long")


def ranges_in(doc: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of n documents begin in a sorted array of document numbers."""
    return np.searchsorted(doc, np.arange(n + 1))


def marked(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, contexts): hashes of contexts and windows that an earlier document holds too."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    shared = written(met(seeds(texts, window, seed)), "seeds")
    lists = lambda rows: rows.groupBy("doc_id").agg(F.collect_list("context").alias("contexts"))  # noqa: E731  as long as the text at most
    first = texts.join(lists(shared.where("not earlier").select("doc_id", "context").distinct()), "doc_id")
    fine = held_earlier(extended(first, window, seed))
    return lists(shared.where("earlier").select("doc_id", "context").union(fine))


def removed_words(w: windows.Windows, i: int, at: np.ndarray, start: np.ndarray, stop: np.ndarray, context: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which words of document i lie in a repeat."""
    begin, end = int(w.first[i]), int(w.first[i + 1])
    marks = np.zeros(end - begin + 1, np.int64)
    if not len(held):
        return marks[:-1].astype(bool)
    wanted = np.isin(context, held)
    np.add.at(marks, start[wanted] - begin, 1)
    np.add.at(marks, stop[wanted] - begin, -1)
    p = np.arange(begin, end - w.window + 1)
    p = p[np.isin(w.at(p), held)] - begin
    np.add.at(marks, p, 1)
    np.add.at(marks, p + w.window, -1)
    return np.cumsum(marks)[:-1] > 0


def with_marks(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """All rows of ``docs``, with their ``_runweave_contexts`` (null: none)."""
    marks = marked(docs, window, seed).toDF("_runweave_id", "_runweave_contexts")
    return docs.join(marks, docs["doc_id"] == marks["_runweave_id"], "left").drop("_runweave_id")


def _kept(batch: pa.RecordBatch, text: str, window: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, bytes, list[tuple[int, int]]]]:
    """(row, words, removed, text in bytes, (start, end) of words) for each row of a batch."""
    lists = batch.column(batch.schema.get_field_index("_runweave_contexts"))
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    for row, end, data, offsets in windows.pieces(batch, text):
        w, starts, ends = _windows(data, offsets, window, seed)
        if valid[row:end].any():
            at, _ = w.anchors()
            start, stop, context = w.contexts(at)
            own = ranges_in(w.doc[at], end - row)
        raw = data.tobytes()
        for i in range(end - row):
            a, b = int(w.first[i]), int(w.first[i + 1])
            gone = np.zeros(b - a, bool)
            if valid[row + i]:
                s = slice(own[i], own[i + 1])
                gone = removed_words(w, i, at[s], start[s], stop[s], context[s], lists[row + i].values.to_numpy().view(np.uint64))
            whole = raw[int(offsets[i]) : int(offsets[i + 1])]
            if gone.any():
                keep = np.flatnonzero(~gone) + a
                kept = b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
            else:
                kept = None
            yield row + i, b - a, gone, whole, kept


def digests(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (the kept words joined by one space), and spans:
    the maximal repeats as (start, end) in words."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, gone_counts, sha, spans = [], [], [], []
            for _, n, gone, whole, kept in _kept(batch, "text", window, seed):
                counts.append(n)
                gone_counts.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(whole.split()) if kept is None else kept).hexdigest())
                edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, span)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
            )

        return each

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return over_rows(with_marks(texts, window, seed), make, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The documents without their repeats, in their columns; a text that loses words is its kept
    words joined by one space, with ``n_chars`` set anew. A document that loses all its words goes."""
    schema = docs.schema
    names = schema.names
    marks = with_marks(docs, window, seed).withColumn("_runweave_text", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    plain = marks.where("_runweave_contexts is null").select(names)  # nothing to remove: rows stay as they are

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, texts = [], []
            for row, n, gone, whole, kept in _kept(batch, "_runweave_text", window, seed):
                if not n or not gone.all():
                    keep.append(row)
                    texts.append((whole if kept is None else kept).decode())
            out = batch.select(names).take(pa.array(keep, pa.int64()))
            i = out.schema.get_field_index("text")
            out = out.set_column(i, "text", pa.array(texts, out.schema.field(i).type))
            if "n_chars" in names:
                i = names.index("n_chars")
                out = out.set_column(i, "n_chars", pa.array([len(t) for t in texts], out.schema.field(i).type))
            return out

        return each

    return plain.union(over_rows(marks.where("_runweave_contexts is not null"), make, T.StructType(schema.fields)))
