"""Suffix-array dedup of byte strings: linear grouping construction over candidate contexts.

A suffix array over everything would have to stand in one place. So candidates come first:
winnowed anchors (20 bytes, one in every 50-byte string) meet by hash; documents whose whole
context of an anchor is alike match as far as any string around it reaches, and only the first of
them goes on. Those meet again by 35 bytes, to the left or to the right of the anchor, of which
every 50-byte string around it holds one. What then meets is put into one text, context after
context, and its suffixes are sorted by the linear construction: suffixes in groups of equal Lyndon
prefixes, the groups taken in descending order, each pulling the suffixes that its previous-smaller
pointers name out of their groups; then every group's order is emitted from left to right, without
renaming. Many texts are sorted at once, each step being one for all of them. Equal 50-byte strings
stand side by side in the order.

What is told apart by hashes alone: contexts of equal copies (32 bits of the anchor and 64 of the
context) before the sort, and equal sub-parts of a large group (64 bits within its key); whatever else
meets is compared byte by byte.

Hot lines: copies of a context are added up in each task before the shuffle and are dealt by
document then. A 35-byte key that very many documents hold with different surroundings (found in a
sample of documents; the choice changes the work, not the result) is not sorted as one text: its
strings are dealt by their own hash, and those that a task has seen in an earlier document already
are settled in the task.

Seeds travel as packed arrays, a row for each shard of the hash space and run of documents, and
texts compressed, because both outweigh the work on them otherwise.

Defined cases: a null text is empty; a text below 50 bytes keeps all; a null doc_id is neither
earlier nor later than another and keeps all; rows that share a doc_id are not earlier than each
other and are told apart by 28 bits of their text's hash; an empty table gives an empty result;
matches never cross documents; a text is shorter than 2**31 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm import windows
from runweave.llm.common import columns, numbers, over_rows, text_bytes, written

WINDOW, SEED = 50, 20
REACH = WINDOW - SEED
HALF = REACH // 2
KEY = SEED + HALF
#: Seeds in a packed run, bytes of a text to sort and of texts that are sorted together, bytes of parts that
#: wait for it, spans found before they are handed on.
RUN_SEEDS, SMALL, TOGETHER, WAITING, FOUND = 1 << 19, 400, 1 << 18, 1 << 21, 1 << 16
#: One in so many documents is looked at for hot keys, a hot key is in so many of those, and hot keys at most.
SAMPLE, HOT, HOT_KEYS, HOT_SEEN = 64, 64, 100_000, 1_000_000
#: A place: a byte of a text (31 bits), of a part where its key begins (4), and the text's check (28).
_AT, CHECK = np.int64((1 << 31) - 1), 35


def suffix_arrays(letters: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Suffixes of each text in order, text after text, as places in ``letters``.

    ``begin``: where texts begin, and the end. Each text's last letter must be its only least one.
    Every step is taken in all texts at once: one group of each, or one place of each order."""
    n, size_of = len(letters), np.diff(begin)
    text = np.repeat(np.arange(len(size_of)), size_of)
    key = text * (int(letters.max(initial=0)) + 1) + letters
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    fresh = np.append(True, ordered[1:] != ordered[:-1])[:n]
    starts = np.flatnonzero(fresh)
    place, group, size = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    place[sa] = np.arange(n)
    group[sa] = starts[np.cumsum(fresh) - 1]
    size[starts] = np.diff(np.append(starts, n))
    prev = np.arange(-1, n - 1)
    prev[begin[:-1]] = -1
    moved = np.zeros(n, bool)
    end = begin[1:] - 1
    while True:  # the greatest group that is left of each text
        open_ = np.flatnonzero(end >= begin[:-1])
        if not len(open_):
            break
        last = end[open_]
        start = group[sa[last]]
        end[open_] = start - 1
        i, low = _ranges(sa, start, last + 1)
        p = prev[i]
        todo = np.flatnonzero((p >= 0) & (group[p] >= low))
        while len(todo):  # writing pointers back each time doubles the jumps
            p[todo] = prev[p[todo]]
            prev[i[todo]] = p[todo]
            todo = todo[(p[todo] >= 0) & (group[p[todo]] >= low[todo])]
        prev[i] = p
        p = np.sort(p[p >= 0])
        if not len(p):
            continue
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        child, times = p[first], np.diff(np.append(first, len(p)))
        of = group[child]
        order = np.lexsort((times, of))
        child, times, of = child[order], times[order], of[order]
        cut = np.append(True, of[1:] != of[:-1])
        whole = np.flatnonzero(cut)
        many = np.diff(np.append(whole, len(of)))
        tail = of[whole] + size[of[whole]] - many
        to = np.repeat(tail - whole, many) + np.arange(len(of))  # the last places of the group
        moved[child] = True
        out = sa[to]
        out = out[~moved[out]]  # what stands there and stays behind fills the holes
        holes = place[child]
        holes = holes[holes < np.repeat(tail, many)]
        sa[holes], place[out] = out, holes
        sa[to], place[child] = child, to
        moved[child] = False
        cut[1:] |= times[1:] != times[:-1]
        new = np.flatnonzero(cut)
        sizes = np.diff(np.append(new, len(of)))
        size[of[whole]] -= many
        size[to[new]] = sizes
        group[child] = np.repeat(to[new], sizes)
    out, free, done = np.empty(n, np.int64), np.arange(n), np.zeros(n, bool)
    out[begin[:-1]] = begin[1:] - 1
    done[begin[1:] - 1] = True
    by_size = np.argsort(-size_of, kind="stable")
    base, sizes = begin[:-1][by_size], -size_of[by_size]
    for k in range(int(size_of.max(initial=0))):
        own = base[: int(np.searchsorted(sizes, -k))]  # texts longer than k
        i = out[own + k] - 1
        i = i[i >= own]
        i = i[~done[i]]
        while len(i):
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            done[i] = True
            i = prev[i]
            i = i[i >= 0]
            i = i[~done[i]]
    return out


def _ranges(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all ranges one after another, and each one's range start."""
    n = stop - start
    low = np.repeat(start, n)
    return values[low + np.arange(len(low)) - np.repeat(np.cumsum(n) - n, n)], low


def refined(sums: np.ndarray, rows: np.ndarray, need: int) -> tuple[np.ndarray, int]:
    """Sub-parts that agree on more than their key, and the bytes that a string still has beyond that.

    ``rows``: key, part, document, start and stop of a sub-part, start and stop of the key in it. A string
    that holds the key goes on by half of ``need`` bytes to the left of it, or else to the right."""
    add = (need + 1) // 2
    _, part, doc, start, stop, low, high = rows
    out = []
    for side, a, z in ((low - add >= start, low - add, high), (high + add <= stop, low, high + add)):
        a, z = a[side], z[side]
        key = windows.hashes(sums, a, z).view(np.int64)
        out.append(np.stack([key, part[side], doc[side], np.maximum(start[side], a - (need - add)), np.minimum(stop[side], z + (need - add)), a, z]))
    return np.concatenate(out, axis=1), need - add


def repeated(joined: np.ndarray, rows: np.ndarray, small: int | None = None) -> list[np.ndarray]:
    """[part, start, size] arrays: where parts hold 50-byte strings that a part of a smaller doc_id with
    the same key holds too. ``rows``: as for ``refined``; different parts of each key, all in ``joined``.

    The parts of a key are one text to sort, if it is ``small``; else they are dealt by more and more of
    what is beside the key first, equal ones by hash being settled by their documents."""
    small = SMALL if small is None else small
    sums, found, need = windows.prefix(windows.byte_units(joined)), [], WINDOW - KEY
    while True:
        if not rows.shape[1]:
            return found
        whole = windows.hashes(sums, rows[3], rows[4]).view(np.int64)
        order = np.lexsort((rows[2], whole, rows[0]))
        rows, whole = rows[:, order], whole[order]
        fresh = np.append(True, (rows[0, 1:] != rows[0, :-1]) | (whole[1:] != whole[:-1]))
        later = rows[2] > rows[2][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        again = later & (rows[4] - rows[3] >= WINDOW)
        found.append(np.stack([rows[1, again], rows[3, again], rows[4, again] - rows[3, again]]))
        rows, fresh = rows[:, ~later], fresh[~later]
        begin = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        stop = np.append(begin[1:], rows.shape[1])
        size = np.add.reduceat(rows[4] - rows[3] + 1, begin) + 1
        several = (np.minimum.reduceat(rows[2], begin) != np.maximum.reduceat(rows[2], begin)) & (need > 0)
        fits = several & ((size <= small) | (need < 2))
        begin_s, stop_s = begin[fits], stop[fits]
        order = np.argsort(size[fits], kind="stable")  # texts of like sizes together
        total = np.cumsum(size[fits][order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER, "right")))
            own, low = _ranges(np.arange(rows.shape[1]), begin_s[order[at:to]], stop_s[order[at:to]])
            row, start, length = _sorted(joined, rows[3, own], rows[4, own], low, rows[2, own])
            found.append(np.stack([rows[1, own[row]], rows[3, own[row]] + start, length]))
            at = to
        more = np.repeat(several & ~fits, stop - begin)
        rows, need = refined(sums, rows[:, more], need)


def _sorted(joined: np.ndarray, start: np.ndarray, stop: np.ndarray, text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, size) of the maximal runs of strings that a row of the same ``text`` and a smaller
    document holds too; rows stand by text."""
    size = stop - start
    last = np.append(text[1:] != text[:-1], True)
    extra = 1 + last  # a separator ends each row, a sentinel each text
    ends = np.cumsum(size + extra)
    at = ends - size - extra
    source, _ = _ranges(np.arange(len(joined)), start, stop)
    target, _ = _ranges(np.arange(ends[-1]), at, at + size)
    raw, letters = np.zeros(ends[-1] + WINDOW, np.uint8), np.zeros(ends[-1], np.int64)
    raw[target] = joined[source]
    letters[target] = raw[target].astype(np.int64) + 2
    letters[at + size] = 1
    owner = np.repeat(np.arange(len(size)), size + extra)
    left = (at + size)[owner] - np.arange(len(letters))
    sa = suffix_arrays(letters, np.append(0, ends[last]))
    sa = sa[left[sa] >= WINDOW]
    if not len(sa):
        return sa, sa, sa
    view, of = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[sa], text[owner[sa]]
    fresh = np.append(True, (of[1:] != of[:-1]) | (view[1:] != view[:-1]).any(1))
    own = doc[owner[sa]]
    first = np.minimum.reduceat(own, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    found = np.sort(sa[own > first])
    if not len(found):
        return found, found, found
    row = owner[found]
    begin = np.flatnonzero(np.append(True, (found[1:] != found[:-1] + 1) | (row[1:] != row[:-1])))
    return row[begin], found[begin] - at[row[begin]], np.diff(np.append(begin, len(found))) + WINDOW - 1


def _open(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its compressed texts as they were."""
    opened = zstandard.ZstdDecompressor()
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", pa.array([opened.decompress(t) for t in batch.column(at).to_pylist()], pa.large_binary()))


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, check and the compressed text."""

    def make():
        press = zstandard.ZstdCompressor(level=1)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            (texts,) = columns(batch, "text")
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(t) for t in texts], pa.binary())], names=["doc_id", "check", "text"])

        return each

    return over_rows(docs, make, "doc_id long, check long, text binary")


def check() -> Column:
    """28 bits of the text's hash, which tell rows apart that share a doc_id."""
    return F.pmod(F.xxhash64("text"), F.lit(1 << 28)).alias("check")


def packed_seeds(texts: DataFrame) -> DataFrame:
    """(shard, seeds, told): anchors, contexts, doc_ids and places of a run of documents, as packed
    arrays, and those of which the run has an earlier document with the same context. There are
    four shards for each shuffle partition, so a shard does not grow with the input if those do."""
    shards = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def dealt(shard: np.ndarray, rows: np.ndarray, kinds: list[str]) -> list[bytes]:
            rows = rows[:, np.argsort(shard, kind="stable")]
            ends = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards)))).tolist()
            return [b"".join(r[a:b].astype(t).tobytes() for r, t in zip(rows, kinds, strict=True)) for a, b in zip(ends[:-1], ends[1:], strict=True)]

        def flush() -> pa.RecordBatch:
            anchor, context, doc, place = np.concatenate(held, axis=1)
            order = np.lexsort((doc.view(np.int64), context, anchor))
            rows = np.stack([anchor[order], context[order], doc[order], place[order]])
            fresh = np.append(True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
            own = rows[2].view(np.int64)
            told = own > own[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            seeds = dealt((rows[0, ~told] >> np.uint64(40)).astype(np.int64) % shards, rows[:, ~told], ["<u4", "<u8", "<u8", "<u8"])
            known = dealt((windows.mix(rows[2, told]) >> np.uint64(40)).astype(np.int64) % shards, rows[2:, told], ["<u8", "<u8"])
            return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array(seeds, pa.binary()), pa.array(known, pa.binary())], names=["shard", "seeds", "told"])

        for batch in batches:
            ids, checks = numbers(batch, "doc_id").astype(np.int64), numbers(batch, "check").astype(np.int64) << CHECK
            for row, stop, data, offsets in windows.pieces(batch, "text"):
                w = _windows(data, offsets)
                at, anchor = w.anchors()
                doc = w.doc[at]
                place = at - offsets[doc] | checks[row:stop][doc]
                held.append(np.stack([anchor, w.contexts(at)[2], ids[row:stop][doc].view(np.uint64), place.view(np.uint64)]))
                size += len(at)
                if size >= RUN_SEEDS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return texts.mapInArrow(run, "shard int, seeds binary, told binary")


def met(seeds: DataFrame) -> DataFrame:
    """(doc_id, place, earlier): anchors whose context an earlier document has too (true), and those
    of first documents where the anchor has other contexts too (false). A shard of the hash space is
    sorted at a time."""
    names = ["doc_id", "place", "earlier"]

    def classes(blobs: list[bytes]) -> pa.RecordBatch:
        parts = []
        for blob in blobs:
            n = len(blob) // 28
            parts.append((np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<u8", n, 4 * n), np.frombuffer(blob, "<i8", n, 12 * n), np.frombuffer(blob, "<i8", n, 20 * n)))
        anchor, context, doc, place = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((doc, context, anchor))
        anchor, context, doc, place = anchor[order], context[order], doc[order], place[order]
        new = np.append(True, anchor[1:] != anchor[:-1])
        fresh = new | np.append(True, context[1:] != context[:-1])
        several = np.add.reduceat(fresh, np.flatnonzero(new))[np.cumsum(new) - 1] > 1
        earlier = doc > doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        take = earlier | several
        return pa.RecordBatch.from_arrays([pa.array(doc[take]), pa.array(place[take]), pa.array(earlier[take])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blobs = None, []
        for batch in batches:
            for s, blob, told in zip(*columns(batch, "shard", "seeds", "told"), strict=True):
                if s != shard and blobs:
                    yield classes(blobs)
                    blobs = []
                shard = s
                if blob:
                    blobs.append(blob)
                if told:
                    doc, place = np.frombuffer(told, "<i8").reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(np.ones(len(doc), bool))], names=names)
        if blobs:
            yield classes(blobs)

    return seeds.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "doc_id long, place long, earlier boolean")


def _cut(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, checks: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(key, doc, start, stop, start of the key) of the parts left and right of each text's anchors."""
    at = [p[p >> CHECK == c] & _AT for p, c in zip(lists, checks, strict=True)]
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in at])
    a = np.concatenate(at) + offsets[doc]
    b, e = offsets[doc], offsets[doc + 1]
    sums = windows.prefix(windows.byte_units(data))
    found = []
    for side, back, x, y in ((a - HALF >= b, HALF, np.maximum(a - REACH, b), np.minimum(a + KEY, e)), (a + KEY <= e, 0, np.maximum(a - HALF, b), np.minimum(a + WINDOW, e))):
        k = a[side] - back
        found.append((windows.hashes(sums, k, k + KEY), doc[side], x[side], y[side], k))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def halves(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """(key, doc_id, place, part): around the anchors at the row's ``places`` the bytes that strings
    with the 35 bytes left of its end, or right of its start, can reach.

    Of a ``hot`` key the strings come one by one, keyed by their own hash; without a part, if this
    task has met the string in an earlier document."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)  # HOT_KEYS numbers at most

    def make():
        hot_keys = shared.value
        seen: dict[int, int] = {}  # the least document of a hot string here; forgetting costs rows only

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            batch = _open(batch)
            ids, checks, lists = numbers(batch, "doc_id"), numbers(batch, "check"), batch.column(batch.schema.get_field_index("places"))
            keys, docs, places, parts = [], [], [], []
            for row, stop, data, offsets in windows.pieces(batch, "text"):
                raw = data.tobytes()
                key, doc, x, y, k = _cut(data, offsets, ids[row:stop], checks[row:stop], [lists[i].values.to_numpy() for i in range(row, stop)])
                warm = np.isin(key, hot_keys) if len(hot_keys) else np.zeros(len(key), bool)
                if warm.any():
                    at, low = _ranges(np.arange(len(data)), x[warm], np.maximum(y[warm] - WINDOW + 1, x[warm]))
                    own = np.repeat(doc[warm], np.maximum(y[warm] - WINDOW + 1 - x[warm], 0))
                    sums = windows.prefix(windows.byte_units(data))
                    at, one = np.unique(at, return_index=True)  # a string may lie in two parts
                    own, strings = own[one], windows.hashes(sums, at, at + WINDOW)
                    for h, d, p in zip(strings.tolist(), own.tolist(), at.tolist()):
                        name = int(ids[row + d])
                        if seen.get(h, name) < name:
                            parts.append(None)
                        else:
                            if len(seen) >= HOT_SEEN:
                                seen.clear()
                            seen[h] = name
                            parts.append(raw[p : p + WINDOW])
                    keys.append(strings)
                    docs.append(ids[row:stop][own])
                    places.append(at - offsets[own] | checks[row:stop][own] << CHECK)
                    key, doc, x, y, k = key[~warm], doc[~warm], x[~warm], y[~warm], k[~warm]
                keys.append(key)
                docs.append(ids[row:stop][doc])
                places.append(x - offsets[doc] | k - x << 31 | checks[row:stop][doc] << CHECK)
                parts += [raw[p:q] for p, q in zip(x.tolist(), y.tolist(), strict=True)]
            key, doc, place = (np.concatenate(c) for c in (keys, docs, places))
            settled = np.fromiter((p is None for p in parts), bool, len(parts))
            if settled.any():
                key[settled] = windows.mix(place[settled].view(np.uint64))  # dealt out anywhere
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(place), pa.array(parts, pa.binary())], names=["key", "doc_id", "place", "part"])

        return each

    return over_rows(texts, make, "key long, doc_id long, place long, part binary")


def hot_keys(texts: DataFrame) -> np.ndarray:
    """35-byte keys that are in very many documents of a sample, sorted."""
    rows = halves(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), np.empty(0, np.uint64)).select("key", "doc_id").distinct()
    top = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(HOT_KEYS)
    return np.sort(top.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def shared_strings(parts: DataFrame) -> DataFrame:
    """(doc_id, place, size): spans of 50-byte strings that a part of an earlier document holds too.

    Of documents with an equal part only the first one's is sorted; of the others the whole is such
    a span. What is held grows with the different parts of a key, not with the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []  # that wait to be sorted
        owners: list[list[int]] = []  # the first document of each, and its places
        keys_of: list[int] = []
        found: list[np.ndarray] = []  # doc_id, place, size
        settled: list[tuple[int, int, int]] = []
        group: dict[bytes, list[int]] = {}  # the open key's parts
        size, many, key = 0, 0, None

        def add(doc: int, place: int, part: bytes | None) -> None:
            if part is None:
                settled.append((doc, place, WINDOW))
                return
            first = group.get(part)
            if first is None:
                group[part] = [doc, place]
            elif first[0] == doc:
                first.append(place)
            elif len(part) >= WINDOW:
                settled.append((doc, place, len(part)))

        def close() -> None:
            """Let the open key's parts wait, unless all are one document's."""
            nonlocal size
            if len(group) > 1 and len({first[0] for first in group.values()}) > 1:
                parts.extend(group)
                owners.extend(group.values())
                keys_of.extend([key] * len(group))
                size += sum(map(len, group))
            group.clear()

        def sort() -> None:
            nonlocal size, many
            if settled:
                found.append(np.array(settled, np.int64).T)
            if parts:
                joined, sizes = np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))
                stop = np.cumsum(sizes)
                start = stop - sizes
                doc, place = (np.fromiter((o[i] for o in owners), np.int64, len(owners)) for i in (0, 1))
                low = start + (place >> 31 & 15)
                rows = np.stack([np.array(keys_of, np.int64), np.arange(len(parts)), doc, start, stop, low, low + KEY])
                part, at, length = np.concatenate(repeated(joined, rows), axis=1)
                at = at - start[part]
                found.append(np.stack([doc[part], place[part] + at, length]))
                more = np.flatnonzero(np.fromiter((len(o) > 2 for o in owners), bool, len(owners))[part])  # parts at several places
                settled_more = [(int(doc[part[i]]), p + int(at[i]), int(length[i])) for i in more.tolist() for p in owners[part[i]][2:]]
                if settled_more:
                    found.append(np.array(settled_more, np.int64).T)
            many += sum(f.shape[1] for f in found[-3:])
            for waiting in (parts, owners, keys_of, settled):
                waiting.clear()
            size = 0

        def flush() -> pa.RecordBatch:
            nonlocal many
            out = np.concatenate(found, axis=1)
            found.clear()
            many = 0
            return pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["doc_id", "place", "size"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, docs, places = (batch.column(i).to_numpy() for i in range(3))
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            stop = np.append(begin[1:], len(keys))
            # alone in its key, or all of one document: nothing to find; the last key may go on
            take = docs[begin] != docs[stop - 1]
            take[-1] = True
            take[0] |= keys[0] == key
            texts = batch.column(3)
            if texts.null_count:
                take |= np.add.reduceat(texts.is_null().to_numpy(zero_copy_only=False), begin) > 0
            for b, e in zip(begin[take].tolist(), stop[take].tolist(), strict=True):
                if keys[b] != key:
                    close()
                    key = int(keys[b])
                    if size >= WAITING or len(settled) >= FOUND:
                        sort()
                        if many >= FOUND:
                            yield flush()
                for d, p, part in zip(docs[b:e].tolist(), places[b:e].tolist(), texts.slice(b, e - b).to_pylist(), strict=True):
                    add(d, p, part)
                if len(settled) >= FOUND:  # a key of very many documents goes on
                    found.append(np.array(settled, np.int64).T)
                    settled.clear()
                    yield flush()
        close()
        sort()
        if found:
            yield flush()

    return parts.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(run, "doc_id long, place long, size long")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, check, compressed text and ``spans`` (place, size; null: none) of all documents; the
    size 0 stands for the whole context of the anchor at the place."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).select("doc_id", check(), "text")
    shared = written(met(packed_seeds(texts.where("doc_id is not null"))), "contexts")
    places = shared.where("not earlier").groupBy("doc_id").agg(F.collect_list("place").alias("places"))  # as long as the text at most
    packed = packed_texts(texts)
    firsts = packed.join(places, "doc_id")
    strings = written(shared_strings(halves(firsts, hot_keys(firsts))), "strings")
    spans = shared.where("earlier").select("doc_id", "place", F.lit(0).cast("long").alias("size")).union(strings)
    return packed.join(spans.groupBy("doc_id").agg(F.collect_list(F.struct("place", "size")).alias("spans")), "doc_id", "left")


def removed(length: int, check: int, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which bytes of a text lie in its spans."""
    own = place >> CHECK == check
    at, size = place[own] & _AT, size[own]
    start = np.where(size > 0, at, np.maximum(at - REACH, 0))
    stop = np.where(size > 0, at + size, np.minimum(at + WINDOW, length))
    marks = np.bincount(start, minlength=length + 1) - np.bincount(stop, minlength=length + 1)
    return np.cumsum(marks)[:-1] > 0


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            (texts,) = columns(_open(batch), "text")
            checks, lists = numbers(batch, "check"), batch.column(batch.schema.get_field_index("spans"))
            any_, out = lists.is_valid().to_numpy(zero_copy_only=False), []
            for i, text in enumerate(texts):
                if any_[i]:
                    place, size = (lists[i].values.field(k).to_numpy() for k in (0, 1))
                    gone = removed(len(text), int(checks[i]), place, size)
                    edge = np.diff(gone.view(np.int8), prepend=0)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    out.append((len(text), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return each

    return over_rows(marked(docs), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _windows(data: np.ndarray, offsets: np.ndarray) -> windows.Windows:
    return windows.Windows(windows.byte_units(data), offsets, WINDOW, SEED)
