"""Brown class-based n-grams.

Words stand between ASCII white space, ASCII letters lowered, and are known by a 64-bit hash; an
end follows each text. A text's probability is the product, over its tokens, of the transition
from the class before to the token's class and of the token's emission from its class.

Classes: the end has one, words seen ``LEAST`` - 1 times or less have one (rare; words never seen
are one more type of it), and all others are in ``classes`` further ones. The ``core`` most frequent
words are put there by exchange clustering: each word in turn moves to the class that raises the
classes' mutual information most, until no word moves. All other words, each by the core words'
classes beside it, go to the class that makes their occurrences likeliest; that is one exchange
step, taken in Spark: neighbours of the ``dense`` most frequent words are counted in matrices, those
of the others, which grow with the corpus, are dealt by word. Transitions are smoothed by the
classes' own shares, emissions by half a count a type, so probabilities add up to one over the types
that the base model has too.

All counts are over all training texts, added up in tasks and then in Spark. What is broadcast and
comes to the driver is bounded by parameters: ``head`` words with their counts and classes (16 bytes
each), a ``core`` x ``core`` and a class x class matrix. Where more than ``head`` words are seen
``LEAST`` times, the others of them get their classes by the same step, dealt by word, and their
transitions are counted by joins (``beyond``). Counts of all words that are not broadcast, and
classes, stay in Spark: the scoring pass keeps each text's words of that kind with the classes
beside them and looks them up by a shuffle; two in a row take one more. So what a word gets does
not depend on ``head``.

Defined cases: a null or empty text is its end alone; a null doc_id counts as the empty text for
the fold; repeated rows are scored and counted again; with no training rows every token has
probability one in both models; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.llm import windows
from runweave.llm.common import by_key, columns, over_rows, text_bytes, written
from runweave.llm.imatch import terms_of

END = np.uint64(0x5E17D0C5E17D0C5E)
#: Class numbers of the end and of rare words; the others follow.
END_CLASS, RARE_CLASS = 0, 1
#: Words with classes at most, the least count of one, words of matrices, words of the exchange, its
#: classes and rounds, strength of the classes' shares.
HEAD, LEAST, DENSE, CORE, CLASSES, ROUNDS, STRENGTH = 1 << 20, 2, 1 << 14, 2_048, 64, 50, 10.0
FLUSH_TOKENS = 1 << 21
PART = 256


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some texts, ends included, and each text's first token."""
    units, first = terms_of(data, offsets)
    return np.insert(units, first[1:], END), first + np.arange(len(first))


class Numbers:
    """Unit -> its place in a list, -1 if it is not there, for many units at once."""

    def __init__(self, units: np.ndarray):
        self.units = units
        bits = max(4, int(2 * len(units)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(units), dtype=np.int32)
        at = (units >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of several for one slot the last stays
            left = self.slot[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask

    def of(self, units: np.ndarray) -> np.ndarray:
        at = (units >> self.shift).astype(np.int64)
        out = self.slot[at]
        todo = np.flatnonzero(out >= 0)
        todo = todo[self.units[out[todo]] != units[todo]]
        while len(todo):  # the slot is another unit's: try the next
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.slot[at[todo]]
            todo = todo[out[todo] >= 0]
            todo = todo[self.units[out[todo]] != units[todo]]
        return out


def summed_blobs(rows: DataFrame, width: int) -> DataFrame:
    """(part, counts): the sum of the packed integer arrays of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "counts"])
        for batch in batches:
            for p, blob in zip(*columns(batch, "part", "counts"), strict=True):
                if p != part:
                    if part is not None:
                        yield out()
                    part, total = p, np.zeros(width, np.int64)
                total += np.frombuffer(zlib.decompress(blob), np.int64)
        if part is not None:
            yield out()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, counts binary")


def counted(texts: DataFrame, count, rows: int, width: int) -> DataFrame:
    """Sum over all texts of what ``count(tokens, first)`` finds, flat places in a rows x width
    matrix; (part, counts) with PART rows of the matrix in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-rows // PART) * PART * width, np.int64)
        work = count()
        for batch in batches:
            for _, _, data, offsets in windows.pieces(batch, "text"):
                for places in work(*tokens_of(data, offsets)):
                    total += np.bincount(places, minlength=len(total)) if len(places) > len(total) // 8 else 0
                    if len(places) <= len(total) // 8:
                        np.add.at(total, places, 1)
        parts = total.reshape(-1, PART * width)
        for i in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1)], pa.binary())], names=["part", "counts"])

    return summed_blobs(texts.mapInArrow(run, "part int, counts binary"), PART * width)


def unigrams(texts: DataFrame) -> DataFrame:
    """(unit, n) of every token of the texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            unit, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(n)], names=["unit", "n"])

        for batch in batches:
            for _, _, data, offsets in windows.pieces(batch, "text"):
                held.append(tokens_of(data, offsets)[0])
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return texts.mapInArrow(run, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _gain(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each word, from the counts of word after word, by exchange clustering.

    Words start dealt out by frequency rank; each round tries every word in every class."""
    m = len(bigrams)
    classes = max(1, min(classes, m))
    a = bigrams.astype(np.float64)
    own = np.arange(m) % classes
    hot = np.zeros((m, classes))
    hot[np.arange(m), own] = 1
    after, before = a @ hot, a.T @ hot  # of each word: tokens after and before it, by class
    table = hot.T @ after
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            r, l, self_, old = after[w].copy(), before[w].copy(), a[w, w], own[w]
            if not r.sum() and not l.sum():
                continue
            r[old] -= self_
            l[old] -= self_
            table[old] -= r
            table[:, old] -= l
            table[old, old] -= self_
            rows, cols = table.sum(1), table.sum(0)
            c = np.arange(classes)
            new = _gain(table + r[None, :]) - _gain(table)
            score = new.sum(1) - new[c, c]
            new = _gain(table + l[:, None]) - _gain(table)
            score += new.sum(0) - new[c, c]
            diagonal = table[c, c]
            score += _gain(diagonal + r + l + self_) - _gain(diagonal)
            # every row gains the tokens of w that follow its own words, wherever w goes, every column
            # those that come before; the class that w joins also gains what is beside w
            score -= _gain(rows + l + r.sum() + self_) - _gain(rows + l) + _gain(cols + r + l.sum() + self_) - _gain(cols + r)
            best = int(np.argmax(score))
            if score[best] <= score[old] + 1e-9:
                best = old
            table[best] += r
            table[:, best] += l
            table[best, best] += self_
            if best != old:
                moved += 1
                own[w] = best
                after[:, old] -= a[:, w]
                after[:, best] += a[:, w]
                before[:, old] -= a[w]
                before[:, best] += a[w]
        if not moved:
            break
    return own


@dataclass
class Model:
    """Words with classes and their counts, log10 transitions, and what counts are divided by."""

    units: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    transition: np.ndarray  # log10, class before x class
    mass: np.ndarray  # log10 of what counts + 0.5 are divided by, of each class
    whole: float  # the same of the base
    tokens: int
    least: int  # the least count of a word with a class
    types: int = 0
    moves: np.ndarray | None = None  # counts behind the transitions
    choice: tuple[np.ndarray, np.ndarray] | None = None  # what further words choose their classes by
    core: int = 0


def collected(blobs: DataFrame, rows: int, width: int) -> np.ndarray:
    out = np.zeros((-(-rows // PART), PART * width), np.int64)
    for r in blobs.toLocalIterator():
        out[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.reshape(-1, width)[:rows]


def threshold(counts: DataFrame, head: int, least: int) -> int:
    """The least count, ``least`` or more, that at most ``head`` words reach. Distinct counts come
    to the driver: their number grows with the square root of the tokens at most."""
    sizes = counts.where(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toPandas()
    fits = sizes["words"].cumsum() <= head
    if fits.all():
        return least
    return int(sizes["n"][fits].min()) if fits.any() else int(sizes["n"].max()) + 1


def sparse_classes(texts: DataFrame, shared, shared_classes, choose, dense: int, k: int) -> DataFrame:
    """(word, class) of the words after the ``dense`` first ones, from the classes beside them.

    Neighbours travel as packed arrays, a row for each shard of the words and run of tokens."""
    shards = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = Numbers(shared.value), [], 0
        words, known = len(shared.value) - 1, shared_classes.value.astype(np.int64)

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)  # word, side and class, in 24 + 1 + 8 bits
            shard = (key >> 9) % shards
            order = np.argsort(shard, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards)))).tolist()
            key, n = (key[order] >> 9) // shards << 9 | key[order] & 511, n[order]
            blobs = [zlib.compress(key[a:b].astype("<u4").tobytes() + n[a:b].astype("<u4").tobytes(), 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "beside"])

        for batch in batches:
            for _, _, data, offsets in windows.pieces(batch, "text"):
                i = numbers.of(tokens_of(data, offsets)[0]).astype(np.int64)
                c = known[i]
                before = np.append(END_CLASS, c[:-1])
                word = (i >= dense) & (i < words)
                held.append(i[word] << 9 | before[word])
                word = word[:-1]
                held.append(i[:-1][word] << 9 | 256 | c[1:][word])
                size += len(held[-1]) + len(held[-2])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def chosen(shard: int, blobs: list[bytes]) -> pa.RecordBatch:
        parts = [np.frombuffer(zlib.decompress(b), "<u4").reshape(2, -1) for b in blobs]
        key, n = np.concatenate(parts, axis=1).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        out = []
        begin = 0
        while begin < len(key):  # some words at a time
            low = key[begin] >> 9
            end = int(np.searchsorted(key, (low + PART) << 9))
            row, at = (key[begin:end] >> 9) - low, key[begin:end] & 255
            v = np.bincount(row * 2 * k + (key[begin:end] >> 8 & 1) * k + at, n[begin:end], minlength=PART * 2 * k).reshape(PART, 2 * k)
            there = np.unique(row)
            out.append(np.stack([(there + low) * shards + shard, choose(v[there])]))
            begin = end
        word, class_ = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(class_)], names=["word", "class"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blobs = None, []
        for batch in batches:
            for s, blob in zip(*columns(batch, "shard", "beside"), strict=True):
                if s != shard and blobs:
                    yield chosen(shard, blobs)
                    blobs = []
                shard = s
                if len(zlib.decompress(blob)):
                    blobs.append(blob)
        if blobs:
            yield chosen(shard, blobs)

    packed = texts.mapInArrow(run, "shard int, beside binary")
    return packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(collect, "word long, class long")


def chosen_by(v: np.ndarray, choice: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The class of each word, from the counts of the classes before it and after it."""
    to, size = choice
    k = len(size)
    score = v[:, :k] @ to + v[:, k:] @ to.T - v[:, :k].sum(1, keepdims=True) * size
    score[:, :2] = -np.inf
    return score.argmax(1)


def fitted(texts: DataFrame, counts: DataFrame, head: int = HEAD, core: int = CORE, classes: int = CLASSES, dense: int = DENSE, least: int = LEAST) -> Model:
    """The model of the training ``texts``, whose unigrams are ``counts``; words beyond ``head`` are rare, see ``beyond``."""
    if classes > 253:
        raise ValueError("253 classes at most: they are stored in a byte, with those of the end and of rare words")
    spark = texts.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    n_tokens, n_types = int(total["tokens"]), int(total["types"])
    least = threshold(counts, head, least)
    end = int(END.astype(np.int64))
    often = counts.where((F.col("n") >= least) | (F.col("unit") == end)).select("unit", "n").toArrow()  # at most head + 1 rows
    units, n = (often.column(c).to_numpy() for c in ("unit", "n"))
    order = np.lexsort((units, -n, units == end))  # the end is the last
    units, n = units[order].view(np.uint64), n[order]
    del often
    if not n_tokens:
        return Model(units, n, np.empty(0, np.uint8), np.zeros((2, 2)), np.full(2, np.log10(0.5)), float(np.log10(0.5)), 0, 1)
    words = len(units) - 1
    core, dense = min(core, words), min(max(core, dense), words)
    shared = spark.sparkContext.broadcast(units)

    def core_pairs():
        numbers = Numbers(shared.value[:core])

        def each(tokens: np.ndarray, first: np.ndarray):
            i = numbers.of(tokens)
            both = (i[:-1] >= 0) & (i[1:] >= 0)  # an end is not there, so no pair spans two texts
            yield i[:-1][both].astype(np.int64) * core + i[1:][both]

        return each

    own = exchange(collected(counted(texts, core_pairs, core, core), core, core), classes) if core else np.empty(0, np.int64)
    k = (int(own.max()) + 1 if core else 0) + 2
    known = np.full(len(units) + 1, RARE_CLASS)  # by number; the last stands for all others
    known[:core], known[words] = own + 2, END_CLASS

    dense_classes = np.append(known[:dense], [END_CLASS, RARE_CLASS])

    def neighbours():
        numbers = Numbers(np.append(shared.value[:dense], END))

        def each(tokens: np.ndarray, first: np.ndarray):
            i = numbers.of(tokens).astype(np.int64)
            c = dense_classes[i]
            before = np.append(END_CLASS, c[:-1])
            word = (i >= 0) & (i < dense)
            yield i[word] * 2 * k + before[word]
            word = word[:-1]
            yield i[:-1][word] * 2 * k + k + c[1:][word]

        return each

    size = np.log(np.bincount(known[:core], n[:core], minlength=k) + 0.5)

    def choice_of(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the counts of class after class of the core words."""
        follow[:2] = 1
        return np.log((follow + 0.5) / (follow + 0.5).sum(1, keepdims=True)), size

    final, choice = known.astype(np.uint8), None
    if core < words:
        contexts = written(counted(texts, neighbours, dense, 2 * k), "contexts")
        parts = -(-core // PART)
        vectors = collected(contexts.where(F.col("part") < parts), parts * PART, 2 * k)[:core] if core else np.zeros((0, 2 * k))
        follow = np.zeros((k, k))
        np.add.at(follow, known[:core], vectors[:, k:])
        choice = choice_of(follow)

        def choose(v: np.ndarray) -> np.ndarray:
            return chosen_by(v, choice)

        def choose_dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, blob in zip(*columns(batch, "part", "counts"), strict=True):
                    v = np.frombuffer(zlib.decompress(blob), np.int64).reshape(PART, 2 * k)
                    yield pa.RecordBatch.from_arrays([pa.array(part * PART + np.arange(PART)), pa.array(choose(v))], names=["word", "class"])

        chosen = contexts.mapInArrow(choose_dense, "word long, class long").where((F.col("word") >= core) & (F.col("word") < dense))
        if dense < words:
            chosen = chosen.union(sparse_classes(texts, shared, spark.sparkContext.broadcast(final.copy()), choose, dense, k))
        chosen = chosen.select(F.col("word").cast("int").alias("word"), F.col("class").cast("short").alias("class")).toArrow()  # two numbers a word
        final[chosen.column("word").to_numpy()] = chosen.column("class").to_numpy()
    told = spark.sparkContext.broadcast(final)

    def transitions():
        numbers, classes_of = Numbers(shared.value), told.value

        def each(tokens: np.ndarray, first: np.ndarray):
            c = classes_of[numbers.of(tokens)].astype(np.int64)
            yield np.append(END_CLASS, c[:-1]) * k + c

        return each

    table = collected(counted(texts, transitions, k, k), k, k)
    transition, mass = smoothed(table, *shares(n, final[:-1], n_tokens, n_types, k))
    choice = choice or choice_of(table.astype(float))  # all words are core words: their neighbours have these classes
    return Model(units, n, final[:-1], transition, mass, float(np.log10(n_tokens + 0.5 * (n_types + 1))), n_tokens, least, n_types, table, choice, core)


def shares(n: np.ndarray, classes: np.ndarray, n_tokens: int, n_types: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and types of each class; all that have none are rare, and a word never seen is a type of those."""
    of_class, types = np.bincount(classes, n, minlength=k), np.bincount(classes, minlength=k).astype(float)
    of_class[RARE_CLASS] += n_tokens - n.sum()
    types[RARE_CLASS] += n_types - len(n) + 1
    return of_class, types


def smoothed(table: np.ndarray, of_class: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    share = (of_class + 1) / (of_class + 1).sum()
    return np.log10((table + STRENGTH * share) / (table.sum(1, keepdims=True) + STRENGTH)), np.log10(of_class + 0.5 * types)


#: In place of a class beside a word: that token is not in the broadcast either, a row of the two tells.
NONE = 255


def beside(i: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of tokens without a number, the classes before and after each as 256 * before + after, and the
    places of those whose token before has none either. The last token is an end."""
    lost = i < 0
    c = np.where(lost, NONE, c)
    at = np.flatnonzero(lost)
    before = np.append(END_CLASS, c[:-1])[at]
    return at, before << 8 | np.append(c, END_CLASS)[at + 1], at[before == NONE]


def tally(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns, in order of them, and how often each stands."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))[: len(order)]
    fresh = np.flatnonzero(new)
    return [k[fresh] for k in keys], np.diff(np.append(fresh, len(order)))


def contexts_of(texts: DataFrame, shared, classes, pairs: bool) -> DataFrame:
    """(unit, after, code, n): words that ``shared`` does not hold and the classes beside them; with ``pairs`` a
    neighbour that it does not hold is NONE, and rows of code -1 name two such words in a row, else it is rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known, held, size = Numbers(shared.value), classes.value.astype(np.int64), [], 0

        def flush() -> pa.RecordBatch:
            (unit, after, code), n = tally(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(after.view(np.int64)), pa.array(code.astype(np.int32)), pa.array(n)], names=["unit", "after", "code", "n"])

        for batch in batches:
            for _, _, data, offsets in windows.pieces(batch, "text"):
                tokens = tokens_of(data, offsets)[0]
                i = numbers.of(tokens)
                at, code, twos = beside(i, known[i])
                if not pairs:
                    before, after = code >> 8, code & 255
                    code = np.where(before == NONE, RARE_CLASS, before) << 8 | np.where(after == NONE, RARE_CLASS, after)
                held.append((tokens[at], np.zeros(len(at), np.uint64), code))
                if pairs:
                    held.append((tokens[twos - 1], tokens[twos], np.full(len(twos), -1)))
                size += len(at)
                if size >= FLUSH_TOKENS // 4:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return texts.mapInArrow(run, "unit long, after long, code int, n long")


def further_classes(contexts: DataFrame, choice: tuple[np.ndarray, np.ndarray], least: int) -> DataFrame:
    """(unit, n, class) of words from their contexts; those seen less than ``least`` times are rare."""
    k = len(choice[1])

    def chosen(unit: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        units, row = np.unique(unit, return_inverse=True)
        for low in range(0, len(units), PART):
            at = np.flatnonzero((row >= low) & (row < low + PART)) if len(units) > PART else slice(None)
            r, here = row[at] - low, min(PART, len(units) - low)
            v = np.bincount(np.concatenate([r * 2 * k + (code[at] >> 8), r * 2 * k + k + (code[at] & 255)]), np.tile(n[at], 2), minlength=here * 2 * k).reshape(here, 2 * k)
            seen = v[:, :k].sum(1).astype(np.int64)
            class_ = np.where(seen >= least, chosen_by(v, choice), RARE_CLASS)
            yield pa.RecordBatch.from_arrays([pa.array(units[low : low + here]), pa.array(seen), pa.array(class_.astype(np.int32))], names=["unit", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= 1 << 14:
                unit, code, n = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(unit, unit[-1]))  # the last word may go on
                yield from chosen(unit[:whole], code[:whole], n[:whole])
                held, size = [[unit[whole:], code[whole:], n[whole:]]], 0
        if held:
            yield from chosen(*(np.concatenate(x) for x in zip(*held, strict=True)))

    sums = contexts.groupBy("unit", "code").agg(F.sum("n").alias("n"))
    return sums.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "unit long, n long, class int")


def followed(pairs: DataFrame, words: DataFrame, *carried: str) -> DataFrame:
    """Two words in a row (unit, after) as the second one beside the class of the first."""
    found = pairs.join(words.select("unit", "class"), "unit", "left")
    code = F.lit(1 << 16) + F.coalesce("class", F.lit(RARE_CLASS)) * 256 + NONE
    return found.select(F.col("after").alias("unit"), *carried, "n", code.cast("int").alias("code"))


def beyond(texts: DataFrame, model: Model, least: int = LEAST) -> tuple[Model, DataFrame | None]:
    """The model with classes for the words that it does not hold but that are seen ``least`` times, and
    (unit, n, class) of all words that it does not hold; None if no such word has a class."""
    k = len(model.transition)
    if model.least <= least or k == 2:
        return model, None
    sc = texts.sparkSession.sparkContext
    shared, final = sc.broadcast(model.units), np.append(model.classes, RARE_CLASS)
    core = final.copy()
    core[model.core : -2] = RARE_CLASS  # words choose by core words beside them
    words = written(further_classes(contexts_of(texts, shared, sc.broadcast(core), False), model.choice, least), "words")
    contexts = written(contexts_of(texts, shared, sc.broadcast(final), True), "beside")
    pairs = contexts.where("code < 0").groupBy("unit", "after").agg(F.sum("n").alias("n"))
    rows = contexts.where("code >= 0").select("unit", "n", "code").union(followed(pairs, words))
    found = rows.join(words.select("unit", "class"), "unit").groupBy("code", "class").agg(F.sum("n").alias("n")).toArrow()  # few: classes
    code, own, n = (found.column(c).to_numpy() for c in ("code", "class", "n"))
    before, after, table = code >> 8 & 255, code & 255, model.moves.copy()
    at = before < NONE  # all were counted as rare, of two in a row both
    np.add.at(table, (np.where(code >= 1 << 16, RARE_CLASS, before)[at], RARE_CLASS), -n[at])
    np.add.at(table, (before[at], own[at]), n[at])
    at = after < NONE
    np.add.at(table, (RARE_CLASS, after[at]), -n[at])
    np.add.at(table, (own[at], after[at]), n[at])
    of_class, types = shares(model.counts, model.classes, model.tokens, model.types, k)
    for r in words.where(F.col("class") != RARE_CLASS).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        of_class[[r["class"], RARE_CLASS]] += (r["n"], -r["n"])
        types[[r["class"], RARE_CLASS]] += (r["types"], -r["types"])
    transition, mass = smoothed(table, of_class, types)
    return replace(model, transition=transition, mass=mass, moves=table), words


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each text's values; every text has a token at least."""
    return np.add.reduceat(values, first[:-1])


def scored(docs: DataFrame, counts: DataFrame, model: Model, fold: Column, words: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; ``words`` are
    those of ``beyond``."""
    deferred = words is not None  # what depends on the class of a word that is not broadcast is added by the look-up
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the frequent words

    def make():
        m = shared.value
        numbers, final = Numbers(m.units), np.append(m.classes, RARE_CLASS).astype(np.int64)
        weight = np.append(np.log10(m.counts + 0.5), 0.0)  # of rare words it comes from the look-up

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for _, _, data, offsets in windows.pieces(batch, "text"):
                tokens, first = tokens_of(data, offsets)
                i = numbers.of(tokens)
                c = final[i]
                move = m.transition[np.append(END_CLASS, c[:-1]), c] - m.mass[c]
                rare = i < 0
                at, code, twos = beside(i, c)
                if deferred:
                    move[rare] = 0
                    after = at[~rare[at + 1]] + 1  # an end is not rare here
                    move[after] = -m.mass[c[after]]
                else:
                    code, twos = np.zeros(len(at), np.int64), twos[:0]
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                lists = []
                for keys in ((text[at], tokens[at], code), (text[twos], tokens[twos - 1], tokens[twos])):
                    (of, *values), times = tally(*keys)
                    ends = pa.array(np.searchsorted(of, np.arange(len(first))), pa.int32())
                    lists += [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64, copy=False) if x.dtype != np.uint64 else x.view(np.int64))) for x in (*values, times)]
                out.append((np.diff(first), summed((~rare).astype(np.int64), first), summed(weight[i] - m.whole, first), summed(weight[i] + move, first), *lists))
            arrays = [pa.array(np.concatenate([o[j] for o in out])) for j in range(4)] + [pa.concat_arrays([o[j] for o in out]) for j in range(4, 10)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=names)

        return each

    schema = "doc_id long, held_out boolean, n_tokens long, frequent long, base double, value double, rare array<long>, code array<long>, times array<long>, one array<long>, two array<long>, both array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), text_bytes())
    # the row's number is written with the row, so both readers below see the same one
    rows = written(over_rows(rows, make, schema).withColumn("row", F.monotonically_increasing_id()), "scores")

    def flat(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
        return pa.RecordBatch.from_arrays([batch.column(1).flatten(), pa.array(row), batch.column(3).flatten(), batch.column(2).flatten()], names=["unit", "row", "n", "code"])

    asked = over_rows(rows.select("row", "rare", "code", "times"), lambda: flat, "unit long, row long, n long, code long")
    if deferred:
        pairs = over_rows(rows.where(F.size("one") > 0).select("row", "one", "two", "both"), lambda: flat, "unit long, row long, n long, code long")
        asked = asked.union(followed(pairs.withColumnRenamed("code", "after"), words, "row").withColumn("code", F.col("code").cast("long")))
        known = words.select("unit", F.lit(-1).cast("long").alias("row"), "n", F.col("class").cast("long").alias("code"))
    else:
        known = counts.where(F.col("n") < model.least).select("unit", F.lit(-1).cast("long").alias("row"), "n", F.lit(RARE_CLASS).cast("long").alias("code"))

    def look_up(columns: list[np.ndarray], new: np.ndarray, state: dict) -> pa.RecordBatch:
        _, row, n, code = columns
        begins = np.flatnonzero(new)
        count, own = np.where(row[begins] < 0, n[begins], 0), np.where(row[begins] < 0, code[begins], RARE_CLASS)
        if not new[0]:
            count, own = np.append(state["count"], count), np.append(state["own"], own)
        place = np.cumsum(new) - int(new[0])
        count, own = count[place], own[place]
        state["count"], state["own"] = count[-1], own[-1]
        ask = row >= 0
        code, own, n, count = code[ask], own[ask], n[ask], count[ask]
        which, place = np.unique(row[ask], return_inverse=True)
        itself = code < 1 << 16  # not the second of two words in a row, which asks on its own too
        value = np.where(itself, np.log10(count + 0.5), 0.0)
        score = value
        if deferred:
            m = shared.value
            before, after = code >> 8 & 255, code & 255
            score = value - np.where(itself, m.mass[own], 0.0)
            score = score + np.where(before < NONE, m.transition[np.where(before < NONE, before, 0), own], 0.0) + np.where(after < NONE, m.transition[own, np.where(after < NONE, after, 0)], 0.0)
        sums = [np.bincount(place, n * x, minlength=len(which)) for x in (value, score, itself & (count > 0))]
        return pa.RecordBatch.from_arrays([pa.array(which), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))], names=["row", "rare_value", "rare_score", "rare_known"])

    rare = by_key(asked.union(known), "unit", ["row"], look_up, "row long, rare_value double, rare_score double, rare_known long")
    rare = rare.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("rare_value", "rare_score", "rare_known")])
    found = rows.select("row", "doc_id", "held_out", "n_tokens", "frequent", "base", "value").join(rare, "row", "left")
    more = lambda name: F.coalesce(name, F.lit(0))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("frequent") + more("rare_known")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("rare_value")).alias("base_score"),
        (F.col("value") + more("rare_score")).alias("score"),
    )


def perplexity(score: Column, tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / tokens)


def scores(docs: DataFrame, fold: Column, head: int = HEAD, **parameters) -> DataFrame:
    """Fit on the rows whose ``fold`` is false, score all."""
    texts = docs.where(~fold).select(text_bytes())
    counts = written(unigrams(texts), "unigrams")
    model, words = beyond(texts, fitted(texts, counts, head, **parameters), parameters.get("least", LEAST))
    return scored(docs, counts, model, fold, words)
