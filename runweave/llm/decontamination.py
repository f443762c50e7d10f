"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

The index holds the items. An item's weights are divided by its own score, so a passage that has
all its words scores 1 and one threshold holds for all items. Items are ordered by length, cut into
classes of like lengths and into blocks; each posting list knows its greatest weight in each block
where it has an item. Every text is read whole, for each class as passages of two strides, a stride
being the longest item's length: any place where an item could stand lies in one passage whole. A
passage is a query of its distinct words. Bounds from the block maxima are summed for all passages
of a batch at once, and only passages that some block could lift over the threshold go on to WAND,
which skips blocks that cannot and returns all items above the threshold. A hit counts if the
passage has the five-word shingles of the item's question and of its answer (the last sentence; of a
single sentence the last quarter of the words).

The items come to the driver in shards of at most ``shard_items``, each indexed and searched on
its own with its own word counts; a benchmark of more items means more passes, not a larger
broadcast. An index grows with the words of its items, some 20 MB for 20,000 items of 40 words.

Defined cases: null and empty texts and items never match; an item of fewer than five words is one
shingle; repeated items are items of their own, and repeated documents have hits of their own; a
null doc_id or item_id is returned as null; an empty benchmark matches nothing; further columns are
passed on by ``clean`` and ignored by ``hits``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import columns, over_rows, text_bytes

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.?!:]\s+|\n+")
K1, B = 1.2, 0.75
#: Share of an item's own BM25 score to retrieve it, words of a shingle, share of shingles to confirm it.
RETRIEVE, SHINGLE, OVERLAP = 0.75, 5, 0.8
BLOCK_ITEMS = 4
SHARD_ITEMS = 20_000
#: How many times longer the longest item of a class may be than the shortest, bounds that are summed at once.
SPREAD, BOUNDS = 8, 1 << 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the shingles of ``part`` that the passage has; 1 if there are no words."""
    width = min(SHINGLE, len(part))
    if not width:
        return 1.0
    own = grams(part, width)
    return len(own & grams(passage, width)) / len(own)


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    ends = [m.end() for m in SENTENCE_END.finditer(text.rstrip())]
    if ends and words_of(text[ends[-1] :]) and words_of(text[: ends[-1]]):
        return words_of(text[: ends[-1]]), words_of(text[ends[-1] :])
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


@dataclass
class Class:
    """Items of like lengths: the longest one's words, the first item, and block maxima by term (the
    maxima of term t are at ``begin[t]:begin[t + 1]``, each with its block)."""

    stride: int
    first: int
    blocks: int
    begin: np.ndarray
    block: np.ndarray
    most: np.ndarray


class Index:
    """Posting lists of items, with block maxima."""

    def __init__(self, items: list[tuple[int | None, str]]):
        found = [(name, text, words_of(text or "")) for name, text in items]
        found = sorted((x for x in found if x[2]), key=lambda x: (len(x[2]), x[0] is None, x[0] or 0, x[1]))
        self.names = [x[0] for x in found]
        self.texts = [x[1] for x in found]
        df = Counter(w for *_, words in found for w in set(words))
        mean = sum(len(x[2]) for x in found) / max(1, len(found))
        self.term = {w: t for t, w in enumerate(sorted(df))}
        terms, which, weights = [], [], []
        for i, (*_, words) in enumerate(found):
            weight = {w: math.log(1 + (len(found) - df[w] + 0.5) / (df[w] + 0.5)) * k * (K1 + 1) / (k + K1 * (1 - B + B * len(words) / mean)) for w, k in Counter(words).items()}
            own = sum(weight.values())
            terms += [self.term[w] for w in weight]
            which += [i] * len(weight)
            weights += [x / own for x in weight.values()]
        order = np.lexsort((which, terms)) if terms else np.empty(0, np.int64)
        term, self.items, self.weights = np.array(terms, np.int64)[order], np.array(which, np.int32)[order], np.array(weights)[order]
        self.begin = np.searchsorted(term, np.arange(len(self.term) + 1))
        self.classes, sizes, at = [], [len(x[2]) for x in found], 0
        while at < len(found):
            to = int(np.searchsorted(sizes, SPREAD * sizes[at], "right"))
            own = (self.items >= at) & (self.items < to)
            block = (self.items[own] - at) // BLOCK_ITEMS
            cut = np.flatnonzero(np.append(True, (term[own][1:] != term[own][:-1]) | (block[1:] != block[:-1])))
            most = np.maximum.reduceat(self.weights[own], cut).astype(np.float32)
            self.classes.append(Class(sizes[to - 1], at, -(-(to - at) // BLOCK_ITEMS), np.searchsorted(term[own][cut], np.arange(len(self.term) + 1)), block[cut], most))
            at = to
        self.lists: dict[tuple[int, int], tuple[list[int], list[float], dict[int, float], float]] = {}

    def __getstate__(self):
        return self.__dict__ | {"lists": {}}

    def list_of(self, c: int, term: int) -> tuple[list[int], list[float], dict[int, float], float]:
        """A term's items in a class and their weights, its block maxima and its maximum; kept once made."""
        if (c, term) not in self.lists:
            own = self.classes[c]
            last = self.classes[c + 1].first if c + 1 < len(self.classes) else len(self.names)
            a, b = self.begin[term], self.begin[term + 1]
            x, y = a + np.searchsorted(self.items[a:b], [own.first, last])
            blocks = slice(own.begin[term], own.begin[term + 1])
            weights = self.weights[x:y].tolist()
            self.lists[c, term] = ((self.items[x:y] - own.first).tolist(), weights, dict(zip(own.block[blocks].tolist(), own.most[blocks].tolist(), strict=True)), max(weights, default=0.0))
        return self.lists[c, term]

    def wand(self, c: int, terms: list[int], least: float) -> Iterator[tuple[int, float]]:
        """(item, score) of all items of a class that score ``least`` or more for a query of distinct terms."""
        lists = {t: own for t in terms if (own := self.list_of(c, t))[0]}
        at = dict.fromkeys(lists, 0)
        best = {t: own[3] for t, own in lists.items()}
        item = lambda t: lists[t][0][at[t]]
        live = sorted(lists, key=item)
        while live:
            total, pivot = 0.0, -1
            for k, t in enumerate(live):
                total += best[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return
            target = item(live[pivot])
            while pivot + 1 < len(live) and item(live[pivot + 1]) == target:
                pivot += 1
            block = target // BLOCK_ITEMS
            if sum(lists[t][2].get(block, 0.0) for t in live[: pivot + 1]) < least - 1e-5:  # maxima are rounded
                # no item of this block that only these lists hold can do: go on after the block,
                # or at the next list's item if that comes first
                target = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(live):
                    target = min(target, item(live[pivot + 1]))
            elif item(live[0]) == target:
                score = sum(lists[t][1][at[t]] for t in live[: pivot + 1])
                if score >= least:
                    yield self.classes[c].first + target, score
                target += 1
            for t in live[: pivot + 1]:
                which = lists[t][0]
                while at[t] < len(which) and which[at[t]] < target:
                    at[t] += 1
            live = sorted((t for t in live if at[t] < len(lists[t][0])), key=item)

    def candidates(self, c: int, texts: list[np.ndarray], least: float) -> Iterator[tuple[int, int, list[int]]]:
        """(text, passage, distinct terms) of the passages that a block's bound lets over ``least``.

        ``texts``: the terms of each text, -1 for words of no item. A passage's bound in a block is
        at most the sum of its two strides' bounds."""
        own = self.classes[c]
        strides = [-(-len(ids) // own.stride) + 1 for ids in texts]  # one empty stride ends each text
        begin = np.append(0, np.cumsum(strides))
        stride = np.concatenate([np.arange(len(ids)) // own.stride + b for ids, b in zip(texts, begin, strict=False)])
        ids = np.concatenate(texts)
        pairs = np.unique((stride * len(self.term) + ids)[ids >= 0])
        if not len(pairs):
            return
        at, term = pairs // len(self.term), pairs % len(self.term)
        low, many = own.begin[term], own.begin[term + 1] - own.begin[term]
        over = np.zeros(begin[-1], bool)
        step = max(1, BOUNDS // own.blocks)
        before = np.zeros(own.blocks)  # bounds of the last stride so far
        for base in range(0, int(begin[-1]), step):  # some strides at a time
            part = slice(*np.searchsorted(at, (base, base + step)))
            n = many[part]
            entry = np.arange(int(n.sum())) + np.repeat(low[part] - (np.cumsum(n) - n), n)
            rows = min(step, int(begin[-1]) - base)
            bound = np.bincount(np.repeat(at[part] - base, n) * own.blocks + own.block[entry], own.most[entry], rows * own.blocks).reshape(rows, own.blocks)
            over[base : base + rows - 1] = (bound[:-1] + bound[1:]).max(1) >= least - 1e-4
            if base:
                over[base - 1] = (before + bound[0]).max() >= least - 1e-4
            before = bound[-1]
        over[begin[1:] - 1] = False  # an empty stride and the next text's first
        for p in np.flatnonzero(over).tolist():
            text = int(np.searchsorted(begin, p, "right")) - 1
            yield text, p - int(begin[text]), np.unique(term[slice(*np.searchsorted(at, (p, p + 2)))]).tolist()

    def hits(self, texts: list[str]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text: item -> (score, question overlap, answer overlap) of its best confirmed passage."""
        words = [words_of(t) for t in texts]
        ids = [np.fromiter(map(self.term.get, w, repeat(-1)), np.int64, len(w)) for w in words]
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        for c, own in enumerate(self.classes):
            for text, p, terms in self.candidates(c, ids, RETRIEVE):
                passage = words[text][p * own.stride : (p + 2) * own.stride]
                for i, score in self.wand(c, terms, RETRIEVE - 1e-9):
                    found = (score, *(overlap(part, passage) for part in question_and_answer(self.texts[i])))
                    if min(found[1:]) >= OVERLAP and found > out[text].get(i, (0.0, 0.0, 0.0)):
                        out[text][i] = found
        return out


def shards(items: DataFrame, shard_items: int) -> Iterator[Index]:
    """Indexes over the items, at most ``shard_items`` in each on average and never twice as many."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = items.count()
    k = -(-n // shard_items)
    for i in range(k):
        part = items if k == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i)
        yield Index([(r["item_id"], r["text"]) for r in part.collect()])


def hits(docs: DataFrame, items: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every confirmed hit."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    out = None
    for index in shards(items, shard_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by shard_items

        def make(shared=shared):
            index = shared.value

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids, texts = columns(batch, "doc_id", "text")
                rows = [(d, index.names[i], *found) for d, own in zip(ids, index.hits([t.decode() for t in texts]), strict=True) for i, found in own.items()]
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])

            return each

        found = over_rows(texts, make, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The documents without a confirmed hit, in their columns."""
    at = docs.schema.names.index("text")
    for index in shards(items, shard_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not own for own in shared.value.hits([t or "" for t in batch.column(at).to_pylist()])], pa.bool_()))

            return each

        docs = over_rows(docs, make, docs.schema)
    return docs
