"""Token ids in a grammar-compressed binary format (Re-Pair), one block after another.

Documents are sorted by doc_id over range partitions (shards); each shard is cut into blocks of
whole documents. In a block the frequent adjacent id pairs are replaced by nonterminals, round
after round: a round counts all pairs, takes the most frequent ones, and replaces their
occurrences from left to right, until no pair is frequent enough. No pair spans two documents. A block stores
its rules, how many ids each nonterminal expands to, the remaining sequence, and the documents'
ids and lengths; the running sum of expansion lengths finds any document without decoding the
rest. Blocks are rows of a Parquet table, so Spark's commit keeps them whole when executors go.

Defined cases: a null text is empty and still gets its end id; null doc_ids sort first; repeated
rows are stored again; a text longer than a block makes a block of its own; an empty table makes
an empty file; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm import windows
from runweave.llm.common import columns, over_rows, running_total, text_bytes, written

#: Ids in a block, pairs replaced in a round at most (others wait for the next), and how often a pair must occur.
SLOT_BITS = 20
BLOCK_IDS, PAIRS, LEAST = 1 << 20, 16384, 24
MEMO_WORDS = 1_000_000
PLACE_BITS, JOINED = 21, 200
_MARK, _LETTER, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_MARK[list(b'.,;:!?%#*+-=|/\\()[]{}<>"&$@^_`~')] = True
_LETTER[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LOWER[65:91] += 32
BLOCKS = "shard int, block int, first long, n_tokens long, base int, doc_ids binary, lengths binary, left binary, right binary, sizes binary, ids binary"


class Words:
    """The tokenizer, word by word, for all texts of a batch at once.

    White space always ends a token, and so does the place where the punctuation that ends a word
    follows an ASCII letter or digit (apostrophes may begin a contraction and stay with the word);
    a text's ids are those of these pieces in order. ASCII words are lowered first, as the tokenizer
    does after composing. Pieces are known by length and a 64-bit hash; ids of known ones come from
    a table, new ones go to the tokenizer, each once. A text with the string of an added token goes to
    the tokenizer whole, because such a string may stand across pieces."""

    _made: dict[str, Words] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.final = np.zeros(self.size, bool)  # tokens that end a word
        self.final[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.place = np.full(1 << PLACE_BITS, -1, np.int32)
        self.unit = np.zeros(MEMO_WORDS, np.uint64)
        self.begin, self.count = np.zeros(MEMO_WORDS + 1, np.int64), np.zeros(MEMO_WORDS, np.int64)
        self.ids = np.zeros(4 * MEMO_WORDS, np.uint32)
        self.known = 0

    def look_up(self, units: np.ndarray) -> np.ndarray:
        """The number of each unit, -1 if it is new."""
        out = np.full(len(units), -1, np.int32)
        todo = np.arange(len(units))
        at = (units >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        while len(todo):
            number = self.place[at]
            taken = number >= 0
            todo, at, number = todo[taken], at[taken], number[taken]
            hit = self.unit[number] == units[todo]
            out[todo[hit]] = number[hit]
            todo, at = todo[~hit], (at[~hit] + 1) % len(self.place)
        return out

    def learn(self, units: np.ndarray, pieces: list[bytes]) -> None:
        """Add distinct new units with the ids of their pieces."""
        flat, count = self.tokenized([p.decode() for p in pieces])
        n, start = self.known, int(self.begin[self.known])
        if start + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(flat), len(self.ids)), np.uint32)])
        self.ids[start : start + len(flat)] = flat
        self.count[n : n + len(count)] = count
        self.begin[n + 1 : n + len(count) + 1] = start + np.cumsum(count)
        self.unit[n : n + len(units)] = units
        self.known += len(units)
        todo = np.arange(n, self.known)
        at = (units >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        while len(todo):
            free = self.place[at] < 0
            self.place[at[free]] = todo[free]  # of several for one place the last stays
            won = self.place[at] == todo
            todo, at = todo[~won], (at[~won] + 1) % len(self.place)

    def tokenized(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has.

        Pieces of letters alone are one word to the tokenizer, and a word's last id is of a token
        that ends words, so many of them go as one text; the others go one by one."""
        plain = [i for i, p in enumerate(pieces) if p.isalpha() and (p.isascii() or unicodedata.normalize("NFC", p).lower().isalpha())]
        joined = [" ".join(pieces[i] for i in plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)]
        flat = self._ids(joined)[0]
        ends = np.flatnonzero(self.final[flat]) + 1
        if len(ends) != len(plain) or (len(ends) and ends[-1] != len(flat)):
            return self._ids(pieces)
        rest = np.delete(np.arange(len(pieces)), plain)
        other, sizes = self._ids([pieces[i] for i in rest.tolist()])
        count = np.zeros(len(pieces), np.int64)
        count[plain], count[rest] = np.diff(ends, prepend=0), sizes
        out, begin = np.empty(int(count.sum()), np.uint32), np.cumsum(count) - count
        for which, ids in ((np.array(plain, np.int64), flat), (rest, other)):
            n = count[which]
            out[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())), count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes and offsets, as in an Arrow array) and where each text's begin."""
        raw = data.tobytes()
        low = raw.lower()
        hits = [m.start() for t in self.added if t in low for m in re.finditer(re.escape(t), low)]
        rows = np.unique(np.searchsorted(offsets, hits, "right") - 1) if hits else np.empty(0, np.int64)
        if not len(rows):
            return self._encode(data, offsets)
        whole, count = self._ids([raw[offsets[i] : offsets[i + 1]].decode() for i in rows.tolist()])
        ends = np.cumsum(count)
        parts, at = [], 0
        for k, i in enumerate(rows.tolist()):  # the texts between them, and each of them
            parts.append(self._encode(data[offsets[at] : offsets[i]], offsets[at : i + 1] - offsets[at]))
            parts.append((whole[ends[k] - count[k] : ends[k]], np.array([0, count[k]])))
            at = i + 1
        parts.append(self._encode(data[offsets[at] : offsets[-1]], offsets[at:] - offsets[at]))
        sizes = np.concatenate([np.diff(begin) for _, begin in parts])
        return np.concatenate([ids for ids, _ in parts]).astype(np.uint32), np.concatenate(([0], np.cumsum(sizes)))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends, first = word_pieces(data, offsets)
        units = windows.hashes(windows.prefix(windows.byte_units(data)), starts, ends) ^ windows.mix((ends - starts).astype(np.uint64))
        number = self.look_up(units)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, one = np.unique(units[new], return_index=True)
            if self.known + len(fresh) > MEMO_WORDS:
                self.forget()
                fresh, one = np.unique(units, return_index=True)
                new = np.arange(len(units))
            raw, at = data.tobytes(), new[one]
            self.learn(fresh, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            number[new] = self.look_up(units[new])
        count = self.count[number]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(self.begin[number] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[first]


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with ASCII words lowered, starts and ends of pieces, each text's first piece."""
    _, starts, ends, _ = windows.words(data, offsets)
    if not len(starts):
        return data, starts, ends, np.zeros(len(offsets), np.int64)
    high = np.add.reduceat(data >= 128, starts, dtype=np.int64) > 0
    out = _LOWER[data]
    out[starts[0] :] = np.where(np.repeat(high, np.diff(np.append(starts, len(data)))), data[starts[0] :], out[starts[0] :])
    plain = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))  # the last byte that is no mark
    cut = plain[ends - 1] + 1
    split = (cut > starts) & (cut < ends)
    split[split] = _LETTER[data[cut[split] - 1]]
    begin = np.insert(starts, np.flatnonzero(split) + 1, cut[split])
    end = np.insert(ends, np.flatnonzero(split), cut[split])
    return out, begin, end, np.searchsorted(begin, offsets)


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def compress(ids: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), expansion lengths and the remaining sequence of a block.

    ``lengths``: ids of each document, at least one each; nonterminals count from ``base``."""
    seq, last = ids.astype(np.int64), np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True
    left, right = np.empty(0, np.int64), np.empty(0, np.int64)
    while len(seq) > 1:
        span = base + len(left)
        keys = seq[:-1] * span + seq[1:]
        keys[last[:-1]] = -1
        ordered = np.sort(keys)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero((counts >= LEAST) & (ordered[starts] >= 0))
        if not len(often):
            break
        often = often[np.lexsort((ordered[starts[often]], -counts[often]))][:PAIRS]
        pairs = ordered[starts[often]]
        rule_at = np.zeros(1 << SLOT_BITS, np.int16)
        rule_at[slot(pairs)] = np.arange(len(pairs))
        pairs = pairs[rule_at[slot(pairs)] == np.arange(len(pairs))]  # of pairs that share a slot one waits for the next round
        rule_at[slot(pairs)] = np.arange(len(pairs))
        rule = rule_at[slot(keys)]
        at = np.flatnonzero(pairs[rule] == keys)
        # in a run of neighbouring occurrences every second one is replaced
        first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
        run = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        at = at[run % 2 == 0]
        seq[at] = span + rule[at].astype(np.int64)
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        left, right = np.append(left, pairs // span), np.append(right, pairs % span)
    return left, right, expansion(left, right, base), seq


def expansion(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule refers to earlier rules only."""
    sizes = np.ones(len(left), np.int64)
    done = 0
    while done < len(left):
        # rules whose parts are all done form a prefix: those of one round
        ready = np.maximum(left[done:], right[done:]) < base + done
        end = done + (len(ready) if ready.all() else int(np.argmin(ready)))
        of = lambda part: np.where(part < base, 1, sizes[np.maximum(part - base, 0)])
        sizes[done:end] = of(left[done:end]) + of(right[done:end])
        done = end
    return sizes


def expand(seq: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """The ids behind a sequence of ids and nonterminals."""
    while (high := seq >= base).any():
        at = np.cumsum(1 + high) - 1 - high
        out = np.empty(len(seq) + int(high.sum()), np.int64)
        out[at] = seq
        out[at[high]], out[at[high] + 1] = left[seq[high] - base], right[seq[high] - base]
        seq = out
    return seq


class Block:
    """A stored block, opened for reading."""

    def __init__(self, base: int, doc_ids: bytes, lengths: bytes, left: bytes, right: bytes, sizes: bytes, ids: bytes):
        self.base = base
        self.doc_ids = np.frombuffer(doc_ids, "<i8")
        self.lengths = np.frombuffer(lengths, "<i8")
        self.left, self.right = np.frombuffer(left, "<u4").astype(np.int64), np.frombuffer(right, "<u4").astype(np.int64)
        self.sizes = np.frombuffer(sizes, "<i8")
        self.seq = np.frombuffer(ids, "<u4").astype(np.int64)

    def all(self) -> np.ndarray:
        return expand(self.seq, self.left, self.right, self.base).astype("<u4")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The block's ids start..stop-1; only the parts that overlap them are expanded."""
        if stop <= start:
            return np.empty(0, "<u4")
        high = self.seq >= self.base
        size = np.ones(len(self.seq), np.int64)
        size[high] = self.sizes[self.seq[high] - self.base]
        ends = np.cumsum(size)
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        begin = int(ends[i] - size[i])
        return expand(self.seq[i : j + 1], self.left, self.right, self.base)[start - begin : stop - begin].astype("<u4")

    def document(self, index: int) -> np.ndarray:
        end = int(self.lengths[: index + 1].sum())
        return self.ids(end - int(self.lengths[index]), end)


def blocks(docs: DataFrame, path: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of all documents, in ascending doc_id order (``BLOCKS``).

    ``first`` counts the shard's ids before the block; a null doc_id is stored as the smallest long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = Words.of(path), TaskContext.get().partitionId()
        end, base = np.array([end_id], "<u4").tobytes(), max(words.size, end_id + 1)
        names: list[int] = []
        parts: list[bytes] = []
        held = block = first = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) // 4 for p in parts], "<i8")
            ids = np.frombuffer(b"".join(parts), "<u4")
            left, right, sizes, seq = compress(ids, lengths, base)
            row = [shard, block, first, len(ids), base, np.array(names, "<i8").tobytes(), lengths.tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), sizes.astype("<i8").tobytes(), seq.astype("<u4").tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            ids = columns(batch, "doc_id")[0]
            for row, stop, data, offsets in windows.pieces(batch, "text"):
                flat, at = words.encode(data, offsets)
                for k, i in enumerate(ids[row:stop]):
                    own = flat[at[k] : at[k + 1]].tobytes()
                    if held and held + len(own) // 4 + 1 > block_ids:
                        yield flush()
                        first, block, held = first + held, block + 1, 0
                        names, parts = [], []
                    names.append(-(1 << 63) if i is None else i)
                    parts.append(own + end)
                    held += len(own) // 4 + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, BLOCKS)


def save(docs: DataFrame, path: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the blocks of ``docs`` to the shared folder; returns the table as read back."""
    return written(blocks(docs, path, end_id, block_ids), "repair")


def read(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ``ids`` of every stored document, decoded from the blocks."""
    starts = running_total(table.groupBy("shard").agg(F.sum("n_tokens").alias("ids_of_shard")), "shard", "ids_of_shard")
    table = table.join(F.broadcast(starts.select("shard", "before")), "shard")  # one row for each shard

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out_id, out_start, out_n, out_ids = [], [], [], []
            for row in batch.to_pylist():
                block = Block(*(row[k] for k in ("base", "doc_ids", "lengths", "left", "right", "sizes", "ids")))
                data, at = block.all(), np.append(0, np.cumsum(block.lengths))
                for i, d in enumerate(block.doc_ids.tolist()):
                    out_id.append(None if d == -(1 << 63) else d)
                    out_start.append(row["before"] + row["first"] + int(at[i]))
                    out_n.append(int(block.lengths[i]))
                    out_ids.append(data[at[i] : at[i + 1]].tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(out_id, pa.int64()), pa.array(out_start, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_ids, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

        return each

    # a block is a few MB; its rows leave one block at a time
    return over_rows(table, make, "doc_id long, start long, n_tokens long, ids binary")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of decoded documents."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
