"""Byte-level BPE by Aho-Corasick longest matches and backtracking.

Bytes are mapped to Latin-1 so that pyahocorasick sees one character for each byte. A piece is
encoded from left to right with the longest token at each place; a token may follow another only
if merging the bytes of the two would give back exactly these two tokens, which ``Ranks.adjacent``
decides by undoing merges (answers are memoised). When no token fits, the place is marked dead and
the last token is shortened. Every place dies at most once, so the work is linear in the piece;
the ids are those of the merge order.

Defined cases: null and empty texts have no ids; very long pieces are encoded whole, without the
memo; repeated rows are encoded again; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from runweave.llm.common import columns, over_rows, text_bytes

#: Pieces that a worker remembers, and the longest one it does.
MEMO_PIECES, MEMO_LENGTH = 400_000, 48


class Ranks:
    """A vocabulary of byte strings with merge ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.matches = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.matches.add_word(t.decode("latin-1"), (len(t), r))
        self.matches.make_automaton()
        self._parts: dict[int, tuple[int, int]] = {}
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; a single byte is its own parts."""
        if token not in self._parts:
            data = self.token[token]
            left = [data[i : i + 1] for i in range(len(data))]
            while len(left) > 2:
                at = min(range(len(left) - 1), key=lambda i: self.rank.get(left[i] + left[i + 1], 1 << 40) if len(left[i]) + len(left[i + 1]) < len(data) else 1 << 40)
                left[at : at + 2] = [left[at] + left[at + 1]]
            self._parts[token] = (self.rank[left[0]], self.rank[left[-1]])
        return self._parts[token]

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if there is none."""
        if token not in self._shorter:
            data = self.token[token]
            self._shorter[token] = next((r for n in range(len(data) - 1, 0, -1) if (r := self.rank.get(data[:n])) is not None), -1)
        return self._shorter[token]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` side by side leaves exactly ``a`` and ``b``."""
        key = (a, b)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        # Undo the later of the two last merges, step by step. A pair that meets across the seam
        # is merged first if its rank is below the rank of the merge just undone; of equal ranks
        # the left one comes first.
        token, rank, before = self.token, self.rank, 1 << 40
        while True:
            across = rank.get(token[a] + token[b])
            if across is not None and across < before and self.parts(across) == (a, b):
                return False
            whole_a, whole_b = len(token[a]) == 1, len(token[b]) == 1
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                before, a = a, self.parts(a)[1]
            else:
                before, b = b + 1, self.parts(b)[0]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest, length = [-1] * n, [0] * n
        for end, (size, r) in self.matches.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > length[start]:
                longest[start], length[start] = r, size
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(self.token[token])
            if alive[end] and (not out or self.adjacent(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = self.shorter(token)
            while token < 0:
                alive[at] = 0
                last = out.pop()
                at -= len(self.token[last])
                token = self.shorter(last)


class Pieces(dict):
    """Piece of a text -> its ids as little-endian 32-bit integers; filled as pieces come."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.ranks.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoding and decoding of texts; one for each worker and vocabulary."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.ranks)
        self.bytes_of = [self.ranks.token.get(i, b"") for i in range(max(self.ranks.token, default=-1) + 1)]

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids``: the ids of each text as little-endian unsigned 32-bit integers."""

    def make():
        codec = Codec.of(path, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            (texts,) = columns(batch, "text")
            ids = [codec.encode(t.decode()) for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

        return each

    return over_rows(docs.select("doc_id", text_bytes()), make, "doc_id long, ids binary")


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``text`` (binary): the bytes that each row's ``ids`` stand for."""

    def make():
        codec = Codec.of(path, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            (rows,) = columns(batch, "ids")
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x) for x in rows], pa.binary())], names=["doc_id", "text"])

        return each

    return over_rows(ids.select("doc_id", "ids"), make, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        codec = Codec.of(path, pattern)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            (texts,) = columns(batch, "text")
            counts, ids_hash, text_hash = [], [], []
            for t in texts:
                ids = codec.encode(t.decode())
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return each

    return over_rows(docs.select("doc_id", text_bytes()), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
