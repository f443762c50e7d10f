"""SimHash near-duplicates by anchor-point covering.

A fingerprint bit is 1 if it is set in more than half of the hashes of a text's word shingles.
Fingerprints are cut into blocks; two that differ in at most t bits agree up to t // blocks bits
in some block. The anchors of a block are the words of a linear code that covers all block values
within its radius R. A fingerprint is replicated to every anchor at which it could meet one whose
own nearest anchor that is: those within R + t // blocks that some value within t // blocks of it
decodes to. At each anchor the fingerprints whose nearest anchor it is (home) are compared with
all that are there. Comparison streams over sorted partitions; a group of many is compared tile by
tile, and gives links enough to join what it joins, never all its pairs.

Equal fingerprints are one node, so copies, however many, cost one row.

Defined cases: a null text is empty; a text without words has fingerprint zero, which links like
any other; fewer words than a shingle make one shingle of all; repeats count; a null doc_id never
is the smallest while its component has another id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm import windows
from runweave.llm.common import columns, over_rows, sifted, text_bytes, text_hash, written
from runweave.llm.components import attached, components
from runweave.llm.imatch import terms_of

SEED = 42
#: Members of an anchor that are compared at once; of a crowded anchor those that a task holds, such anchors
#: at most, and a look at one in so many fingerprints that finds them.
TILE, CROWD, CROWDS, LOOK = 2048, 1 << 14, 1000, 64
#: Members of a component that a task compares with others at once.
MEMBERS = 512
#: Documents of the sample for frequent shingles at least, of which it has one in so many, and those shingles at most;
#: rows of a task's prefixes and pairs of them at once.
SAMPLE, SHARE, FREQUENT, ROWS, AT_ONCE = 5_000, 64, 200_000, 1 << 16, 1 << 20


@dataclass(frozen=True)
class Plan:
    """Words in a shingle, bits of a fingerprint, bits of a block, and the most differing bits."""

    shingle: int = 3
    bits: int = 64
    block: int = 32
    distance: int = 3

    @property
    def blocks(self) -> int:
        return self.bits // self.block

    @property
    def lanes(self) -> int:
        return -(-self.bits // 64)


#: Proposes links of five-word shingles: 5 blocks of a 23-bit Golay code, one bit of slack each, which meet
#: 97 % of pairs at similarity 0.95, 82 % at 0.9 and 46 % at 0.8, enough to join crowds of near copies.
#: ``similar`` confirms what it proposes and finds all the others.
NEAR = Plan(shingle=5, bits=115, block=23, distance=16)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the shingles, repeats included, of the ASCII-lowered words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    cut = [joined[i:j] for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))


def lane(hashes: np.ndarray, i: int) -> np.ndarray:
    """The hashes for the i-th 64 bits of a fingerprint; lane 0 has them as they are."""
    if not i:
        return hashes
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * i) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: The bits of a byte, each in a byte of a number: 255 of them add up without a carry.
_SPREAD = np.ascontiguousarray(_BITS_OF_BYTE.astype(np.uint8)).view(np.uint64).ravel()


def fingerprint(hashes: np.ndarray, plan: Plan) -> bytes:
    """The fingerprint of shingle hashes, big-endian, 8 bytes a lane."""
    out = b""
    for i in range(plan.lanes):
        data = lane(hashes, i).astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(data) < 2048:
            counts = np.zeros(64, np.int64)
            for k in range(0, len(data), 255):
                counts += _SPREAD[data[k : k + 255]].sum(0, dtype=np.uint64).view(np.uint8)
        else:  # one count for each byte value, then the bits of the values
            counts = np.concatenate([np.bincount(data[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
        out += np.packbits(counts * 2 > len(data)).tobytes()
    return out


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, text_hash and ``fp`` (binary) of every document."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            (texts,) = columns(batch, "text")
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(shingle_hashes(t, plan.shingle), plan) for t in texts], pa.binary())], names=["doc_id", "text_hash", "fp"])

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text_bytes())
    return over_rows(rows, make, "doc_id long, text_hash long, fp binary")


class Code:
    """A linear covering code of ``block`` bits, by its syndromes: 23 bits is the Golay code
    (radius 3); else a Hamming code (radius 1) on 2**r - 1 bits, the bits beyond it as they are."""

    def __init__(self, block: int):
        self.block = block
        if block == 23:
            generator, checks, column, radius = 0b101011100011, 11, [], 3
            for i in range(block):  # x**i modulo the generator
                x = 1 << i
                for k in range(block - 1, checks - 1, -1):
                    if x >> k & 1:
                        x ^= generator << (k - checks)
                column.append(x)
        else:
            checks, radius = (block + 1).bit_length() - 1, 1
            column = [i + 1 if i + 1 < 1 << checks else 0 for i in range(block)]
        self.column = np.array(column, np.uint64)
        self.leader = np.zeros(1 << checks, np.uint64)  # the least change that makes a code word
        for weight in range(radius, 0, -1):
            for at in combinations([i for i, c in enumerate(column) if c], weight):
                syndrome = 0
                for i in at:
                    syndrome ^= column[i]
                self.leader[syndrome] = sum(1 << i for i in at)
        self.leader[0] = 0

    def home(self, values: np.ndarray) -> np.ndarray:
        """The nearest anchor of each value."""
        syndrome = np.zeros(len(values), np.uint64)
        for i, c in enumerate(self.column):
            syndrome ^= (values >> np.uint64(i) & np.uint64(1)) * c
        return values ^ self.leader[syndrome.astype(np.int64)]

    def anchors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, home): each value at every anchor that is the nearest one of a value at
        most one bit away."""
        own = self.home(values)
        every = np.stack([own, *(self.home(values ^ np.uint64(1 << i)) for i in range(self.block))], axis=1)
        order = np.sort(every, axis=1)
        new = np.ones(order.shape, bool)
        new[:, 1:] = order[:, 1:] != order[:, :-1]
        row, _ = np.nonzero(new)
        anchor = order[new]
        return row, anchor, anchor == own[row]


@cache
def code_of(block: int) -> Code:
    return Code(block)


def lanes_of(fps: list[bytes], lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").reshape(len(fps), lanes).astype(np.uint64)


def block_values(fps: np.ndarray, plan: Plan, i: int) -> np.ndarray:
    """Bits i*block.. of fingerprints (counted from the top of lane 0) as numbers."""
    at, shift = divmod(i * plan.block, 64)
    low, mask = 64 - shift - plan.block, np.uint64((1 << plan.block) - 1)
    if low >= 0:
        return fps[:, at] >> np.uint64(low) & mask
    return (fps[:, at] << np.uint64(-low) | fps[:, at + 1] >> np.uint64(64 + low)) & mask


def replicated(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(anchor, home, fp): each distinct fingerprint at its anchors in every block."""

    def make():
        code = code_of(plan.block)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            (names,) = columns(batch, "fp")
            fps = lanes_of(names, plan.lanes)
            rows, keys, homes = [], [], []
            for i in range(plan.blocks):
                row, anchor, home = code.anchors(block_values(fps, plan, i))
                rows.append(row)
                keys.append(anchor << np.uint64(6) | np.uint64(i))
                homes.append(home)
            take = pa.array(np.concatenate(rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(homes)), batch.column(0).take(take)],
                names=["anchor", "home", "fp"],
            )

        return each

    return over_rows(nodes, make, "anchor long, home boolean, fp binary")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits between fingerprints of the same rows."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def small_groups(keys: np.ndarray, home: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows (i, j) of one anchor, one of them at home; rows are sorted by anchor."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step, i = 1, np.arange(len(keys))
    while len(i := i[i + step < len(keys)]) and len(i := i[keys[i] == keys[i + step]]):
        j = i + step
        take = (home[i] | home[j]) & (near(fps[i], fps[j]) <= distance)
        left.append(i[take])
        right.append(j[take])
        step += 1
    return np.concatenate(left), np.concatenate(right)


def large_group(home: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for the rows of one anchor with many members, homes first, tile by tile.

    Instead of all links a member gets one to the first home it links with in a tile, and the
    homes it links with get one to that first home, each pair once: they join the same members."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    homes = int(home.sum())
    for h in range(0, homes, TILE):
        tile = fps[h : min(h + TILE, homes)]
        pairs = np.empty(0, np.int64)
        for y in range(0, len(fps), TILE // 4):
            part = fps[y : y + TILE // 4]
            differ = sum(np.bitwise_count(part[:, None, k] ^ tile[None, :, k]).astype(np.uint16) for k in range(fps.shape[1]))
            row, col = np.nonzero(differ <= distance)
            if not len(row):
                continue
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            first = np.repeat(col[begin], np.diff(np.append(begin, len(row))))
            left.append(y + row[begin])
            right.append(h + col[begin])
            pairs = np.union1d(pairs, first * TILE + col)
        left.append(h + pairs // TILE)
        right.append(h + pairs % TILE)
    return np.concatenate(left), np.concatenate(right)


def spanning(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between rows those that join fingerprints not joined before, least fingerprints first:
    fewer than there are fingerprints, however many links a crowd has."""
    _, row, name = np.unique(fps, axis=0, return_index=True, return_inverse=True)
    name = name.reshape(-1)
    pairs = np.unique(np.sort(np.stack([name[left], name[right]]), axis=0), axis=1)
    root, take = list(range(len(row))), []
    for k, (x, y) in enumerate(pairs.T.tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            take.append(k)
    return row[pairs[0, take]], row[pairs[1, take]]


def crowded(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(anchor, tiles) of anchors with very many members, by a sample of the fingerprints. It decides how
    members are dealt to tasks, not what is found."""
    some = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(LOOK)) == 0)
    counts = replicated(some, plan).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") * LOOK > CROWD)
    return written(counts.orderBy(F.desc("n"), "anchor").limit(CROWDS).select("anchor", F.ceil(F.col("n") * LOOK / CROWD).cast("int").alias("tiles")), "crowded")


def dealt(rows: DataFrame, crowds: DataFrame) -> DataFrame:
    """(anchor, home, fp): of a crowded anchor each tile of homes with each tile of members, under a key
    of its own; equal keys by chance only add comparisons."""
    rows = rows.join(F.broadcast(crowds), "anchor", "left")  # CROWDS rows at most
    few = rows.where("tiles is null").select("anchor", "home", "fp")
    many = rows.where("tiles is not null").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    homes = many.where("home").select(F.xxhash64("anchor", "own", F.col("other").cast("long")).alias("anchor"), "home", "fp")
    members = many.where("not home or own <> other").select(F.xxhash64("anchor", F.col("other").cast("long"), "own").alias("anchor"), F.lit(False).alias("home"), "fp")
    return few.union(homes).union(members)


def links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): links between distinct fingerprints (``nodes``: fp), that join all that are joined by pairs
    at most ``plan.distance`` bits apart which meet at an anchor."""
    rows = dealt(replicated(nodes, plan), crowded(nodes, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(keys: list[np.ndarray], homes: list[np.ndarray], fps: list[np.ndarray]) -> pa.RecordBatch:
            key, home, fp = np.concatenate(keys), np.concatenate(homes), np.concatenate(fps)
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.append(begin, len(key)))
            many = size > 64
            few = np.repeat(~many, size)
            at = np.flatnonzero(few)
            i, j = small_groups(key[few], home[few], fp[few], plan.distance)
            left, right = [at[i]], [at[j]]
            for b, n in zip(begin[many].tolist(), size[many].tolist(), strict=True):
                i, j = large_group(home[b : b + n], fp[b : b + n], plan.distance)
                left.append(b + i)
                right.append(b + j)
            a, b = spanning(fp, np.concatenate(left), np.concatenate(right))
            out = [pa.array([x.tobytes() for x in fp[v].astype(">u8")], pa.binary()) for v in (a, b)]
            return pa.RecordBatch.from_arrays(out, names=["a", "b"])

        keys, homes, fps = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            home = batch.column(1).to_numpy(zero_copy_only=False)
            fp = lanes_of(batch.column(2).to_pylist(), plan.lanes)
            cut = int(np.searchsorted(key, key[-1]))  # the last anchor may go on in the next batch
            if cut or (keys and keys[-1][-1] != key[-1]):
                yield compare([*keys, key[:cut]], [*homes, home[:cut]], [*fps, fp[:cut]])
                keys, homes, fps = [], [], []
            keys.append(key[cut:])
            homes.append(home[cut:])
            fps.append(fp[cut:])
        if keys:
            yield compare(keys, homes, fps)

    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", F.desc("home"))
    return ordered.mapInArrow(run, "a binary, b binary")


def components_of(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, fp (binary) and component_id, the smallest doc_id that links reach. Links are searched
    among distinct fingerprints only, and rows are added up to those first."""
    prints = written(fingerprints(docs, plan).select("doc_id", "fp"), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), plan)).withColumnRenamed("node", "fp")
    nodes = written(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "nodes")
    least = written(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    found = written(attached(nodes, "root", least).select("fp", "component_id"), "found")
    return attached(prints, "fp", found)


def deduplicated(docs: DataFrame, plan: Plan = NEAR) -> DataFrame:
    """The documents that stay, in their columns: of each component of texts whose sets of shingles
    have a Jaccard similarity of 0.8 and more the row with the smallest doc_id (null after all
    others; of rows that share it, the least text hash; of equal rows one)."""
    kept = similar(docs, plan).select(F.col("kept.doc_id").alias("_runweave_id"), F.col("kept.text_hash").alias("_runweave_hash"))
    lowest = F.lit(-(1 << 63))  # a null id
    kept = written(kept.withColumn("_runweave_id", F.coalesce("_runweave_id", lowest)), "kept")
    once = docs.withColumns({"_runweave_id": F.coalesce(F.col("doc_id").cast("long"), lowest), "_runweave_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    keys = ["_runweave_id", "_runweave_hash"]  # the join deals rows by them already, so equal rows stand together
    every = once.groupBy(*keys).agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), keys, "left")
    some, others = sifted(once, keys, every.where("stays is null or n > 1"))  # most rows stay, and stay where they are
    return others.drop(*keys).union(some.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys))


def similar(docs: DataFrame, plan: Plan = NEAR) -> DataFrame:
    """root, of each component of similar sets, and ``kept``: no_id, doc_id, text_hash of its first row.

    Near fingerprints come first: what they link and the sets confirm joins crowds of copies without
    listing their pairs. Fingerprints that lie apart, or never meet at an anchor, can still belong to
    similar sets, so prefixes of the sets find every pair that is left between two components."""
    prints = written(shingled(docs, plan), "shingled")
    nodes = prints.groupBy("node").agg(F.first("fp").alias("fp"))
    one = written(nodes.groupBy("fp").agg(F.min("node").alias("one")), "prints")
    met = links(one.select("fp"), plan)
    met = met.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b").select("y", "x")
    same = nodes.join(one, "fp").where("node <> one").select("node", "one")
    near = written(met.union(same).toDF("a", "root").where("a <> root").distinct(), "near")
    close = written(confirmed(near, near.select(F.col("root").alias("b"), "root").distinct(), prints, docs, plan), "close")
    more = confirmed(*sharing(docs, components(close), plan), prints, docs, plan)
    roots = components(close.union(more)).select("node", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("kept")
    nodes = prints.groupBy("node").agg(first).join(roots, "node", "left")  # copies are one row by then
    return nodes.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("kept").alias("kept"))


def shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes (rolling hashes of ASCII-lowered words), sorted."""
    for row, stop, data, offsets in windows.pieces(batch, column):
        units, first = terms_of(data, offsets)
        sums = windows.prefix(units)
        start = np.arange(max(len(units) - width + 1, 0))
        every = windows.hashes(sums, start, start + width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            else:  # one shingle of all words; none without words
                yield windows.hashes(sums, np.array([a] * (b > a), np.int64), np.array([b] * (b > a), np.int64))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def sketch(members: np.ndarray) -> bytes:
    """Parities of a set, in 64 bits or the next power of two of its size: two sets differ in as many members at
    least as their sketches in bits."""
    bits = max(64, 1 << max(len(members) - 1, 0).bit_length())
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Sketches (64-bit words, in the last axis) as of n words."""
    while words.shape[-1] > n:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def shingled(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, text_hash, node, ``fp`` (binary), size and sketch of the set of every document."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [(node_of(x), fingerprint(x, plan), len(x), sketch(x)) for x in shingle_sets(batch, "text", plan.shingle)]
            own = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["doc_id", "text_hash", "node", "fp", "size", "sketch"])

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text_bytes())
    return over_rows(rows, make, "doc_id long, text_hash long, node long, fp binary, size long, sketch binary")


def possible(dealt: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, root, tile): rows of ``dealt`` (node, root, tile, held) that are not held and that sizes and
    ``sketches`` (node, size, sketch) allow a similarity of 0.8 and more to one that is, in their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index = None, {}  # the open tile's members by the words of their sketches
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for node, root, tile, member, size, own in zip(*columns(batch, "node", "root", "tile", "held", "size", "sketch"), strict=True):
                if (root, tile) != key:
                    key, index = (root, tile), {}
                own = np.frombuffer(own, "<u8")
                if member:
                    index.setdefault(len(own), []).append((node, size, own))
                    continue
                for n, rows in index.items():
                    if isinstance(rows, list):
                        rows = index[n] = tuple(np.array(x) for x in zip(*rows, strict=True))
                    if max(n, len(own)) > 2 * min(n, len(own)):
                        continue  # of two sizes of which one is 1.25 times the other at most
                    nodes, sizes, words = rows
                    least = min(n, len(own))
                    apart = np.bitwise_count(folded(words, least) ^ folded(own, least)).sum(1, dtype=np.int64)
                    if ((9 * np.maximum(apart, abs(sizes - size)) <= sizes + size) & (nodes != node)).any():
                        out.append((node, root, tile))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["node", "root", "tile"])

    rows = dealt.join(sketches, "node").select("node", "root", "tile", "held", "size", "sketch")
    return rows.repartition("root", "tile").sortWithinPartitions("root", "tile", F.desc("held")).mapInArrow(run, "node long, root long, tile int")


def confirmed(asked: DataFrame, members: DataFrame, prints: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of nodes (a, b) whose sets have a similarity of 0.8 and more, by the text of one document of
    each node: each a of ``asked`` (a, root) is compared with every b of its root in ``members`` (b, root),
    tile by tile, and gives one pair a tile.

    No row is made for a pair: an a travels to the tiles of a root, a b to one of them. Texts travel
    compressed, and hardly any but those that are compared: those whose sketches leave it open."""
    asked = written(asked, "asked")
    members = written(members.select(F.col("b").alias("node"), "root"), "members")
    tiles = members.groupBy("root").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("tiles"))
    one = F.col("tiles") > 1
    members = members.join(tiles, "root").select("node", "root", F.when(one, F.pmod(F.xxhash64("node"), F.col("tiles"))).otherwise(F.lit(0)).cast("int").alias("tile"), F.lit(True).alias("held"))
    others = asked.select(F.col("a").alias("node"), "root").join(tiles, "root")
    others = others.select("node", "root", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(False).alias("held"))
    dealt = written(members.union(others), "dealt")

    own, _ = sifted(prints, ["node"], dealt)
    left = written(possible(dealt, own.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))), "possible")
    tiles = left.select("root", "tile").distinct()
    dealt = written(dealt.where("held").join(tiles, ["root", "tile"], "left_semi").select(dealt.columns).union(left.withColumn("held", F.lit(False))), "left")

    lowest = F.lit(-(1 << 63))  # a null id
    first = F.min(F.struct(F.coalesce("doc_id", lowest).alias("id"), F.col("text_hash").alias("hash"))).alias("one")
    who = written(prints.groupBy("node").agg(first).join(dealt.select("node").distinct(), "node", "left_semi").select("node", "one.id", "one.hash"), "who")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("id"), text_hash().alias("hash"), text_bytes())
    rows, _ = sifted(rows, ["id", "hash"], who)
    texts = packed(rows).join(who, ["id", "hash"]).select("node", "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, key = zstandard.ZstdDecompressor(), None
        nodes: list[int] = []  # the open tile's members, their sets' sizes, and all they hold, sorted
        sets: list[np.ndarray] = []
        index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, roots, tiles, held, texts = columns(batch, "node", "root", "tile", "held", "text")
            plain = pa.RecordBatch.from_arrays([pa.array([opened.decompress(t) for t in texts], pa.large_binary())], names=["text"])
            out = []
            for node, root, tile, member, own in zip(names, roots, tiles, held, shingle_sets(plain, "text", plan.shingle), strict=True):
                if (root, tile) != key:
                    key, nodes, sets, index = (root, tile), [], [], None
                if member:
                    nodes.append(node)
                    sets.append(own)
                    continue
                if index is None:
                    every = np.concatenate(sets)
                    order = np.argsort(every, kind="stable")
                    size = np.array([len(x) for x in sets])
                    index = every[order], np.repeat(np.arange(len(sets)), size)[order], size
                every, of, size = index
                low, high = np.searchsorted(every, own), np.searchsorted(every, own, "right")
                hit = np.flatnonzero(high > low)
                n = (high - low)[hit]
                at = np.repeat(low[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.bincount(of[at], minlength=len(size))
                near = np.flatnonzero((5 * both >= 4 * (len(own) + size - both)) & (np.array(nodes) != node))
                if len(near):
                    out.append((node, nodes[near[0]]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = dealt.join(texts, "node").select("node", "root", "tile", "held", "text")
    return rows.repartition("root", "tile").sortWithinPartitions("root", "tile", F.desc("held")).mapInArrow(run, "a long, b long")


def packed(rows: DataFrame) -> DataFrame:
    """id, hash and the compressed text."""

    def make():
        press = zstandard.ZstdCompressor(level=1)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            (texts,) = columns(batch, "text")
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(t) for t in texts], pa.binary())], names=["id", "hash", "text"])

        return each

    return over_rows(rows, make, "id long, hash long, text binary")


def prefix_length(size: np.ndarray) -> np.ndarray:
    """Two sets with a similarity of 0.8 and more share one of so many first members in any order."""
    return size - (4 * size + 4) // 5 + 1


def frequent(docs: DataFrame, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in very many documents, by a sample, sorted, and their counts there. They
    only decide the order of members, and any order finds all pairs; rare ones first find few others."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            unit, n = np.unique(np.concatenate(list(shingle_sets(batch, "text", plan.shingle))), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(n)], names=["unit", "n"])

        return each

    apart = min(SHARE, max(1, docs.count() // SAMPLE))  # a share, or what counts as rare grows with the documents, and pairs with its square
    rows = docs.where(F.pmod(text_hash(), F.lit(apart)) == 0).select(text_bytes())
    counts = over_rows(rows, make, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    top = counts.where("n >= 3").orderBy(F.desc("n"), "unit").limit(FREQUENT).toPandas()
    unit, n = top["unit"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(unit)
    return unit[order], n[order]


def sharing(docs: DataFrame, roots: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(a, root): nodes and components of ``roots`` (node, root) that may hold a similar node, and (b, root):
    all nodes of those components. A node without a root is a component of its own."""
    roots = written(roots, "roots")
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, plan))

    def make_prefixes():
        unit, n = shared.value
        seen = set()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for members in shingle_sets(batch, "text", plan.shingle):
                node = node_of(members)
                if node in seen or not len(members):
                    continue
                seen.add(node)
                if len(unit):
                    at = np.minimum(np.searchsorted(unit, members), len(unit) - 1)
                    members = members[np.argsort(np.where(unit[at] == members, n[at], 0), kind="stable")]
                out.append((node, len(members), members[: int(prefix_length(np.int64(len(members))))].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["node", "size", "prefix"])

        return each

    prefixes = over_rows(docs.select(text_bytes()), make_prefixes, "node long, size long, prefix binary").dropDuplicates(["node"])
    crowds = roots.join(roots.groupBy("root").agg(F.count("*").alias("crowd")), "root")
    prefixes = prefixes.join(crowds, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "prefix", F.coalesce("crowd", F.lit(1)).cast("int").alias("crowd"))

    def flat(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, root, size, _, crowd = (batch.column(i).to_numpy(zero_copy_only=False) if i != 3 else None for i in range(5))
        keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
        row = np.repeat(np.arange(len(node)), prefix_length(size))
        return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(v[row]) for v in (root, node, size, crowd))], names=["key", "root", "node", "size", "crowd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Each node with each other component of its key, not smaller than its own: one row, however
            many members that has, and the least number of keys that one of them would share with it."""
            key, root, node, size, many_of = rows
            new = np.append(True, key[1:] != key[:-1])
            fresh = new | np.append(True, root[1:] != root[:-1])
            first = np.flatnonzero(fresh)  # of each component in each key
            of_key, mass, count = np.cumsum(new)[first], many_of[first], np.diff(np.append(first, len(key)))
            least, most = np.minimum.reduceat(size, first), np.maximum.reduceat(size, first)
            place = np.arange(len(first))
            end = np.searchsorted(of_key, of_key, "right")
            total = np.cumsum(end - place - 1)
            at = 0
            while at < len(first):  # some at a time: what is listed at once is bounded
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
                n = end[at:to] - place[at:to] - 1
                i = np.repeat(place[at:to], n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
                low = (mass[i] < mass[j]) | (mass[i] == mass[j]) & (root[first[i]] < root[first[j]])
                i, j = np.where(low, i, j), np.where(low, j, i)
                row = np.repeat(first[i] - (np.cumsum(count[i]) - count[i]), count[i]) + np.arange(int(count[i].sum()))
                j = np.repeat(j, count[i])
                own = size[row]
                a, z = np.maximum(least[j], (4 * own + 4) // 5), np.minimum(most[j], 5 * own // 4)
                need = np.minimum(shared_least(own, a), shared_least(own, z))  # it is least at an end
                take = a <= z
                if take.any():
                    yield pa.RecordBatch.from_arrays([pa.array(v[take]) for v in (node[row], root[first[j]], need)], names=["a", "root", "need"])
                at = to

        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            rows += batch.num_rows
            if rows >= ROWS and held[0][0, 0] != held[-1][0, -1]:
                every = np.concatenate(held, axis=1)
                cut = int(np.flatnonzero(every[0] != every[0, -1])[-1]) + 1  # the last key may go on
                yield from pairs(every[:, :cut])
                held, rows = [every[:, cut:]], every.shape[1] - cut
        if held:
            yield from pairs(np.concatenate(held, axis=1))

    rows = over_rows(prefixes, lambda: flat, "key long, root long, node long, size long, crowd int")
    found = rows.repartition("key").sortWithinPartitions("key", "root").mapInArrow(run, "a long, root long, need long")
    found = found.groupBy("a", "root").agg(F.count("*").alias("common"), F.min("need").alias("need"))
    found = written(found.where("common >= need").select("a", "root"), "found")
    members = roots.select(F.col("node").alias("b"), "root")
    alone = found.select("root").distinct().join(members, "root", "left_anti").select(F.col("root").alias("b"), "root")
    return found, members.join(found.select("root").distinct(), "root", "left_semi").select("b", "root").union(alone)


def shared_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members the prefixes of similar sets of these sizes share at least: of the set whose prefix
    ends first, all members of it that the other set has are in the other's prefix too. That is a set's own
    prefix without what it alone has, and least for the longer set. Without the roundings, which would make
    it rise and fall with a size by one, it is 1 - (4 * longer + 4) / 5 + 4 * (a + b) / 9 at least."""
    shorter, longer = np.minimum(a, b), np.maximum(a, b)
    return -((16 * longer - 20 * shorter - 9) // 45)
