"""The corpus operators against brute force, with odd rows: null and empty texts, null and repeated
doc_ids, repeated rows, long and repetitive texts, further columns with names the operators use."""

import hashlib
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runweave.llm import brown, byte_bpe, components, decontamination, imatch, repair, sharding, simhash, substring, suffix, toxicity
from runweave.llm.common import held_out, sifted

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "ré", "Sa", "vo") for b in ("n", "ra", "st", "x,", "l.", "")]


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage = text(70)
    rows = [(i, text(rng.randint(0, 120))) for i in range(n)]
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 3, passage), (n + 4, text(30) + " " + passage + "\n" + text(20)), (n + 5, passage[: len(passage) // 2] + " x " + passage)]
    rows += [(n + 6, None), (n + 7, ""), (n + 8, " \t\n"), (None, passage), (None, None), (5, "another text with the same id " + passage), (7, rows[7][1])]
    rows += [(n + 9, "la " * 3000), (n + 10, "la " * 2000 + "end"), (n + 11, "ab" * 400), (n + 12, "  don't\x1c STOP 12 <|endoftext|> 🙂")]
    rng.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(params=[3, 400])
def docs(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    rows = [(i, t, "fp", 1, [2], None if t is None else len(t)) for i, t in ROWS]
    yield spark.createDataFrame(rows, "doc_id long, text string, fp string, text_hash int, contexts array<int>, n_chars long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- fingerprints --------------------------------------------------------------------------------


def test_imatch_pairs_and_edits(docs):
    rows = imatch.compared(docs, imatch.band(docs)).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in ROWS), key=lambda x: (not x[0], -x[1], x[2].encode()))
    want = Counter()
    for k, (has, i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        want[(i if has else None, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    texts = Counter(hashlib.sha256((t or "").encode()).hexdigest() for i, t in ROWS)
    prints = imatch.fingerprints(docs.select(F.col("doc_id"), "text"), imatch.band(docs)).collect()
    once = {i for i, n in Counter(i for i, _ in ROWS).items() if n == 1}
    of = dict(ROWS)
    same = {}
    for r in prints:
        if r["doc_id"] in once:
            same.setdefault(of[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert len(texts) > len(same) > 50 and all(len(v) == 1 for v in same.values())


def test_imatch_likeness():
    terms = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 400, dtype=np.uint64))
    made = imatch.Lexicons(terms)
    whole, part, other = made.fingerprint(terms[:200]), made.fingerprint(terms[20:200]), made.fingerprint(terms[200:])
    assert imatch.likeness(whole, whole) == 1 and imatch.likeness(whole, part) > 0.6 > 0.2 > imatch.likeness(whole, other)
    assert imatch.likeness(made.fingerprint(terms[:0]), whole) == 0


def plain_imatch(text, kept):
    """The level and, for each stored level, lexicon -> 16 bits, by loops over terms and lexicons."""
    mix = lambda x: int(imatch.windows.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    terms = {int(u) for u in imatch.terms_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]}
    own = terms & kept or terms
    if not own:
        return "0"
    level = max(1, int(np.ceil(np.log2(len(own)))) + 1)
    out = [f"{level}{'' if terms & kept else '*'}"]
    for j in range(level, level + imatch.LEVELS):
        entries = ""
        for lexicon in range(imatch.LEXICONS):
            seed = mix((lexicon + 1) * 0xD6E8FEB86659FD93)
            inside = [t for t in sorted(own) if 32 - (mix(t ^ seed) >> 32).bit_length() >= j]
            if inside:
                value = mix(sum(mix(t) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, t in enumerate(inside)))
                entries += f"{lexicon:02x}{value >> 8 & 255:02x}{value & 255:02x}"
        out.append(entries)
    return ":".join(out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if "0" in (a, b):
        return 0.0
    levels = [int(x.split(":")[0].rstrip("*")) for x in (a, b)]
    if max(levels) - min(levels) >= imatch.LEVELS:
        return 0.0
    stored = [x.split(":")[1 + max(levels) - n] for x, n in zip((a, b), levels, strict=True)]
    one, two = ({x[i : i + 2]: x[i + 2 : i + 6] for i in range(0, len(x), 6)} for x in stored)
    return sum(one.get(k) == two.get(k) for k in one.keys() | two.keys()) / max(1, len(one.keys() | two.keys()))


def test_imatch_equals_a_plain_version(docs):
    """Band, fingerprints, edited fingerprints and likeness of every row."""
    terms = lambda t: {int(u) for u in imatch.terms_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]}
    df = Counter(u for _, t in ROWS for u in terms((t or "").encode()))
    kept = {u for u, n in df.items() if n >= 2 and n <= max(2, imatch.COMMON * len(ROWS))}
    band = imatch.band(docs)
    assert set(band.tolist()) == kept
    order = sorted(((i is not None, i or 0, t or "") for i, t in ROWS), key=lambda x: (not x[0], -x[1], x[2].encode()))
    want, prints = Counter(), {}
    fp = lambda t: prints.setdefault(t, plain_imatch(t.encode(), kept))
    for k, (has, i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        want[(i if has else None, fp(t), fp(edited), round(plain_likeness(fp(t), fp(edited)), 9), round(plain_likeness(fp(t), fp(following)), 9))] += 1
    got = Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in imatch.compared(docs, band).collect())
    assert got == want


def test_imatch_empty(spark, none):
    assert imatch.compared(none, imatch.band(none)).count() == 0


# --- class n-grams -------------------------------------------------------------------------------


def test_brown_base_and_counts(docs):
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in ROWS if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in ROWS)
    got = brown.scores(docs, held_out(5)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 1e-9 for r in got)


def brown_parts(spark, seed, **parameters):
    rows = [(i, t) for i, t in corpus(seed) if i is not None]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    counts = brown.unigrams(texts)
    return [t or "" for _, t in rows], counts, brown.fitted(texts, counts, **parameters)


@pytest.mark.parametrize("parameters", [{"head": 30, "core": 20, "classes": 4, "least": 1}, {"core": 12, "classes": 3, "dense": 12}, {"core": 5, "dense": 400}])
def test_brown_probabilities_add_up(spark, parameters):
    _, counts, m = brown_parts(spark, 4, **parameters)
    n = {r["unit"]: r["n"] for r in counts.collect()}
    rare = len(n) - len(m.units) + 1  # and the unknown one
    assert np.allclose((10**m.transition).sum(1), 1)
    mass = np.bincount(m.classes, (m.counts + 0.5) / 10 ** m.mass[m.classes], minlength=len(m.transition))
    mass[brown.RARE_CLASS] += (sum(n.values()) - m.counts.sum() + 0.5 * rare) / 10 ** m.mass[brown.RARE_CLASS]
    assert np.allclose(mass, 1)
    assert set(m.classes[:-1].tolist()) <= set(range(2, len(m.transition))) and m.classes[-1] == brown.END_CLASS
    end = int(brown.END.astype(np.int64))
    assert sorted(m.units.view(np.int64).tolist()) == sorted(u for u, k in n.items() if k >= m.least or u == end)


def test_brown_words_beyond_matrices_get_the_same_classes(spark):
    _, _, one = brown_parts(spark, 4, core=12, classes=3, dense=12)
    _, _, two = brown_parts(spark, 4, core=12, classes=3, dense=400)
    assert (one.units == two.units).all() and (one.classes == two.classes).all()


def test_brown_score_is_that_of_a_plain_class_bigram_model(docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    texts = docs.where(~held_out(5)).select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    m = brown.fitted(texts, brown.unigrams(texts))
    unit = lambda w: brown.END if w is None else brown.tokens_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]
    of_unit = dict(zip(m.units.tolist(), m.classes.tolist(), strict=True))
    class_of = {w: of_unit.get(int(unit(w)), 1) for _, t in ROWS for w in tokens(t)}
    train = [tokens(t) for i, t in ROWS if not held(i)]
    c = Counter(w for t in train for w in t)
    moves = Counter((a, b) for t in train for a, b in zip([0] + [class_of[w] for w in t], [class_of[w] for w in t]))
    k = len(m.transition)
    size, types, out = Counter(), Counter({1: 1}), Counter()
    for w, x in c.items():
        size[class_of[w]] += x
        types[class_of[w]] += 1
    for (a, _), x in moves.items():
        out[a] += x
    share = {a: (size[a] + 1) / (sum(size.values()) + k) for a in range(k)}
    emit = lambda w: np.log10((c[w] + 0.5) / (size[class_of[w]] + 0.5 * types[class_of[w]]))
    move = lambda a, b: np.log10((moves[a, b] + brown.STRENGTH * share[b]) / (out[a] + brown.STRENGTH))
    plain = lambda t: sum(emit(w) + move(a, class_of[w]) for a, w in zip([0] + [class_of[w] for w in tokens(t)], tokens(t)))
    want = sorted((str(i), len(tokens(t)), round(plain(t), 6)) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in brown.scores(docs, held_out(5)).collect()) == want


def test_brown_words_beyond_the_broadcast_have_classes(docs):
    """The same scores, whether all words are broadcast or only the first ones."""
    rows = lambda head: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in brown.scores(docs, held_out(5), head=head, core=6, classes=3, dense=8).collect())
    texts = docs.where(~held_out(5)).select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    few = brown.fitted(texts, brown.unigrams(texts), head=12, core=6, classes=3, dense=8)
    assert few.least > brown.LEAST
    whole, words = brown.beyond(texts, few)
    assert words.where("class > 1").count() > 3 and np.allclose((10**whole.transition).sum(1), 1) and whole.moves.min() >= 0
    assert rows(12) == rows(1 << 20)


def test_exchange_ends_in_a_local_optimum():
    rng = np.random.default_rng(16)
    f = lambda x: np.sum(x * np.log(np.maximum(x, 1)))

    def objective(a, own, k):
        hot = np.eye(k)[own]
        t = hot.T @ a @ hot
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    for _ in range(60):
        m, k = int(rng.integers(3, 12)), int(rng.integers(2, 4))
        a = rng.poisson(rng.gamma(0.5, 8, (m, m)))
        own = brown.exchange(a, k)
        best = objective(a, own, k)
        assert best >= objective(a, np.arange(m) % min(k, m), k) - 1e-6
        for w in range(m):
            for c in range(min(k, m)):
                other = own.copy()
                other[w] = c
                assert objective(a, other, k) <= best + 1e-6


def test_exchange_finds_two_kinds_of_words():
    a = np.zeros((8, 8))
    for i in range(8):
        for j in range(8):
            a[i, j] = 50 if i % 2 != j % 2 else 1
    own = brown.exchange(a, 2)
    assert len(set(own[::2])) == 1 and len(set(own[1::2])) == 1 and own[0] != own[1]


def test_brown_without_training(spark, none):
    assert brown.scores(none, held_out(5)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = brown.scores(one, F.lit(True)).first()
    assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == (3, 0, 0.0, 0.0)


# --- decontamination -----------------------------------------------------------------------------

ITEMS = [(0, "What does the miller keep in his barn by the river? He keeps seven sacks of old wheat there."), (1, "One two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, "Short one"), (None, "An item that has no id but many words to its name in the end.")]


def test_decontamination(spark):
    rng = random.Random(5)
    noise = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    rows = [(1, noise(200) + " " + ITEMS[0][1].upper() + " " + noise(90)), (2, noise(30) + " What does the miller keep in his barn by the river? Nobody knows. " + noise(20)), (3, ITEMS[1][1]), (4, noise(300)), (5, None), (6, ""), (7, noise(10) + " short one"), (8, noise(61) + "\n" + ITEMS[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {(1, 0), (3, 1), (7, 4), (8, None)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.hits(docs, items).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.hits(docs, items, shard_items=2).collect()} == want
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect()) == [2, 4, 5, 6]
    assert decontamination.clean(docs, items.limit(0)).count() == len(rows)


def weights_of(index):
    weight = np.zeros((len(index.term), len(index.names)))
    for t in range(len(index.term)):
        own = slice(index.begin[t], index.begin[t + 1])
        weight[t, index.items[own]] = index.weights[own]
    return weight


@pytest.mark.parametrize("longest", [40, 400])
def test_wand_equals_full_scoring(longest, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, longest if i % 5 else 12)))) for i in range(60)]
    index = decontamination.Index(items)
    weight = weights_of(index)
    assert np.allclose(weight.sum(0), 1) and (len(index.classes) > 1) == (longest > 300 or len(index.classes) > 1)
    for least, bounds in ((0.3, 1 << 20), (0.6, 7), (0.9, 50)):
        monkeypatch.setattr(decontamination, "BOUNDS", bounds)
        texts = [np.array([rng.randrange(-1, len(index.term)) for _ in range(rng.randint(0, 300))], np.int64) for _ in range(30)]
        for c, own in enumerate(index.classes):
            last = index.classes[c + 1].first if c + 1 < len(index.classes) else len(index.names)
            passages = {(t, p): terms for t, p, terms in index.candidates(c, texts, least)}
            for t, ids in enumerate(texts):
                for p in range(-(-len(ids) // own.stride)):
                    terms = sorted(set(ids[p * own.stride : (p + 2) * own.stride].tolist()) - {-1})
                    full = {i for i, s in enumerate(weight[terms].sum(0)) if s >= least and own.first <= i < last}
                    assert {i for i, _ in index.wand(c, terms, least)} == full if terms else not full
                    assert not full or passages[t, p] == terms


def test_hits_equal_plain_ones(docs, spark):
    """Also repeated documents and items, null ids, empty and very long texts, columns with clashing names."""
    rng = random.Random(20)
    items = [(k, " ".join(ROWS[k][1].split()[:30]) if ROWS[k][1] else None) for k in range(20)] + [(7, "same id, other text"), (None, "la la la end la")]
    items += [(k + 30, " ".join(rng.choice(WORDS) for _ in range(40)) + ". " + " ".join(rng.choice(WORDS) for _ in range(9))) for k in range(5)]
    extra = [(500 + k, " ".join((x if rng.random() < 0.97 else "changed") for x in items[-1 - k][1].split()) + " tail " * k) for k in range(5)]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    more = docs.select("doc_id", "text", "fp").union(spark.createDataFrame([(i, t, "x") for i, t in extra * 2], "doc_id long, text string, fp string"))
    index = decontamination.Index(items)
    weight, want = weights_of(index), Counter()
    for i, t in [*ROWS, *extra, *extra]:
        words = decontamination.words_of(t or "")
        found = set()
        for c, own in enumerate(index.classes):
            last = index.classes[c + 1].first if c + 1 < len(index.classes) else len(index.names)
            for p in range(-(-len(words) // own.stride)):
                passage = words[p * own.stride : (p + 2) * own.stride]
                score = weight[[index.term[w] for w in set(passage) if w in index.term]].sum(0)
                parts = [(k, decontamination.question_and_answer(index.texts[k])) for k in range(own.first, last) if score[k] >= 0.75 - 1e-9]
                found |= {k for k, both in parts if min(decontamination.overlap(part, passage) for part in both) >= 0.8}
        want.update((i, index.names[k], index.texts[k][:5]) for k in found)
    got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.hits(more, frame).collect())
    assert got == Counter({k[:2]: 0 for k in want}) + sum((Counter({k[:2]: n}) for k, n in want.items()), Counter()) and len(got) > 20
    clean = decontamination.clean(more, frame)
    assert clean.columns == more.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, t in [*ROWS, *extra, *extra] if not any(k[0] == i for k in want) or not hit(index, weight, t))


def hit(index, weight, text):
    """Whether a single text has a confirmed hit."""
    return bool(index.hits([text or ""])[0])


def test_an_index_of_many_items_is_small():
    rng = random.Random(21)
    words = [f"w{int(rng.paretovariate(0.6)) % 60000}" for _ in range(20_000 * 40)]
    index = decontamination.Index([(i, " ".join(words[40 * i : 40 * i + rng.randint(10, 40)])) for i in range(20_000)])
    assert len(pickle.dumps(index)) < 50_000_000


# --- sharding ------------------------------------------------------------------------------------


def test_sharding(docs, none):
    rows = sharding.shard(docs, 24).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per[s] for s in range(24)) <= 1
    for s in per:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))
    again = sharding.shard(docs.repartition(5), 24).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard(none, 24).count() == 0


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 7, 100, 1001):
        rows = spark.range(n).select(F.col("id").alias("i"), F.lit(n).cast("long").alias("n"))
        assert sorted(r["position"] for r in sharding.permuted(rows, "i", "n", 3).collect()) == list(range(n))


# --- byte-level BPE ------------------------------------------------------------------------------


def test_byte_bpe_equals_tiktoken(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = byte_bpe.Codec.of(path, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks.rank, special_tokens={})
    want = []
    for i, t in ROWS:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert collected(byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)) == sorted(want, key=str)
    back = byte_bpe.decoded(byte_bpe.encoded(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["text"])) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in ROWS)
    assert byte_bpe.round_trip(none, path, public_tokenizers.PATTERN).count() == 0
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice("abn ieotxZé\n'1!") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == own.encode_ordinary(t)


# --- SimHash -------------------------------------------------------------------------------------


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_and_components(docs, none):
    prints = {(i, t): plain_fingerprint(t, 3) for i, t in ROWS}
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for (i, _), v in prints.items():
        if i is not None:
            least[find(v)] = min(i, least.get(find(v), i))
    want = sorted(((i, f"{prints[i, t]:016x}", least.get(find(prints[i, t]))) for i, t in ROWS), key=str)
    got = simhash.components_of(docs).select("doc_id", F.lower(F.hex("fp")), "component_id")
    assert collected(got) == want
    assert simhash.components_of(none).count() == 0 and simhash.deduplicated(none).count() == 0


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(2000)], [(0, i) for i in range(1, 2000)], [(2000 - i, i) for i in range(1, 999)] + [(i, i + 1) for i in range(1, 500)]])
def test_components_of_long_chains_take_few_rounds(spark, edges):
    rounds = []
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), rounds).collect()}
    names = {v: v for e in edges for v in e}

    def find(v):
        while names[v] != v:
            v = names[v]
        return v

    for a, b in edges:
        names[find(a)] = find(b)
    assert got.keys() == names.keys() and len({(got[v], find(v)) for v in names}) == len(set(got.values())) == len({find(v) for v in names})
    assert len(rounds) <= 15


def test_attached_labels_by_both_ways(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(300)], "k string, x int")
    labels = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(300)], "k string, y int")
    assert collected(components.attached(rows, "k", labels, 10)) == collected(rows.join(labels, "k"))


@pytest.mark.parametrize("crowd", [1 << 14, 1])
def test_anchors_link_all_pairs_within_three_bits(spark, crowd, monkeypatch):
    """Also with every anchor dealt tile by tile."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "LOOK", 64 if crowd > 1 else 1)
    monkeypatch.setattr(simhash, "CROWDS", 10**6)
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = []
    for c in centres:
        for _ in range(30):
            v = c
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= np.uint64(1) << np.uint64(b)
            values.append(v)
    values = np.unique(np.array(values, np.uint64))
    nodes = spark.createDataFrame([(bytearray(int(v).to_bytes(8, "big")),) for v in values], "fp binary")
    root = {bytes(r["node"]): bytes(r["root"]) for r in components.components(simhash.links(nodes, simhash.Plan())).collect()}
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = group[i], group[j]
            if a != b:
                group = [a if g == b else g for g in group]
    name = lambda v: root.get(int(v).to_bytes(8, "big"), int(v).to_bytes(8, "big"))
    assert len({(g, name(v)) for g, v in zip(group, values, strict=True)}) == len(set(group)) == len({name(v) for v in values})


def test_large_groups_join_the_same_members():
    rng = np.random.default_rng(9)
    fps = (rng.integers(0, 4, (5000, 1)).astype(np.uint64) << np.uint64(20)) * np.uint64(0xFFFF) ^ (np.uint64(1) << rng.integers(0, 64, (5000, 1)).astype(np.uint64))
    home = np.arange(5000) < 3000
    i, j = simhash.large_group(home, fps, 3)
    assert (simhash.near(fps[i], fps[j]) <= 3).mean() > 0.2 and len(i) < 5000 * 4
    parent = np.arange(5000)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        parent[find(a)] = find(b)
    for k in range(0, 5000, 37):
        for other in np.flatnonzero((np.bitwise_count(fps[:, 0] ^ fps[k, 0]) <= 3) & (home | home[k])):
            assert find(k) == find(other)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(10)
    base = [[f"w{rng.randrange(4000)}" for _ in range(300)] for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        near = list(b)
        near[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(near)))
    rows += [(300, rows[0][1]), (0, rows[0][1])]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(20))


def test_near_copies_are_those_of_brute_force_jaccard(spark):
    rng = random.Random(12)
    line = [f"line{k}" for k in range(40)]
    rows = []
    for k in range(120):
        base = [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(60, 260))] + line
        rows.append((len(rows), " ".join(base)))
        for changes in (rng.randrange(1, 4), rng.randrange(3, 9)):  # on both sides of 0.8
            near = list(base)
            for at in rng.sample(range(len(near)), changes):
                near[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(near)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "a b", "A  b", "a " * 50, "a " * 80])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root = list(range(len(rows)))
    between = 0
    for i in range(len(rows)):
        for j in range(i):
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            between += 0.8 * every <= both <= 0.9 * every
            if 5 * both >= 4 * every and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert between > 40
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values())


def test_few_shared_shingles_propose_no_link(spark):
    """Sets of which one is larger share a passage: as far from a similarity of 0.8 as any."""
    rng, rows = random.Random(8), []
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(30):
        passage = text(24)
        rows += [(2 * k, " ".join(text(480) + passage)), (2 * k + 1, " ".join(text(410) + passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, _ = simhash.sharing(docs, spark.createDataFrame([], "node long, root long"), simhash.NEAR)
    assert found.count() == 0


def test_shared_least_is_a_bound_and_no_loose_one():
    longer, shorter = np.meshgrid(np.arange(1, 400), np.arange(1, 400))
    take = (5 * shorter >= 4 * longer) & (shorter <= longer)
    longer, shorter = longer[take], shorter[take]
    both = (4 * (longer + shorter) + 8) // 9
    exact = np.minimum(simhash.prefix_length(longer) - (longer - both), simhash.prefix_length(shorter) - (shorter - both))
    least = simhash.shared_least(shorter, longer)
    assert (least <= exact).all() and (least >= exact - 1).all() and least.min() == 1
    assert (least == simhash.shared_least(longer, shorter)).all()


def test_sketches_refuse_no_similar_sets(spark):
    rng = np.random.default_rng(4)
    every = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    words = lambda x: np.frombuffer(simhash.sketch(x), "<u8")
    for n in (0, 1, 5, 64, 65, 500, 1100):
        for _ in range(20):
            a, b = rng.choice(every, n, replace=False), rng.choice(every, int(n * rng.uniform(0.8, 1.25)), replace=False)
            b = np.unique(np.append(b, a[: rng.integers(0, n + 1)]))
            x, y = words(a), words(b)
            least = min(len(x), len(y))
            assert simhash.near(simhash.folded(x, least), simhash.folded(y, least)) <= len(np.setxor1d(a, b))
    a = rng.choice(every, 1000, replace=False)
    close, far = np.append(a[:950], np.uint64(7)), np.append(a[:700], np.setdiff1d(every, a)[:300])
    rows = [(i, len(x), simhash.sketch(x)) for i, x in enumerate((a, close, far))]
    dealt = spark.createDataFrame([(0, 9, 0, True), (0, 9, 0, False), (1, 9, 0, False), (2, 9, 0, False)], "node long, root long, tile int, held boolean")
    left = simhash.possible(dealt, spark.createDataFrame(rows, "node long, size long, sketch binary"))
    assert [tuple(r) for r in left.collect()] == [(1, 9, 0)]


def test_sifted_keeps_all_keys(spark):
    rows = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") * 7 - 9).alias("b"), F.lit("x").alias("further.one"))
    some, others = sifted(rows, ["a", "b"], rows.where("a % 10 = 0"))
    ids = {r["a"] for r in some.collect()}
    assert some.columns == others.columns == rows.columns and set(range(0, 20_000, 10)) <= ids and len(ids) < 2100
    assert sorted(r["a"] for r in others.collect()) == sorted(set(range(20_000)) - ids)


# --- toxicity ------------------------------------------------------------------------------------


def test_toxicity_learns_and_rejects(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS).strip(".,") + rng.choice("abcdefg") for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(1, None), (None, 1)]
    docs = spark.createDataFrame([*rows, (None, None), (700, ""), (701, None)], "doc_id long, text string")
    model = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(score[i] >= 0.7) == (i % 5 == 0) for i in test]) > 0.97
    assert all(0 <= s <= 1 for s in score.values()) and score[700] < 0.7
    kept = {r["doc_id"] for r in toxicity.accepted(docs, model).collect()}
    assert kept == {i for i, s in score.items() if s < 0.7}


def test_toxicity_ratios_by_hand(spark):
    """Continuation counts and the Kneser-Ney recursion from words to prefixes to shared counts, in plain Python."""
    texts = [("the bad badly badlands goes badly", 1), ("bad the bad", 1), ("the good goodness goes the goodly way", 0), ("good badlands good", 0), ("", 0)]
    counts = toxicity.continuations(spark.createDataFrame([(t.encode(), y) for t, y in texts], "text binary, toxic int"))
    n = {}
    for y in (0, 1):
        pairs = {p for t, label in texts if label == y for p in zip(["", *t.split()], t.split())}
        for _, w in pairs:
            n.setdefault(w, [0, 0])[y] += 1
    assert {(r["word"], r["toxic"]): r["n"] for r in counts.collect()} == {(w, y): k[y] for w, k in n.items() for y in (0, 1) if k[y]}
    total = [sum(k[y] for k in n.values()) for y in (0, 1)]
    cut = lambda k: {p: [sum(v[y] for w, v in n.items() if w[:k] == p) for y in (0, 1)] for p in {w[:k] for w in n}}
    for d, model in zip((0.5, 1.5), toxicity.models_of(counts, (0.5, 1.5)), strict=True):
        levels = [n, *map(cut, toxicity.PREFIXES)]
        mass = [[sum(min(v[y], d) for v in level.values()) / total[y] for y in (0, 1)] for level in levels]

        def p(level, key, y):
            own = levels[level][key]
            if level == len(levels) - 1:
                back = (sum(own) + 0.5) / (sum(total) + 0.5 * len(levels[level]))
            else:
                short = key[: toxicity.PREFIXES[level]]
                back = p(level + 1, short, y) * (sum(own) + 0.5) / (sum(levels[level + 1][short]) + 1)
            return max(own[y] - d, 0) / total[y] + mass[level][y] * back

        for level, found in enumerate([model.words, *model.prefixes]):
            above = [np.prod([mass[k][y] for k in range(level)]) for y in (0, 1)]
            want = {w: np.log(p(level, w, 1) * above[1] / (p(level, w, 0) * above[0])) for w, v in levels[level].items() if max(v) > d}
            assert found.keys() == want.keys() and all(abs(found[w] - v) < 1e-9 for w, v in want.items())
        # a word of the model, one known by its prefix, and a text as its strongest windows
        ratios = toxicity.Ratios(model)
        assert ratios["badness"] == next((m[key] for k, m in zip(toxicity.PREFIXES, model.prefixes, strict=True) if (key := "badness"[:k]) in m), model.other)
        each = [ratios[w] for w in "bad good bad unseen bad way".split()]
        x = toxicity.features_of(ratios, b"bad Good bad unseen bad way")
        assert abs(x[0] - max(sum(each[i : i + 4]) for i in range(3)) / 4) < 1e-12 and abs(x[2] - sum(each) / 6) < 1e-12


def test_toxicity_takes_one_text_of_a_doc_id(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, 5, 7)
    assert rows.count() == 12 and rows.select("doc_id").distinct().count() == 12


def test_toxicity_on_an_empty_table(spark, none):
    model = toxicity.fitted(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(none, model).count() == 0 and toxicity.accepted(none, model).count() == 0


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fitted(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.accepted(docs, model).count() == len(ROWS)


# --- Re-Pair -------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_ids", [repair.BLOCK_IDS, 150])
def test_repair_files(docs, none, block_ids):
    """Also with several blocks in a shard, and texts longer than a block."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    table = repair.save(docs, path, block_ids=block_ids)
    if block_ids == 150:
        assert table.groupBy("shard").count().where("count > 2").count() and table.where("n_tokens > 1000").count()
    rows = sorted(repair.read(table).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i for i, _ in order]
    ids = Counter((i, np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in ROWS)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == ids
    ends = np.cumsum([r["n_tokens"] for r in rows])
    assert [r["start"] for r in rows] == [0, *ends[:-1].tolist()]
    assert repair.digests(repair.read(table)).where("ids_crc32 is null").count() == 0
    assert repair.read(repair.save(none, path)).count() == 0


def test_repair_added_tokens():
    """Strings of added tokens, whole, cut, beside words and in other case, as the library takes them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words, own, rng = repair.Words.of(path), Tokenizer.from_file(path), random.Random(18)
    added = [t.content for t in own.get_added_tokens_decoder().values()]
    texts = []
    for _ in range(400):
        text = ""
        for _ in range(rng.randint(0, 6)):
            piece = rng.choice([*added, added[0][:-2], "word", "Ünï", " ", "\n", "don't", "12.", ""])
            text += rng.choice([piece, piece.upper(), piece + " "])
        texts.append(text)
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    ids, at = words.encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(19)
    lengths = np.full(200, 100)
    ids = np.concatenate([np.tile(rng.integers(2, 50, 400), 40), rng.integers(2, 9, 4000)]).astype("<u4")
    left, right, _, seq = repair.compress(ids, lengths, 50)
    assert (repair.expand(seq, left, right, 50) == ids).all() and len(left) > 0
    pairs = Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True))  # a few span two documents
    assert max(pairs.values()) < repair.LEAST + 200


def test_repair_random_access():
    rng = np.random.default_rng(12)
    lengths = rng.integers(1, 60, 300)
    ids = rng.integers(2, 9, lengths.sum()).astype("<u4")
    left, right, sizes, seq = repair.compress(ids, lengths, 10)
    assert len(seq) < 0.6 * len(ids) and (repair.expand(seq, left, right, 10) == ids).all()
    block = repair.Block(10, np.arange(300).astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), sizes.astype("<i8").tobytes(), seq.astype("<u4").tobytes())
    at = np.append(0, np.cumsum(lengths))
    for i in range(300):
        assert (block.document(i) == ids[at[i] : at[i + 1]]).all()
    assert (repair.expansion(left, right, 10) == sizes).all()


# --- repeats -------------------------------------------------------------------------------------


def plain_repeats(rows, units, window):
    """Per row: which units lie in a window that a document with a smaller id also has."""
    first = {}
    for i, t in rows:
        u = units(t)
        if i is not None:
            for k in range(len(u) - window + 1):
                key = tuple(u[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        if i is not None:
            for k in range(len(u) - window + 1):
                if first[tuple(u[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out.append((i, u, gone))
    return out


def test_substring(docs, none):
    want = [(i, len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g, strict=True) if not x)).hexdigest()) for i, u, g in plain_repeats(ROWS, lambda t: (t or "").encode().split(), 50)]
    assert collected(substring.digests(docs).drop("spans")) == sorted(want, key=str)
    spans = substring.digests(docs).select("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n"))
    assert spans.where("n <> n_removed").count() == 0
    assert substring.digests(none).count() == 0


def test_substring_small_windows(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    want = [(i, len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g, strict=True) if not x)).hexdigest()) for i, u, g in plain_repeats(rows, lambda t: t.encode().split(), 8)]
    got = substring.digests(spark.createDataFrame(rows, "doc_id long, text string"), window=8, seed=4).drop("spans")
    assert collected(got) == sorted(want, key=str)


def test_substring_stage_keeps_what_does_not_repeat(docs):
    out = substring.deduplicated(docs)
    assert out.columns == docs.columns
    whole = plain_repeats(ROWS, lambda t: (t or "").encode().split(), 50)
    want = Counter((i, t if not any(g) else b" ".join(w for w, x in zip(u, g, strict=True) if not x).decode()) for (i, u, g), (_, t) in zip(whole, ROWS, strict=True) if not g or not all(g))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


def test_suffix(docs, none):
    want = []
    for i, u, g in plain_repeats(ROWS, lambda t: (t or "").encode(), 50):
        spans = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        want.append((i, len(u), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(u, g, strict=True) if not x)).hexdigest()))
    assert collected(suffix.digests(docs)) == sorted(want, key=str)
    assert suffix.digests(none).count() == 0


def test_suffix_hot_lines(spark, monkeypatch):
    """A line that very many documents hold, each with surroundings of its own, and copies of it."""
    rng = random.Random(15)
    line = "this line of some length stands in very many of the documents, and in full"
    junk = lambda k: "".join(rng.choice("abcd ") for _ in range(k))
    rows = [(i, junk(rng.randint(0, 80)) + line[rng.randint(0, 20) : len(line) - rng.randint(0, 20)] + junk(rng.randint(0, 80))) for i in range(300)]
    rows += [(300 + i, rows[i % 4][1]) for i in range(60)] + [(7, line), (400, line * 5), (401, "x" * 500)]
    want = [(i, sum(g), hashlib.sha256(bytes(b for b, x in zip(u, g, strict=True) if not x)).hexdigest()) for i, u, g in plain_repeats(rows, str.encode, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot, small in ((1, 400), (1000, 400), (1000, 60), (1000, 10**9)):
        monkeypatch.setattr(suffix, "SAMPLE", 1)
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "SMALL", small)
        assert collected(suffix.digests(docs).select("doc_id", "n_removed", "kept_sha256")) == sorted(want, key=str)


@pytest.mark.parametrize("small", [0, 60, 10**9])
def test_suffix_parts_of_a_key(small):
    """Whatever is dealt further before it is sorted, the same bytes of the same parts are found."""
    rng = random.Random(17)
    for _ in range(20):
        keys = [bytes(rng.choice(b"abcdefgh") for _ in range(suffix.KEY)) for _ in range(2)]
        parts = {}
        for _ in range(rng.randint(1, 60)):
            k = rng.randrange(2)
            left, right = (bytes(rng.choice(b"xy") for _ in range(rng.randint(0, suffix.HALF))) for _ in range(2))
            if rng.random() < 0.7:
                left, right = b"x" * len(left) + left[-2:], right[:2] + b"y" * len(right)
            left, right = left[-suffix.HALF :], right[: suffix.HALF]
            parts.setdefault((k, left + keys[k] + right), (rng.randrange(6), len(left)))
        rows, at, joined = [], 0, b""
        for i, ((k, part), (doc, skip)) in enumerate(parts.items()):
            rows.append((k, i, doc, at, at + len(part), at + skip, at + skip + suffix.KEY))
            joined += part
            at += len(part)
        found = np.concatenate(suffix.repeated(np.frombuffer(joined, np.uint8), np.array(rows, np.int64).T, small), axis=1)
        got = {(p, s + i) for p, s, n in found.T.tolist() for i in range(n - suffix.WINDOW + 1)}
        first = {}
        windows_of = [(r, j, (r[0], joined[j : j + suffix.WINDOW])) for r in rows for j in range(r[3], r[4] - suffix.WINDOW + 1)]
        for r, _, w in windows_of:
            first[w] = min(first.get(w, 9), r[2])
        assert got == {(r[1], j) for r, j, w in windows_of if r[2] > first[w]}


def test_suffix_arrays():
    rng = random.Random(14)
    for _ in range(300):
        texts = [[rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0] for _ in range(rng.randint(0, 6))]
        begin = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        want = [int(b) + i for t, b in zip(texts, begin, strict=False) for i in sorted(range(len(t)), key=lambda i: t[i:])]
        assert suffix.suffix_arrays(np.array([x for t in texts for x in t], np.int64), begin).tolist() == want
