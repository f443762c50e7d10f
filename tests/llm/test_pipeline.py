"""The pipeline stage by stage, with planted cases, and its registered query."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with toxic documents, near copies, repeated passages and benchmark items."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ba", "lu", "mo", "ti", "re", "sa"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, items = text(70), [(k, text(30) + ". " + text(8)) for k in range(10)]
    docs = {i: text(rng.randint(60, 200)) for i in range(500)}
    toxic = set(range(0, 500, 6))
    for i in toxic:
        for _ in range(4):
            docs[i] += " " + rng.choice(["vile", "rotten", "nasty"]) + " " + word()
    plain = [i for i in docs if i not in toxic]
    copies, leaks, repeats = plain[:10], plain[10:20], plain[20:30]
    for k, i in enumerate(copies):
        words = docs[i].split()
        words[len(words) // 2] = "other"
        docs[1000 + k] = " ".join(words) if k % 2 else docs[i]
    for k, i in enumerate(leaks):
        docs[i] += " " + items[k][1] + " " + text(20)
    for i in repeats:
        docs[i] += " " + passage + " " + text(10)
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in docs if i < 1000], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, toxic, leaks, repeats, passage


def test_stages(spark, planted):
    folder, docs, toxic, leaks, repeats, passage = planted
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = spark.read.parquet(f"{folder}/documents.parquet")

    one = stages[0](spark, rows, folder)
    kept = {r["doc_id"] for r in one.collect()}
    assert one.columns == COLUMNS and len(toxic & kept) <= 2 and len(set(docs) - toxic - kept) == 0

    two = stages[1](spark, one, folder)
    kept_two = {r["doc_id"] for r in two.collect()}
    assert two.columns == COLUMNS and not kept_two & set(range(1000, 1010)) and {i for i in kept if i < 1000} <= kept_two

    three = stages[2](spark, two, folder)
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    assert three.columns == COLUMNS and [i for i in repeats if passage in texts[i]] == [min(repeats)]
    assert all(texts[i] == docs[i] for i in texts if i not in repeats and i in docs)
    assert three.where("n_chars is not null and n_chars <> length(text)").count() == 0

    four = stages[3](spark, three, folder)
    kept_four = {r["doc_id"] for r in four.collect()}
    assert four.columns == COLUMNS and kept_four == set(texts) - set(leaks)

    five = stages[4](spark, four, folder)
    assert five.count() == len(kept_four)
    joined = five.join(four, "doc_id").where(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) != F.col("decoded_sha256"))
    assert joined.count() == 0


def test_run_is_the_stages(spark, planted):
    assert corpus_pipeline.run(spark, planted[0]).count() > 300


def test_empty_table(spark, planted, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted[0]}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_odd_rows(spark, planted):
    """Nulls in every column, empty texts, repeated rows and ids, ties, columns with clashing names."""
    rows = [(1, "", None, None, 0, 1), (1, None, "en", "s", None, 2), (2, " ", "en", None, 1, 3), (None, None, None, None, None, None), (None, "a few words", "en", "s", 11, 4), (None, "a few words", "en", "s", 11, 4), (3, "a few words", "en", "s", 11, 5), (3, "other words under the same id", "en", "s", 30, 6), (4, "w " * 30000, "en", "s", 60000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root long").withColumns({"node": F.lit("n"), "spans": F.lit(2), "_x": F.lit(None).cast("string")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, planted[0])
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "root", "node", "spans", "_x"]
    kept = sorted((r["doc_id"], r["root"]) for r in docs.collect())
    assert [k[0] for k in kept] == [1, 3, 3, 4] and kept[0][1] in (1, 2) and {k[1] for k in kept[1:3]} == {5, 6}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, planted[0]).count() == 4


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
