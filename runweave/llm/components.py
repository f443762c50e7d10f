"""Connected components of an edge table by randomised contraction.

In each round all nodes draw new random ranks (a hash of node and round), each points at the node
with the least rank among itself and its neighbours, pointers are followed twice, and edges become
edges between what their ends point at; loops and repeats go. Ranks fall along pointers, and what
remains after a round are nodes of least rank in their neighbourhood: at most half of the nodes on
average, a third along a chain, the hub or the leaves of a star, so rounds grow with the logarithm
of the nodes whatever their order. Each round's tables are written to the shared folder, which ends
the lineage; minima are taken before the shuffle, so a node with very many neighbours is one row
for each task.

Defined cases: loops and repeated edges count for nothing; an empty edge table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import written


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """``edges`` (a, b) -> (node, root): root is one node of the component, the same for all of its
    nodes, for every node that has an edge to another. ``rounds`` gets the edges left in each round."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total, k = None, 0
    while left := edges.count():
        if rounds is not None:
            rounds.append(left)
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("rank"), F.col(c).alias("root"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("node"), rank("b").alias("to")).union(edges.select("b", rank("a")))
        point = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("to", rank("node"))["root"].alias("root"))
        point = written(point, "pointers")
        point = written(followed(followed(point, point), point), "pointers")
        total = written(point if total is None else followed(total, point), "labels")
        ends = edges.join(point.toDF("a", "ra"), "a").join(point.toDF("b", "rb"), "b").where("ra <> rb")
        edges = written(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        k += 1
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total


def followed(labels: DataFrame, point: DataFrame) -> DataFrame:
    """Replace each root by what it points at."""
    onward = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def attached(rows: DataFrame, key: str, labels: DataFrame, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``labels`` (one row for each ``key`` there is, without nulls).

    Keys that more than a ``share``-th of the rows hold, which are fewer than ``share``, are
    broadcast, so copies, however many, stay where they are; the others meet by a shuffle."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = written(counts.where(F.col("_n") * share > rows.count()).select(key), "hot")
    some = written(labels.join(F.broadcast(hot), key, "left_semi"), "labels")
    few = rows.join(F.broadcast(some), key).select(*rows.columns, *[c for c in labels.columns if c != key])
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(labels, key).select(few.columns)
    return few.union(rest)
