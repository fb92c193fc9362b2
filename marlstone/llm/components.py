"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

#: A key that more than one in HOT rows hold is hot; so there are fewer than HOT such keys.
HOT = 1000
#: Edges that a task contracts at once.
CONTRACTED = 1 << 20


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with keyed, which has a key once and in column weight how many of the total rows hold it.

    Rows of hot keys stay where they are: those keys, fewer than HOT by count, are
    broadcast. The others are shuffled, so that no task gets more than its share.
    """
    values = [c for c in keyed.columns if c not in keys and c != weight]
    hot = keyed.where(F.col(weight) * HOT > total).drop(weight).withColumn("__hot", F.lit(True))
    first = rows.join(F.broadcast(hot), keys, "left")
    rest = first.where("__hot is null").drop("__hot", *values).join(keyed.where(F.col(weight) * HOT <= total).drop(weight), keys, how)
    return first.where("__hot").drop("__hot").unionByName(rest)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of edges in memory, for all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[some], nodes[label[some]]


def contracted(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (u, v) with u > v that connect the same nodes: each task's chunks as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held, size = [], 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
            size += batch.num_rows
            if size >= CONTRACTED:
                yield star()
                held, size = [], 0
        if held:
            yield star()

    return edges.where("a <> b").select("a", "b").mapInArrow(tidy(run), "u long, v long")


def state(pairs: DataFrame) -> tuple[int, bool]:
    """(edges, whether each component of pairs (u > v) is a star around its smallest node)."""
    ends = pairs.selectExpr("u AS n", "1 AS up", "0 AS down").unionByName(pairs.selectExpr("v AS n", "0 AS up", "1 AS down"))
    by = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    edges, bad = by.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 or (up > 0 and down > 0)"))).first()
    return edges, bad == 0


def components(edges: DataFrame, most_rounds: int = 60, contract: bool = True) -> DataFrame:
    """edges(a long, b long) -> (node, component): each node of an edge with the smallest node that it can reach.

    Each task first contracts its own edges (unless they are stars with a over b). Stars are minima and joins, so no
    node's neighbours are ever collected, and a node with very many neighbours is
    joined by broadcast. Each round is written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. Rounds beyond most_rounds
    are an error, not a result.
    """
    pairs = contracted(edges) if contract else edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = materialise(pairs.distinct(), "edges")
    for _ in range(most_rounds):
        count, done = state(pairs)
        if done:
            roots = pairs.selectExpr("v AS node", "v AS component").distinct()
            return pairs.selectExpr("u AS node", "v AS component").unionByName(roots)
        both = pairs.unionByName(pairs.selectExpr("v AS u", "u AS v"))
        # large star: neighbours above a node link to the smallest of its neighbourhood
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, least, ["u"], "n", 2 * count, "inner").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        # small star: a node and its neighbours below link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v AS a", "m AS b").unionByName(least.selectExpr("u AS a", "m AS b"))
        pairs = materialise(contracted(small).distinct(), "edges")
    raise RuntimeError(f"components: not done after {most_rounds} rounds")
