"""Connected components of a link table, by alternating stars in logarithmically many rounds.

Links are reduced inside each partition to a star for each local component first, then in turn every node's larger
neighbours are hung on its smallest one (large star) and its smaller ones too (small star), until nothing changes. Each
round is written to the shared folder. Minima are pre-aggregated before their exchange and joined from a table of their
own, so that a node with a third of all links may be split by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, materialize

EDGES_PER_TASK = 100_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one batch after another: a star around the smallest node for each component of the batch."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:  # the smaller root wins; pointers are halved until flat
            low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
        apart = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[root[apart]])], names=["u", "v"])


def _saved(df: DataFrame, edges: int, label: str) -> DataFrame:
    """Written by as many tasks as that many edges are worth, at most the partitions it has."""
    return materialize(df.coalesce(max(8, -(-edges // EDGES_PER_TASK))), label)


def _minima(edges: DataFrame, count: int, label: str) -> DataFrame:
    return _saved(edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), count, label)


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node has two larger or smaller ends: then the table is not yet one of stars."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.n", "e.up")
    roles = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return not roles.where("ups > 1 OR (ups = 1 AND low = 0)").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: a, b (long, not null). node, component (smallest node) of every node but those that are their own component."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = materialize(pairs.mapInArrow(_local_stars, "u long, v long"), "stars")
    count = edges.count()
    edges = _saved(edges.coalesce(max(8, -(-count // EDGES_PER_TASK))).mapInArrow(_local_stars, "u long, v long").distinct(), count, "stars")
    for _ in range(rounds):
        if not _unsettled(edges):
            break
        # Large star: with m the smallest of u and its neighbours, every larger neighbour goes to m.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both, count, "least")
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.least("m", "n").alias("v"))
        # Small star: every smaller neighbour of u, and u itself, goes to the smallest of them.
        down = _saved(large.where("u <> v").distinct(), count, "large")
        lowest = _minima(down, count, "lowest")
        small = down.join(lowest, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = _saved(small.where("u <> v").distinct(), count, "small")
        discard(edges, least, down, lowest)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
