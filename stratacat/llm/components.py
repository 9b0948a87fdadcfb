"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacat.llm.common import cut, gathered


def _both(a: str, b: str) -> Column:
    """Rows of (a, b): two for each row, the second with the ends of the first exchanged. No union, whose two sides would be read as two tables."""
    return F.inline(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b"))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, or to itself where it is smaller."""
    both = edges.select(_both("a", "b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and it itself, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    moved = F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b"))))
    return down.join(least, "b").select(moved).where("a <> b").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node, root of edges (a, b): each root goes to the smallest that an edge joins it to, and each node to its root's, until no edge joins two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        all_of = list(batches)
        if not sum(x.num_rows for x in all_of):
            return
        ends = [pa.chunked_array([x.column(i) for x in all_of]).combine_chunks() for i in (0, 1)]
        nodes = pc.unique(pa.concat_arrays(ends))
        nodes = nodes.take(pc.sort_indices(nodes))
        a, b = (pc.index_in(x, value_set=nodes).to_numpy() for x in ends)
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (root != root[root]).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], names=["node", "root"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, most_rounds: int = 60, alone: int = 1 << 18) -> DataFrame:
    """node, root: the smallest node that each node of an edge (a, b) reaches. Nodes are of any ordered type; loops and repeats don't matter.

    Up to `alone` edges between long, integer or string nodes are joined in one task: rounds would shuffle them many times, and each shuffle and cut leaves a few
    files for each of its partitions, however empty. For more, and other types, every step keeps the components and the number of edges at most; when a round changes
    nothing, each component is a star about its root. The rounds grow with the logarithm of the component's size. Minima are combined before the shuffle and each round is cut, so neither a hub nor a lost executor holds it up.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if now.schema["a"].dataType.simpleString() in ("bigint", "int", "string") and gathered(now).count() <= alone:
        return cut(_in_one_task(now))
    was = None
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now)))
        n, s = gathered(now).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if was == (n, s):
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        was = (n, s)
    raise RuntimeError(f"the components haven't settled in {most_rounds} rounds")
