"""Connected components over an edge table, without collecting any of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, tidied

#: Edges that one task may finish; they are counted. Beyond, rounds of contraction go on.
FEW = 1 << 15


def _finished(edges: DataFrame) -> DataFrame:
    """node, to: the components of at most ``FEW`` edges, in one task."""

    def run(batches):
        tables = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        nodes, at = np.unique(np.concatenate([x for t in tables for x in t] or [np.empty(0, np.int64)]), return_inverse=True)
        half = [len(a) for a, _ in tables for _ in range(2)]
        parts = np.split(at, np.cumsum(half)[:-1]) if half else []
        parent = list(range(len(nodes)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a, b in zip(parts[::2], parts[1::2]):
            for i, j in zip(a.tolist(), b.tolist()):
                i, j = root(i), root(j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
        to = nodes[[root(i) for i in range(len(nodes))]] if len(nodes) else nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(to, pa.int64())], ["node", "to"])

    return edges.repartition(1).mapInArrow(tidied(run), "node long, to long")


def component_roots(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every end of an edge; nodes joined by edges share a root.

    Each round, every node points to the neighbour (or itself) that comes first
    in a pseudo-random order, and the edges are contracted along the pointers.
    That keeps a constant share of the nodes at most, so the rounds grow with
    the logarithm of the nodes, whatever the shape of a component. The order is
    reshuffled each round. Neighbourhoods are only ever reduced to a minimum,
    so a node with very many edges is summed before the shuffle. Once no more
    than ``FEW`` edges are left, one task finishes them. Joins are by sorting,
    so that nothing passes through the driver.
    """
    edges = cut(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct())
    left, roots, turn = edges.count(), None, 0
    if not left:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    while True:
        if left <= FEW:
            to = cut(_finished(edges))
        else:
            order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
            both = edges.select("a", order("b").alias("o")).union(edges.select(F.col("b").alias("a"), order("a").alias("o")))
            best = both.groupBy("a").agg(F.min("o").alias("o"))
            to = cut(best.select(F.col("a").alias("node"), F.least(order("a"), F.col("o"))["n"].alias("to")))
        if roots is None:
            roots = to.select("node", F.col("to").alias("root"))
        else:
            step = to.select(F.col("node").alias("root"), "to")
            roots = roots.join(step.hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if left <= FEW:
            return cut(roots)
        ta, tb = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = cut(edges.join(ta.hint("merge"), "a").join(tb.hint("merge"), "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        left, turn = edges.count(), turn + 1
        if not left:
            return cut(roots)
        if turn % 4 == 0:
            roots = cut(roots)
