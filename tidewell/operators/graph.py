"""Neighbourhoods in a graph of node and edge tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hops(edges: DataFrame, start: DataFrame, n: int, nodes: DataFrame | None = None) -> DataFrame:
    """node, hop: what is reached in at most ``n`` steps along edges (src, dst),
    whichever way they point. The steps are unrolled into one plan. With
    ``nodes``, only through those."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).union(edges.select(F.col("dst").alias("node"), F.col("src").alias("to"))).distinct()
    if nodes is not None:
        both = both.join(nodes.select(F.col("node").alias("to")).distinct(), "to", "left_semi").select("node", "to")
    seen = start.select("node", F.lit(0).alias("hop")).distinct()
    front = seen
    for i in range(1, n + 1):
        reached = front.join(both, "node").select(F.col("to").alias("node")).distinct()
        front = reached.join(seen, "node", "left_anti").select("node", F.lit(i).alias("hop"))
        seen = seen.union(front)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both in ``nodes``."""
    a, b = nodes.select(F.col("node").alias("src")).distinct(), nodes.select(F.col("node").alias("dst")).distinct()
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, start, n: int, node_condition: str | None = None, edge_condition: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (with hop) and edges around ``start``, through nodes and edges that
    meet the conditions (SQL over their columns)."""
    allowed = nodes.where(node_condition) if node_condition else nodes
    kept = edges.where(edge_condition) if edge_condition else edges
    first = nodes.where(F.col("node") == start).select("node")
    reached = hops(kept, first, n, allowed)
    return reached.join(nodes, "node"), induced(kept, reached)


_GRAPH = re.compile(r"\s*graph\s+(\d+)\s+'([^']*)'(?:\s+node\s+(.+?))?(?:\s+edge\s+(.+?))?\s*$", re.I | re.S)
_MATCH = re.compile(r"\s*match\s+\w+\s*=\s*\(\s*\w+\s*\{\s*uid\s*:\s*'([^']*)'\s*\}\s*\)\s*-\s*\[\s*\w*\s*\*\s*(?:\d+)?\.\.(\d+)\s*\]\s*-\s*\(\s*\)(?:\s+where\s+(.+?))?\s+return\s+\w+\s*$", re.I | re.S)
_ALL = re.compile(r"all\s*\(\s*(\w+)\s+in\s+(nodes|edges|relationships)\s*\(\s*\w+\s*\)\s+where\s+(.+?)\)\s*(?:and\s+|$)", re.I | re.S)


def run_graph(text: str, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``GRAPH hops 'start' [NODE condition] [EDGE condition]`` or ``MATCH
    p=(n{uid:'start'})-[e*..hops]-() [WHERE ALL(x IN nodes(p) WHERE ...) AND ...]
    RETURN p``: the nodes and edges that are reached."""
    if found := _GRAPH.match(text):
        return subgraph(nodes, edges, found[2], int(found[1]), found[3], found[4])
    found = _MATCH.match(text)
    if not found:
        raise ValueError("GRAPH or MATCH expected")
    conditions: dict[str, list[str]] = {"nodes": [], "edges": []}
    rest = (found[3] or "").strip()
    while rest:
        part = _ALL.match(rest)
        if not part:
            raise ValueError(f"unknown condition {rest!r}")
        kind = "nodes" if part[2].lower() == "nodes" else "edges"
        conditions[kind].append("(" + re.sub(rf"\b{part[1]}\.", "", part[3]) + ")")
        rest = rest[part.end() :].strip()
    joined = {k: " and ".join(v) or None for k, v in conditions.items()}
    return subgraph(nodes, edges, found[1], int(found[2]), joined["nodes"], joined["edges"])
