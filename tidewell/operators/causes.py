"""Root causes: which anomalous nodes explain those that depend on them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import Measurement


def root_causes(events: DataFrame, edges: DataFrame, *, hops: int = 3, damping: float = 0.5) -> DataFrame:
    """node, own, score, explained: candidates by how much anomaly they explain.

    ``events`` has node and severity; ``edges`` has src and dst, src depending on
    dst. A node's score is its own severity, and that of the anomalous nodes
    that depend on it, damped for each step; only paths of anomalous nodes count.
    Scores travel along edges ``hops`` times, summed by node before each shuffle.
    """
    own = events.groupBy("node").agg(F.sum(F.col("severity").cast("double")).alias("own")).where("own > 0")
    live = edges.join(own.select(F.col("node").alias("src")), "src", "left_semi").join(own.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").where("src <> dst").distinct()
    total, moving = own.select("node", F.col("own").alias("part"), F.lit(0).alias("n")), own.select("node", F.col("own").alias("part"))
    for _ in range(hops):
        moving = moving.join(live, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.sum("part") * damping).alias("part"))
        total = total.unionByName(moving.select("node", "part", F.lit(1).alias("n")))
    scores = total.groupBy("node").agg(F.sum("part").alias("score"), F.sum(F.when(F.col("n") > 0, F.col("part")).otherwise(0.0)).alias("explained"))
    return own.join(scores, "node").select("node", "own", "score", "explained").orderBy(F.desc("score"), "node")


def rca(planner, *args) -> Measurement:
    """The table function ``rca(events, topology[, 'parameters as JSON'])``."""
    if len(args) < 2:
        raise ValueError("rca takes events and a topology")
    events, topology = (planner.source(("table", a, None))[0].frame for a in args[:2])
    settings = json.loads(args[2]) if len(args) > 2 else {}
    found = root_causes(events, topology, **{k: settings[k] for k in ("hops", "damping") if k in settings})
    return Measurement(found.limit(settings["top"]) if "top" in settings else found, ("node",), ("own", "score", "explained"))


def castor(planner, *args) -> Measurement:
    """The table function ``castor(measurement, field, algorithm[, task[, 'parameters as JSON']])``."""
    from tidewell.operators.forecast import detected

    if len(args) < 3:
        raise ValueError("castor takes a measurement, a field and an algorithm")
    m = planner.source(("table", args[0], None))[0]
    settings = json.loads(args[4]) if len(args) > 4 else {}
    out = detected(m.frame, m.tags, args[1], args[2], task=args[3] if len(args) > 3 else "fit_detect", **settings)
    return Measurement(out, m.tags, tuple(c for c in out.columns if c not in m.tags and c != "time"))


TABLES = {"rca": rca, "castor": castor}
