"""Circular fences: which points lie in which of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6_371_000.0
#: Pairs of a point and a fence that one task measures, pairs of a cell that stay
#: together, and rows of either side in a task.
TASK_PAIRS, CELL_PAIRS, TASK_ROWS = 8_000_000, 2_000_000, 1_000_000


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _on_sphere(lat: str, lon: str, name: str) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(b)).alias(f"{name}x"), (F.cos(a) * F.sin(b)).alias(f"{name}y"), F.sin(a).alias(f"{name}z")]


def _within() -> Column:
    """Whether a fence holds a point: by the chord, and only where rounding might
    tell otherwise by the distance itself."""
    square = lambda n: (F.col(f"_p{n}") - F.col(f"_f{n}")) * (F.col(f"_p{n}") - F.col(f"_f{n}"))
    chord = (square("x") + square("y") + square("z")) * F.lit(0.25)
    return (chord < F.col("_surely")) | ((chord <= F.col("_hardly")) & (distance(F.col("lat"), F.col("lon"), F.col("_flat"), F.col("_flon")) <= F.col("radius")))


def in_fences(points: DataFrame, fences: DataFrame, cell: float = 0.1) -> DataFrame:
    """``points`` (lat, lon) with the fence_id of each fence (fence_id, lat, lon,
    radius in metres) that holds them.

    Both sides are laid on a grid of ``cell`` degrees: a fence goes to the cells
    that its box touches, a point to its own, and only those that meet there are
    measured. Choose the cell about as wide as a usual fence. The pairs to measure
    are counted first (a small job), as their number, not the size of the sides,
    says into how many tasks they go; the points of a full cell are dealt out.
    """
    turn, degree = int(math.ceil(360 / cell)), math.pi * RADIUS / 180
    column = lambda x: F.pmod(F.floor(x / cell), F.lit(turn))
    up = F.col("radius") / degree
    # The farthest meridian that a circle reaches; all of them near a pole.
    polar = F.abs("lat") + up >= 89.9
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.col("radius") / RADIUS) / F.cos(F.radians("lat"))))))
    rows = F.sequence(F.floor((F.col("lat") - up) / cell), F.floor((F.col("lat") + up) / cell))
    low, high = F.floor((F.col("lon") - wide) / cell), F.least(F.floor((F.col("lon") + wide) / cell), F.floor((F.col("lon") - wide) / cell) + turn - 1)
    # Half the chord of the radius, squared, less and more than any rounding.
    half = F.pow(F.sin(F.least(F.lit(math.pi / 2), F.col("radius") / (2 * RADIUS))), 2)
    slack = half * 1e-9 + 1e-13
    surely, hardly = (F.when(F.col("radius") < 0, -1.0).otherwise(x) for x in (half - slack, half + slack))
    laid = fences.select("fence_id", F.col("lat").alias("_flat"), F.col("lon").alias("_flon"), "radius", *_on_sphere("lat", "lon", "_f"), surely.alias("_surely"), hardly.alias("_hardly"), F.explode(rows).alias("_row"), low.alias("_low"), high.alias("_high"))
    laid = laid.withColumn("_column", F.explode(F.sequence("_low", "_high"))).withColumn("_at", F.col("_row") * turn + F.pmod("_column", F.lit(turn))).drop("_row", "_column", "_low", "_high")
    placed = points.select("*", *_on_sphere("lat", "lon", "_p"), (F.floor(F.col("lat") / cell) * turn + column(F.col("lon"))).alias("_at"))

    counts = placed.groupBy("_at").agg(F.count("*").alias("_points")).join(laid.groupBy("_at").agg(F.count("*").alias("_fences")), "_at")
    pairs = F.col("_points").cast("double") * F.col("_fences")
    n_pairs, fullest, n_points, n_laid = counts.agg(F.sum(pairs), F.max(pairs), F.sum("_points"), F.sum("_fences")).first()
    on, copies = ["_at"], n_laid or 0
    if (fullest or 0) > CELL_PAIRS:
        # Of a full cell's points each part meets all of its fences.
        parts = counts.select("_at", F.least(F.ceil(pairs / CELL_PAIRS), F.col("_points")).alias("_parts")).where("_parts > 1")
        part = F.coalesce("_parts", F.lit(1))
        placed = placed.withColumn("_part", F.monotonically_increasing_id()).join(parts, "_at", "left").withColumn("_part", F.pmod("_part", part)).drop("_parts")
        laid = laid.join(parts, "_at", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), part - 1))).drop("_parts")
        on, copies = ["_at", "_part"], copies + counts.select(F.sum(F.col("_fences") * F.least(F.ceil(pairs / CELL_PAIRS), F.col("_points")))).first()[0]
    tasks = max(1, math.ceil((n_pairs or 0) / TASK_PAIRS), math.ceil(max(n_points or 0, copies) / TASK_ROWS))
    met = placed.repartition(tasks, *on).join(laid.repartition(tasks, *on).hint("shuffle_hash"), on).where(_within())
    return met.select(*points.columns, "fence_id")
