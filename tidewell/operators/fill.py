"""Buckets without points: null, a number, the previous value, a straight line.

The grid comes from the query's own time range; a series is a combination of
tags that has a point in it. Each bucket is carried on to the next one of its
series, so that the buckets are computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill(buckets: DataFrame, by: tuple[str, ...], value: str | list[str], start: int, stop: int, every: int, how: str | float = "null") -> DataFrame:
    """``buckets`` has the tags, time (a bucket's start) and the value columns."""
    if how == "none":
        return buckets
    values = [value] if isinstance(value, str) else list(value)
    last = start + (stop - 1 - start) // every * every
    line = Window.partitionBy(*by).orderBy("time")
    begin = F.when(F.lag("time").over(line).isNull(), F.least(F.lit(start).cast("long"), F.col("time"))).otherwise(F.col("time"))
    end = F.coalesce(F.lead("time").over(line) - every, F.greatest(F.lit(last).cast("long"), F.col("time")))
    spread = buckets.withColumn("_steps", F.sequence(begin, end, F.lit(every).cast("long")))
    rest = [c for c in buckets.columns if c not in (*by, "time")]
    rows = spread.withColumn("_t", F.explode("_steps"))
    full = rows.select(*by, F.col("_t").alias("time"), *(F.when(F.col("_t") == F.col("time"), F.col(c)).alias(c) for c in rest))
    if how == "null":
        return full
    if not isinstance(how, str):
        kinds = {f.name: f.dataType for f in full.schema}
        return full.withColumns({c: F.coalesce(c, F.lit(how).cast(kinds[c])) for c in values})
    before, after = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    if how == "previous":
        return full.withColumns({c: F.last(c, True).over(before) for c in values})
    if how != "linear":
        raise ValueError(f"unknown fill {how}")
    for c in values:
        at = F.when(F.col(c).isNotNull(), F.col("time"))
        marked = full.select("*", F.last(c, True).over(before).alias("_a"), F.last(at, True).over(before).alias("_ta"), F.first(c, True).over(after).alias("_b"), F.first(at, True).over(after).alias("_tb"))
        between = F.col("_a") + (F.col("_b") - F.col("_a")) * ((F.col("time") - F.col("_ta")) / F.nullif(F.col("_tb") - F.col("_ta"), F.lit(0)))
        full = marked.withColumn(c, F.coalesce(c, between)).drop("_a", "_ta", "_b", "_tb")
    return full
