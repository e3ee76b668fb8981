"""Range and instant functions over a grid of evaluation times.

Samples are (labels, time, value). Each sample goes to the evaluation times
whose window holds it (closed at both ends), at most range/step + 1 of them;
then one grouped aggregation by labels and evaluation time. No join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(samples: DataFrame, labels: list[str], start: int, stop: int, step: int, span: int) -> DataFrame:
    """labels, at (evaluation time), time, value for every sample in a window."""
    near = samples.where((F.col("time") >= start - span) & (F.col("time") <= stop))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("time") - F.lit(start)) / F.lit(step)))
    last = F.least(F.lit((stop - start) // step).cast("long"), F.floor((F.col("time") + F.lit(span - start)) / F.lit(step)))
    spread = near.select(*labels, "time", "value", first.alias("_a"), last.alias("_b")).where("_a <= _b")
    steps = F.transform(F.sequence("_a", "_b"), lambda i: i * F.lit(step) + F.lit(start))
    return spread.select(*labels, F.explode(steps).alias("at"), "time", "value")


def _increments(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Adds what a counter gained since the sample before in its window: after
    a reset, its whole value."""
    line = Window.partitionBy(*labels, "at").orderBy("time")
    before = F.lag("value").over(line)
    return rows.select("*", before.alias("_before"), F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before).alias("_gain"), F.row_number().over(Window.partitionBy(*labels, "at").orderBy(F.desc("time"))).alias("_nth"))


def extrapolated(samples: DataFrame, labels: list[str], start: int, stop: int, step: int, span: int, kind: str = "rate") -> DataFrame:
    """rate, increase (counters) or delta (gauges), carried on to the window's
    edges: wholly if they are within 1.1 mean gaps of a sample, else by half a
    gap; a counter not past zero."""
    rows = _increments(windows(samples, labels, start, stop, step, span), labels)
    counter = kind != "delta"
    grouped = rows.groupBy(*labels, "at").agg(F.count("*").alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1"), F.min_by("value", "time").alias("v0"), F.max_by("value", "time").alias("v1"), F.sum("_gain").alias("gain")).where("n >= 2 and t1 > t0")
    gain = F.col("gain") if counter else F.col("v1") - F.col("v0")
    sampled, n = (F.col("t1") - F.col("t0")).cast("double"), F.col("n")
    gap = sampled / (n - 1)
    to_start, to_end = F.col("t0") - (F.col("at") - span), F.col("at") - F.col("t1")
    if counter:
        zero = F.when((gain > 0) & (F.col("v0") >= 0), sampled * (F.col("v0") / F.nullif(gain, F.lit(0.0))))
        to_start = F.when(zero < to_start, zero).otherwise(to_start)
    reach = lambda d: F.when(d < gap * 1.1, d).otherwise(gap / 2)
    value = gain * ((sampled + reach(to_start) + reach(to_end)) / sampled)
    return grouped.select(*labels, F.col("at").alias("time"), (value / F.lit(span / 1e6) if kind == "rate" else value).alias("value"))


def last_two(samples: DataFrame, labels: list[str], start: int, stop: int, step: int, span: int, per_second: bool) -> DataFrame:
    """irate (per second, of a counter) or idelta (of a gauge)."""
    two = _increments(windows(samples, labels, start, stop, step, span), labels).where("_nth <= 2")
    pick = lambda c, k: F.max(F.when(F.col("_nth") == k, F.col(c)))
    grouped = two.groupBy(*labels, "at").agg(pick("value", 1).alias("b"), pick("value", 2).alias("a"), pick("time", 1).alias("tb"), pick("time", 2).alias("ta")).where("ta < tb")
    gain = F.col("b") - F.col("a")
    if per_second:
        gain = F.when(gain < 0, F.col("b")).otherwise(gain) / ((F.col("tb") - F.col("ta")) / F.lit(1e6))
    return grouped.select(*labels, F.col("at").alias("time"), gain.alias("value"))


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


OVER_TIME = {
    "sum": F.sum, "avg": F.avg, "count": lambda v: F.count(v).cast("double"), "min": lambda v: F.coalesce(F.min(_finite(v)), F.min(v)), "max": lambda v: F.coalesce(F.max(_finite(v)), F.max(v)),
    "stddev": F.stddev_pop, "stdvar": F.var_pop, "present": lambda v: F.lit(1.0),
}


def quantile(v: Column, phi: float) -> Column:
    """Interpolated; beyond 0 and 1 it is infinite."""
    if phi != phi:
        return F.max(F.lit(float("nan")))
    return F.percentile(v, F.lit(phi)) if 0 <= phi <= 1 else F.max(F.lit(float("-inf") if phi < 0 else float("inf")))


def over_time(samples: DataFrame, labels: list[str], start: int, stop: int, step: int, span: int, call: str, phi: float = 0.5) -> DataFrame:
    rows = windows(samples, labels, start, stop, step, span)
    v = F.col("value")
    if call in ("changes", "resets"):
        rows = _increments(rows, labels)
        met = (F.col("value") != F.col("_before")) if call == "changes" else (F.col("value") < F.col("_before"))
        out = F.sum(F.when(met, 1.0).otherwise(0.0))
    elif call == "quantile":
        out = quantile(v, phi)
    elif call == "mad":
        middle = F.percentile(v, F.lit(0.5)).over(Window.partitionBy(*labels, "at"))
        rows, out = rows.withColumn("_away", F.abs(v - middle)), F.percentile(F.col("_away"), F.lit(0.5))
    elif call == "last":
        out = F.max_by(v, F.col("time"))
    elif call == "deriv":
        out = F.regr_slope(v, (F.col("time") - F.col("at")) / F.lit(1e6))
    else:
        out = OVER_TIME[call](v)
    return rows.groupBy(*labels, "at").agg(out.alias("value")).withColumnRenamed("at", "time").where("value is not null")


def predict_linear(samples: DataFrame, labels: list[str], start: int, stop: int, step: int, span: int, ahead: float) -> DataFrame:
    rows = windows(samples, labels, start, stop, step, span)
    x = (F.col("time") - F.col("at")) / F.lit(1e6)
    grouped = rows.groupBy(*labels, "at").agg((F.regr_intercept(F.col("value"), x) + F.regr_slope(F.col("value"), x) * F.lit(float(ahead))).alias("value"))
    return grouped.withColumnRenamed("at", "time").where("value is not null")


def double_smoothed(samples: DataFrame, labels: list[str], start: int, stop: int, step: int, span: int, smoothing: float, trend: float) -> DataFrame:
    """Double exponential smoothing over the samples of a window, two at least."""
    if not (0 < smoothing < 1 and 0 < trend < 1):
        raise ValueError("smoothing and trend factors lie between 0 and 1")
    rows = windows(samples, labels, start, stop, step, span).groupBy(*labels, "at").agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("s")).where(F.size("s") >= 2)
    first, second = F.get("s", 0)["value"], F.get("s", 1)["value"]
    zero = F.struct(F.lit(0.0).alias("before"), first.alias("level"), (second - first).alias("trend"), F.lit(0).alias("i"))

    def move(state, x):
        slope = F.when(state["i"] == 0, state["trend"]).otherwise(trend * (state["level"] - state["before"]) + (1 - trend) * state["trend"])
        return F.struct(state["level"].alias("before"), (smoothing * x["value"] + (1 - smoothing) * (state["level"] + slope)).alias("level"), slope.alias("trend"), (state["i"] + 1).alias("i"))

    out = F.aggregate(F.slice("s", 2, F.size("s")), zero, move, lambda state: state["level"])
    return rows.select(*labels, F.col("at").alias("time"), out.alias("value"))


def instant(samples: DataFrame, labels: list[str], start: int, stop: int, step: int, lookback: int = 300_000_000) -> DataFrame:
    """The last sample within ``lookback`` at each evaluation time."""
    return over_time(samples, labels, start, stop, step, lookback, "last")


AGGREGATORS = {"sum": F.sum, "avg": F.avg, "count": lambda v: F.count(v).cast("double"), "min": OVER_TIME["min"], "max": OVER_TIME["max"], "stddev": F.stddev_pop, "stdvar": F.var_pop, "group": lambda v: F.max(F.lit(1.0))}


def aggregated(vector: DataFrame, by: list[str], call: str, phi: float = 0.5) -> DataFrame:
    out = quantile(F.col("value"), phi) if call == "quantile" else AGGREGATORS[call](F.col("value"))
    return vector.groupBy(*by, "time").agg(out.alias("value"))


def topk(vector: DataFrame, by: list[str], k: int, labels: list[str], largest: bool = True) -> DataFrame:
    order = F.col("value").desc() if largest else F.col("value").asc()
    ranked = vector.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "time").orderBy(order, *labels)))
    return ranked.where(F.col("_r") <= k).drop("_r")


def histogram_quantile(buckets: DataFrame, by: list[str], phi: float) -> DataFrame:
    """From cumulative counts by upper bound ``le`` (a double, +Infinity last).

    Bounds belong to one histogram, so their window is small; counts are first
    made to rise. Beyond 0 and 1 the result is infinite."""
    line = Window.partitionBy(*by, "time").orderBy("le")
    if not 0 <= phi <= 1:
        beyond = float("nan") if phi != phi else float("-inf") if phi < 0 else float("inf")
        return buckets.groupBy(*by, "time").agg(F.max("le").alias("_top"), F.max("value").alias("_n")).where((F.col("_top") == float("inf")) & (F.col("_n") > 0)).select(*by, "time", F.lit(beyond).alias("value"))
    up = buckets.withColumn("c", F.max("value").over(line))
    rows = up.select("*", F.lag("c").over(line).alias("c0"), F.lag("le").over(line).alias("le0"), F.max("c").over(Window.partitionBy(*by, "time")).alias("n"), F.max("le").over(Window.partitionBy(*by, "time")).alias("top"))
    hit = rows.where((F.col("top") == float("inf")) & (F.col("n") > 0) & (F.col("c") >= F.col("n") * phi) & (F.coalesce("c0", F.lit(-1.0)) < F.col("n") * phi))
    low, base = F.coalesce("le0", F.when(F.col("le") <= 0, F.col("le")).otherwise(0.0)), F.coalesce("c0", F.lit(0.0))
    inside = low + (F.col("le") - low) * ((F.lit(phi) * F.col("n") - base) / F.nullif(F.col("c") - base, F.lit(0.0)))
    return hit.select(*by, "time", F.when(F.col("le") == float("inf"), F.col("le0")).otherwise(F.coalesce(inside, low)).alias("value"))
