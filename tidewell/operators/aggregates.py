"""Aggregates by tags and time buckets.

Those that a grouped sum can express are Columns and combine before the shuffle;
those that need order or rank within a group use one window over the group's key
and no collected lists, so that a large group spills instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.model import SECOND, Measurement


def bucket(every: int, offset: int = 0, time: str = "time") -> Column:
    """The start of the time bucket; also right for times before 1970."""
    t = F.col(time) - F.lit(offset)
    return (t - F.pmod(t, F.lit(every)) + F.lit(offset)).cast("long")


def local_bucket(every: int, zone: str, time: str = "time") -> Column:
    """The start of a bucket whose bounds are cut in local time."""
    local = f"convert_timezone('UTC', '{zone}', cast(timestamp_micros({time}) as timestamp_ntz))"
    at = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {local})"
    start = f"timestampadd(MICROSECOND, {at} - pmod({at}, {every}), TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', convert_timezone('{zone}', 'UTC', {start}))")


def first(field: str) -> Column:
    """The earliest value; of equal times the larger one."""
    known = F.col(field).isNotNull()
    return F.min_by(F.when(known, F.col(field)), F.when(known, F.struct("time", -F.col(field))))


def last(field: str) -> Column:
    known = F.col(field).isNotNull()
    return F.max_by(F.when(known, F.col(field)), F.when(known, F.struct("time", field)))


def stddev(field: str) -> Column:
    """Of a sample; 0 for a single value."""
    return F.when(F.count(field) == 1, F.lit(0.0)).otherwise(F.stddev_samp(field))


def rate(field: str, unit: int = SECOND) -> Column:
    """Change from the first to the last point, for each ``unit``."""
    known = F.col(field).isNotNull()
    at = F.when(known, F.col("time"))
    span = F.max(at) - F.min(at)
    return F.when(span > 0, (last(field) - first(field)) / (span / F.lit(float(unit))))


def spread(field: str) -> Column:
    return F.max(field) - F.min(field)


def absent(field: str) -> Column:
    return F.when(F.count(field) > 0, F.lit(1))


#: What a grouped sum can express, by name.
GROUPED = {"mean": F.avg, "count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "first": first, "last": last, "stddev": stddev, "spread": spread, "rate": rate, "absent": absent, "median": F.median, "distinct": F.count_distinct}


def aggregate(m: Measurement, calls: dict[str, tuple[str, str]], *, by: tuple[str, ...] = (), every: int | None = None, offset: int = 0) -> DataFrame:
    """``calls`` maps a name to (aggregate, field)."""
    keys = [*by, *([bucket(every, offset).alias("time")] if every else [])]
    columns = [GROUPED[call](field).alias(name) for name, (call, field) in calls.items()]
    if not every:
        return m.frame.groupBy(*keys).agg(*columns)
    framed = m.frame.withColumn("_bucket", bucket(every, offset))
    return framed.groupBy(*by, "_bucket").agg(*columns).withColumnRenamed("_bucket", "time")


def percentile_sketch(field: str, p: float, clusters: int = 1000) -> Column:
    """A percentile from a mergeable sketch: within 1/(10 ``clusters``) of its rank."""
    return F.percentile_approx(field, F.lit(p / 100.0), F.lit(int(10 * clusters)))


def histogram(field: str, bins: int = 10) -> Column:
    """Centres and heights of at most ``bins`` bins, as JSON text."""
    return F.to_json(F.histogram_numeric(F.col(field).cast("double"), F.lit(int(bins))))


#: Grouped sums with arguments of their own.
AGGREGATES = {"percentile_approx": percentile_sketch, "percentile_ogsketch": percentile_sketch, "histogram": histogram}


def _ranked(m: Measurement, by: tuple[str, ...], *order: Column) -> DataFrame:
    return m.frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def percentile(m: Measurement, field: str, p: float, by: tuple[str, ...]) -> DataFrame:
    """Nearest rank, without interpolation."""
    rows = m.where(F.col(field).isNotNull())
    counted = _ranked(rows, by, F.col(field)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    place = F.greatest(F.lit(1), F.least(F.col("_n"), F.floor(F.col("_n") * F.lit(p / 100.0) + F.lit(0.5))))
    return counted.where(F.col("_rank") == place).select(*by, F.col(field).alias("percentile"))


def mode(m: Measurement, field: str, by: tuple[str, ...]) -> DataFrame:
    """The most frequent value; of several the one seen earliest."""
    counts = m.where(F.col(field).isNotNull()).frame.groupBy(*by, field).agg(F.count("*").alias("_n"), F.min("time").alias("_t"))
    return counts.groupBy(*by).agg(F.min_by(field, F.struct(-F.col("_n"), "_t")).alias("mode"))


def top(m: Measurement, field: str, n: int, by: tuple[str, ...], largest: bool = True) -> DataFrame:
    """The ``n`` largest (or smallest) points; of equal ones the earlier."""
    value = F.col(field).desc() if largest else F.col(field).asc()
    return _ranked(m.where(F.col(field).isNotNull()), by, value, F.col("time").asc()).where(F.col("_rank") <= n).drop("_rank")


def sample(m: Measurement, field: str, n: int, by: tuple[str, ...], seed: int = 0) -> DataFrame:
    """``n`` points of each group, picked by a hash of the point."""
    order = F.xxhash64(F.lit(seed), "time", *m.tags, field)
    return _ranked(m.where(F.col(field).isNotNull()), by, order, F.col("time")).where(F.col("_rank") <= n).drop("_rank")


def irate(m: Measurement, field: str, by: tuple[str, ...], unit: int = SECOND) -> DataFrame:
    """Change between the last two points, for each ``unit``."""
    two = _ranked(m.where(F.col(field).isNotNull()), by, F.col("time").desc(), F.col(field).desc()).where("_rank <= 2")
    span = F.max("time") - F.min("time")
    change = F.max(F.when(F.col("_rank") == 1, F.col(field))) - F.max(F.when(F.col("_rank") == 2, F.col(field)))
    return two.groupBy(*by).agg(F.when(span > 0, change / (span / F.lit(float(unit)))).alias("irate"))


def integral(m: Measurement, field: str, by: tuple[str, ...], unit: int = SECOND) -> DataFrame:
    """Area under the straight lines between points."""
    series = Window.partitionBy(*by).orderBy("time")
    rows = m.where(F.col(field).isNotNull()).frame
    area = (F.col(field) + F.lag(field).over(series)) / 2 * ((F.col("time") - F.lag("time").over(series)) / F.lit(float(unit)))
    return rows.withColumn("_area", area).groupBy(*by).agg(F.sum("_area").alias("integral"))


def regr_slope(m: Measurement, field: str, by: tuple[str, ...]) -> DataFrame:
    """Least-squares slope over the points' numbers 0, 1, ...; 0 if undefined."""
    numbered = _ranked(m.where(F.col(field).isNotNull()), by, F.col("time"))
    return numbered.groupBy(*by).agg(F.coalesce(F.regr_slope(F.col(field).cast("double"), (F.col("_rank") - 1).cast("double")), F.lit(0.0)).alias("slope"))


def rmse_of_halves(m: Measurement, field: str, by: tuple[str, ...]) -> DataFrame:
    """Root mean square difference of a series' halves, over the smaller mean
    (1 at least)."""
    rows = m.where(F.col(field).isNotNull())
    numbered = _ranked(rows, by, F.col("time")).withColumn("_half", F.floor(F.count("*").over(Window.partitionBy(*by)) / 2))
    pairs = numbered.where((F.col("_half") > 0) & (F.col("_rank") <= 2 * F.col("_half"))).withColumn("_place", F.pmod(F.col("_rank") - 1, F.col("_half"))).withColumn("_second", F.col("_rank") > F.col("_half"))
    each = pairs.groupBy(*by, "_place").agg(F.max(F.when(~F.col("_second"), F.col(field))).alias("_a"), F.max(F.when(F.col("_second"), F.col(field))).alias("_b"))
    rmse = F.sqrt(F.avg((F.col("_a") - F.col("_b")) ** 2))
    return each.groupBy(*by).agg((rmse / F.greatest(F.lit(1.0), F.least(F.avg("_a"), F.avg("_b")))).alias("rmse"))


def heavy_hitters(m: Measurement, field: str, n: int, call: str = "count", by: tuple[str, ...] = (), share: float = 0.0) -> DataFrame:
    """The ``n`` combinations of ``by`` (all tags as a rule) that occur most or
    sum up to most, exactly; with ``share``, only those with that part of all."""
    keys = list(by or m.tags)
    totals = m.frame.groupBy(*keys).agg((F.count("*") if call == "count" else F.sum(field)).alias("total"))
    if share:
        whole = totals.agg((F.sum("total") * F.lit(float(share))).alias("_least"))
        totals = totals.join(F.broadcast(whole), F.col("total") >= F.col("_least")).drop("_least")
    return totals.orderBy(F.desc("total"), *keys).limit(n)


def merged_partials(parts: list[DataFrame], by: list[str], calls: dict[str, str]) -> DataFrame:
    """Partial aggregates of several runs as one: ``calls`` maps a column to
    sum, count, min or max. What an incremental query adds run by run."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    outer = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    return whole.groupBy(*by).agg(*(outer[c](n).alias(n) for n, c in calls.items()))
