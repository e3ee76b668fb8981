"""Continuous rollups, scheduled queries and downsampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import HOUR, Measurement, micros
from tidewell.operators.aggregates import GROUPED, bucket

#: What a stream can keep up incrementally.
STREAM_CALLS = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
#: Windows that a stream may hold back at most.
MOST_WINDOWS = 10


def stream_rollup(stream: DataFrame, time: str, by: list[str], calls: dict[str, tuple[str, str]], window: str, delay: str) -> DataFrame:
    """Tumbling windows by tags (or by time alone); a row that is later than
    ``delay`` behind the latest one of earlier batches is dropped.

    Stored times are taken as instants whatever the session's time zone is.
    """
    if unknown := {c for c, _ in calls.values()} - set(STREAM_CALLS):
        raise ValueError(f"a stream can't keep {sorted(unknown)}")
    columns = [STREAM_CALLS[c](f).alias(name) for name, (c, f) in calls.items()]
    framed = stream.withColumn(time, F.timestamp_micros(micros(time))).withWatermark(time, delay)
    rolled = framed.groupBy(F.window(time, window).alias("_w"), *by).agg(*columns)
    return rolled.select(*by, F.unix_micros("_w.start").alias("time"), *calls)


def filtered(stream: DataFrame, condition: str) -> DataFrame:
    """A stream without windows: a filtered copy."""
    return stream.where(condition)


def start(rolled: DataFrame, sink: str, *, trigger: dict | None = None, mode: str = "update"):
    """Writes a stream to ``sink``, a folder that all executors share: each batch
    to a folder of its own, which a replay after a failure overwrites, with the
    state beside it. Rollups write the windows that changed; nothing is kept on
    the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/data/batch={number}")

    writer = rolled.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{sink}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The windows of a sink as its last batch that changed them left them."""
    rows = spark.read.option("basePath", f"{sink}/data").parquet(f"{sink}/data")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def folder(spark: SparkSession) -> str:
    """A fresh folder under the session's checkpoint folder."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewell-stream-")
    return f"{base}/{uuid.uuid4().hex}"


def replayed(spark: SparkSession, folder_: str, name: str) -> DataFrame:
    """The event rollup, run over what is there and read back."""
    schema = spark.read.parquet(f"{folder_}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder_)
    rolled = stream_rollup(stream, "ts", ["event_type"], {"n": ("count", "value"), "total": ("sum", "value")}, "1 hour", "10 minutes")
    sink = folder(spark)
    start(rolled, sink).awaitTermination()
    return current(spark, sink, ["event_type", "time"])


def downsample(m: Measurement, calls: dict[str, list[str]], every: int) -> DataFrame:
    """One row for each series and bucket, with ``<call>_<field>`` columns."""
    columns = [GROUPED[c](f).alias(f"{c}_{f}") for f, cs in calls.items() for c in cs]
    return m.frame.withColumn("_bucket", bucket(every)).groupBy(*m.tags, "_bucket").agg(*columns).withColumnRenamed("_bucket", "time")


#: How a coarser level sums up a finer one's columns.
_AGAIN = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}


def downsampled_again(level: DataFrame, tags: tuple[str, ...], every: int) -> DataFrame:
    """A coarser level of min, max, sum, count, first and last columns; means
    follow from sums and counts."""
    names = [c for c in level.columns if c not in (*tags, "time")]
    plain = [(c, c.split("_", 1)[0]) for c in names]
    columns = [_AGAIN[k](c).alias(c) for c, k in plain if k in _AGAIN]
    columns += [(F.min_by if k == "first" else F.max_by)(c, F.when(F.col(c).isNotNull(), F.col("time"))).alias(c) for c, k in plain if k in ("first", "last")]
    return level.withColumn("_bucket", bucket(every)).groupBy(*tags, "_bucket").agg(*columns).withColumnRenamed("_bucket", "time")


def write_levels(m: Measurement, calls: dict[str, list[str]], levels: list[int], path: str) -> list[str]:
    """Downsamples to each of the (growing) intervals, each level from the one
    before, and overwrites ``path``/<interval>."""
    spark, written, frame = m.frame.sparkSession, [], None
    for every in levels:
        frame = downsample(m, calls, every) if frame is None else downsampled_again(frame, m.tags, every)
        written.append(f"{path}/{every}")
        frame.write.mode("overwrite").parquet(written[-1])
        frame = spark.read.parquet(written[-1])
    return written


def run_scheduled(m: Measurement, build: Callable[[Measurement], DataFrame], now: int, span: int = HOUR) -> DataFrame:
    """A continuous query's run at ``now``: the whole stretch of ``span`` before."""
    stop = now - now % span
    return build(m.between(stop - span, stop))


def expired(frame: DataFrame, time: str, now: int, keep: int) -> DataFrame:
    """What a retention of ``keep`` leaves."""
    return frame.where(micros(time) >= now - keep)


def tiers(frame: DataFrame, time: str, now: int, hot: int, warm: int) -> DataFrame:
    """``frame`` with the tier of each row: hot, warm or cold."""
    age = F.lit(now) - micros(time)
    return frame.withColumn("tier", F.when(age < hot, "hot").when(age < warm, "warm").otherwise("cold"))
