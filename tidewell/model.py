"""Measurements: a table with a time, tags (dimensions) and fields (values).

Times are handled as microseconds since 1970 (``time`` below), which neither the
session's time zone nor the type of the stored timestamp changes.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND
_EPOCH = datetime.datetime(1970, 1, 1)


def micros(column: str) -> Column:
    """A timestamp as microseconds since 1970, as it is written."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def _stored(kind: str, micros: int) -> Column | None:
    """An instant as a literal of a stored time's type, that a scan can compare."""
    try:
        at = _EPOCH + datetime.timedelta(microseconds=micros)
    except OverflowError:
        return None
    text = {"date": f"DATE'{at:%Y-%m-%d}'", "timestamp_ntz": f"TIMESTAMP_NTZ'{at.isoformat(' ')}'", "timestamp": f"cast(TIMESTAMP_NTZ'{at.isoformat(' ')}' as timestamp)"}.get(kind)
    return F.expr(text) if text and 1 <= at.year <= 9999 else None


@dataclass(frozen=True)
class Measurement:
    frame: DataFrame
    tags: tuple[str, ...]
    fields: tuple[str, ...]
    #: The stored table and its time column, while nothing but times was filtered.
    base: DataFrame | None = None
    stored: str = ""

    def where(self, condition: Column | str) -> Measurement:
        return replace(self, frame=self.frame.where(condition), base=None)

    def between(self, start: int | None, stop: int | None) -> Measurement:
        """Points from ``start`` up to ``stop`` (exclusive); None: no bound.

        The stored time is compared with literals as well, so that the range
        reaches the scan and prunes row groups.
        """
        out = self
        if self.base is not None:
            kind = self.base.schema[self.stored].dataType.simpleString()
            low = _stored(kind, start) if start is not None else None
            high = _stored(kind, stop - (kind == "date")) if stop is not None else None
            base = self.base
            if low is not None:
                base = base.where(F.col(self.stored) >= low)
            if high is not None:
                base = base.where(F.col(self.stored) <= high if kind == "date" else F.col(self.stored) < high)
            out = replace(self, frame=_projected(base, self.stored, self.tags, self.fields), base=base)
        frame = out.frame
        if start is not None:
            frame = frame.where(F.col("time") >= start)
        if stop is not None:
            frame = frame.where(F.col("time") < stop)
        return replace(out, frame=frame)


def _projected(frame: DataFrame, time: str, tags, fields) -> DataFrame:
    return frame.select(micros(time).alias("time"), *tags, *fields)


def measurement(frame: DataFrame, time: str, tags: list[str], fields: list[str]) -> Measurement:
    return Measurement(_projected(frame, time, tags, fields), tuple(tags), tuple(fields), frame, time)


def events(spark: SparkSession, sf_dir: str) -> Measurement:
    return measurement(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type", "user_id"], ["value"])


def sales(spark: SparkSession, sf_dir: str) -> Measurement:
    return measurement(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def orders(spark: SparkSession, sf_dir: str) -> Measurement:
    return measurement(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", ["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"])
