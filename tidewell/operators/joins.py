"""Joins by tags and time, membership, as-of joins, vector matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def time_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on tags and, if named, time; the keys come out once."""
    return left.join(right, on, {"outer": "full"}.get(how, how))


def contained(df: DataFrame, column: str, values: DataFrame, negated: bool = False) -> DataFrame:
    """IN or NOT IN a subquery's first column; its nulls are ignored."""
    name = values.columns[0]
    inner = values.select(F.col(name).alias("_in")).where("_in is not null").distinct()
    return df.join(inner, F.col(column) == F.col("_in"), "left_anti" if negated else "left_semi")


def as_of(grid: DataFrame, samples: DataFrame, by: list[str], lookback: int) -> DataFrame:
    """For each row of ``grid`` (tags, time) the last sample within ``lookback``.

    Both sides are laid into one ordered series, so that there is one shuffle
    and no pairing of samples with rows.
    """
    asked = grid.select(*by, "time", F.lit(1).alias("_ask"), F.lit(None).cast("double").alias("_v"), F.lit(None).cast("long").alias("_t"))
    known = samples.select(*by, "time", F.lit(0).alias("_ask"), F.col("value").cast("double").alias("_v"), F.col("time").alias("_t"))
    line = Window.partitionBy(*by).orderBy("time", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(known).select(*by, "time", "_ask", F.last("_v", True).over(line).alias("value"), F.last("_t", True).over(line).alias("_t"))
    return both.where((F.col("_ask") == 1) & (F.col("_t") >= F.col("time") - lookback)).select(*by, "time", "value")


def operated(a: Column, b: Column, op: str) -> Column:
    """Arithmetic of doubles, or whether a comparison holds."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    arithmetic = {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0))), "%": F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.nullif(b, F.lit(0.0))), "^": F.pow(a, b), "atan2": F.atan2(a, b)}
    if op in arithmetic:
        return arithmetic[op]
    return {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def _one(frame: DataFrame, keys: list[str], values: list[str], side: str) -> DataFrame:
    """One row for each of the keys; more than one is an error."""
    error = F.raise_error(F.lit(f"many-to-many matching: several series on the {side} side have the same labels"))
    grouped = frame.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*values)).alias("_p"))
    return grouped.select(*keys, F.when(F.col("_n") > 1, error.cast(grouped.schema["_p"].dataType)).otherwise(F.col("_p")).alias("_p"))


def vector_matched(left: DataFrame, left_labels: list[str], right: DataFrame, right_labels: list[str], op: str, *, on: tuple[str, ...] | None = None, ignoring: tuple[str, ...] = (), group: str | None = None, include: tuple[str, ...] = (), bool: bool = False) -> tuple[list[str], DataFrame]:
    """Labels and rows of a binary operator on two vectors.

    Series match if they agree in the labels ``on``, or in all but ``ignoring``;
    a label that a side lacks is empty there. Without ``group`` each side has one
    series for a match, with left (right) only the right (left) side; then the
    labels of the other side stay and ``include`` is taken over. Comparisons
    filter by the left value, or give 0 and 1 with ``bool``.
    """
    every = [*dict.fromkeys([*left_labels, *right_labels])]
    match = list(on) if on is not None else [n for n in every if n not in ignoring]
    full = lambda frame, own: frame.select(*own, *(F.lit("").alias(n) for n in match if n not in own), "time", "value")
    a, b, keys = full(left, left_labels), full(right, right_labels), [*match, "time"]
    if op in ("and", "unless"):
        kept = a.join(b.select(*keys).distinct(), keys, "left_semi" if op == "and" else "left_anti")
        return left_labels, kept.select(*left_labels, "time", "value")
    if op == "or":
        rest = b.join(a.select(*keys).distinct(), keys, "left_anti")
        fill_in = lambda frame, own: frame.select(*(F.col(n) if n in own else F.lit("").alias(n) for n in every), "time", "value")
        return every, fill_in(a, left_labels).unionByName(fill_in(rest, right_labels))
    many, one, many_labels, one_labels = (b, a, right_labels, left_labels) if group == "right" else (a, b, left_labels, right_labels)
    taken = [n for n in include if n in one_labels]
    unique = _one(one, keys, ["value", *(n for n in taken if n not in match)], "left" if group == "right" else "right")
    unique = unique.select(*keys, F.col("_p.value").alias("_one"), *(F.col(f"_p.{n}").alias(f"_{n}") if n not in match else F.col(n).alias(f"_{n}") for n in taken))
    if group is None:
        rest = [n for n in many_labels if n not in match]
        single = _one(many, keys, ["value", *rest], "left")
        many = single.select(*keys, F.col("_p.value").alias("value"))
        labels = match if on is None else [n for n in match if n in every]
        many_labels = labels
    else:
        labels = [*[n for n in many_labels if n not in include], *include]
    joined = many.join(unique, keys)
    x, y = (F.col("_one"), F.col("value")) if group == "right" else (F.col("value"), F.col("_one"))
    out = operated(x.cast("double"), y.cast("double"), op)
    shown = [F.col(f"_{n}").alias(n) if n in taken else F.lit("").alias(n) if n in include and group else F.col(n) for n in labels]
    if op in ("==", "!=", ">", "<", ">=", "<="):
        if not bool:
            return labels, joined.where(out).select(*shown, "time", x.alias("value"))
        return labels, joined.select(*shown, "time", out.cast("double").alias("value"))
    return labels, joined.select(*shown, "time", out.alias("value"))


def matched(left: DataFrame, right: DataFrame, labels: list[str], op: str) -> DataFrame:
    """``vector_matched`` of two vectors with the same labels, one to one."""
    return vector_matched(left, labels, right, labels, op)[1]
