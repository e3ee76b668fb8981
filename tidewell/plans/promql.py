"""The metrics query language: text to a tree, the tree to DataFrames on a grid.

An instant vector is a DataFrame of label columns (strings; a missing label is
the empty string), time and value, with a row for each series and grid time that
has one. A scalar is a Column over ``time``. Range selectors and subqueries are
samples that serve every grid time whose window holds them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.functions.scalar import MATH
from tidewell.model import MINUTE, SECOND, Measurement
from tidewell.operators import joins as J
from tidewell.plans.parser import duration

_TOKEN = re.compile(
    r"\s*(?:(?P<note>#[^\n]*)|(?P<duration>(?:\d+(?:ms|s|m|h|d|w|y))+\b)|(?P<number>0x[0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)"
    r"|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<name>:?[A-Za-z_][\w:]*)|(?P<op>=~|!~|==|!=|<=|>=|[-+*/%^(){}\[\],:@<>=]))"
)
_LEVELS = [("or",), ("and", "unless"), ("==", "!=", "<=", "<", ">=", ">"), ("+", "-"), ("*", "/", "%", "atan2")]
COMPARISONS = _LEVELS[2]
AGGREGATORS = ("sum", "avg", "min", "max", "count", "stddev", "stdvar", "group", "topk", "bottomk", "quantile", "count_values")
#: Functions of a range vector.
RANGE = ("rate", "increase", "delta", "irate", "idelta", "changes", "resets", "deriv", "predict_linear", "holt_winters", "absent_over_time") + tuple(f"{c}_over_time" for c in ("sum", "avg", "min", "max", "count", "stddev", "stdvar", "present", "quantile", "last", "mad"))
TIMES = {"year": F.year, "month": F.month, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "hour": F.hour, "minute": F.minute, "day_of_week": lambda t: F.dayofweek(t) - 1, "days_in_month": lambda t: F.dayofmonth(F.last_day(t))}
INSTANT = {"abs": "abs", "ceil": "ceil", "floor": "floor", "exp": "exp", "ln": "ln", "log2": "log2", "log10": "log10", "sqrt": "sqrt", "sgn": "sgn", "sin": "sin", "cos": "cos", "tan": "tan", "asin": "asin", "acos": "acos", "atan": "atan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "asinh": "asinh", "acosh": "acosh", "atanh": "atanh", "rad": "rad", "deg": "deg"}
YEAR = 365 * 86_400 * SECOND


class PromError(ValueError):
    pass


def _span(text: str) -> int:
    return duration(text.replace("y", "d")) if "y" not in text else sum(int(n) * YEAR if u == "y" else duration(n + u) for n, u in re.findall(r"(\d+)(ms|s|m|h|d|w|y)", text))


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            found = _TOKEN.match(text, at)
            if not found:
                raise PromError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            if found.lastgroup != "note":
                self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def here(self, *texts: str) -> bool:
        kind, text = self.peek()
        return kind in ("op", "name") and text in texts

    def maybe(self, *texts: str) -> bool:
        if self.here(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.maybe(text):
            raise PromError(f"expected {text}, found {self.peek()[1] or 'the end'}")

    def take(self, kind: str) -> str:
        if self.peek()[0] != kind:
            raise PromError(f"expected a {kind}, found {self.peek()[1] or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> tuple:
        out = self.level(0)
        if self.peek()[0] != "end":
            raise PromError(f"unexpected {self.peek()[1]!r}")
        return out

    def level(self, n: int) -> tuple:
        if n == len(_LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.here(*_LEVELS[n]):
            op = self.peek()[1]
            self.at += 1
            how = self.matching()
            left = ("binary", op, left, self.level(n + 1), how)
        return left

    def matching(self) -> dict:
        how: dict = {"bool": self.maybe("bool"), "on": None, "ignoring": (), "group": None, "include": ()}
        if self.here("on", "ignoring"):
            key = self.peek()[1]
            self.at += 1
            how[key] = self.names()
            if self.here("group_left", "group_right"):
                how["group"] = self.peek()[1][6:]
                self.at += 1
                if self.here("("):
                    how["include"] = self.names()
        return how

    def names(self) -> tuple[str, ...]:
        out = []
        self.need("(")
        while not self.maybe(")"):
            out.append(self.take("name"))
            self.maybe(",")
        return tuple(out)

    def unary(self) -> tuple:
        if self.maybe("-"):
            return ("neg", self.unary())
        self.maybe("+")
        base = self.postfix()
        if self.maybe("^"):
            how = self.matching()
            return ("binary", "^", base, self.unary(), how)
        return base

    def postfix(self) -> tuple:
        out = self.primary()
        while True:
            if self.maybe("["):
                span = _span(self.take("duration"))
                if self.maybe(":"):
                    step = _span(self.take("duration")) if self.peek()[0] == "duration" else None
                    out = ("subquery", out, span, step)
                else:
                    if out[0] != "selector":
                        raise PromError("a range needs a selector")
                    out = ("range", out, span)
                self.need("]")
            elif self.maybe("offset"):
                sign = -1 if self.maybe("-") else 1
                out = ("offset", out, sign * _span(self.take("duration")))
            elif self.maybe("@"):
                if self.here("start", "end"):
                    word = self.peek()[1]
                    self.at += 1
                    self.names()
                    out = ("at", out, word)
                else:
                    out = ("at", out, int(float(self.take("number")) * SECOND))
            else:
                return out

    def primary(self) -> tuple:
        kind, text = self.peek()
        if self.maybe("("):
            inner = self.level(0)
            self.need(")")
            return inner
        if kind == "number":
            self.at += 1
            return ("number", float(int(text, 16)) if text.startswith("0x") else float(text))
        if kind == "string":
            self.at += 1
            return ("string", text[1:-1] if text[0] == "`" else re.sub(r"\\(.)", r"\1", text[1:-1]))
        if self.here("{"):
            return self.selector(None)
        name = self.take("name")
        if name.lower() in ("inf", "nan"):
            return ("number", float(name.lower()))
        if name in AGGREGATORS and self.here("(", "by", "without"):
            return self.aggregator(name)
        if self.maybe("("):
            args = []
            while not self.maybe(")"):
                args.append(self.level(0))
                self.maybe(",")
            return ("call", name, args)
        return self.selector(name)

    def aggregator(self, name: str) -> tuple:
        by, labels = None, ()
        if self.here("by", "without"):
            by = self.peek()[1]
            self.at += 1
            labels = self.names()
        args = []
        self.need("(")
        while not self.maybe(")"):
            args.append(self.level(0))
            self.maybe(",")
        if by is None and self.here("by", "without"):
            by = self.peek()[1]
            self.at += 1
            labels = self.names()
        return ("aggregate", name, args, by or "by", labels)

    def selector(self, name: str | None) -> tuple:
        found = []
        if self.maybe("{"):
            while not self.maybe("}"):
                label = self.take("name")
                op = self.take("op")
                if op not in ("=", "!=", "=~", "!~"):
                    raise PromError(f"unknown matcher {op}")
                value = self.take("string")
                value = re.sub(r"\\(.)", r"\1", value[1:-1]) if op in ("=", "!=") else value[1:-1]
                if label == "__name__" and op == "=":
                    name = value
                else:
                    found.append((label, op, value))
                self.maybe(",")
        if name is None:
            raise PromError("a selector needs the name of a metric")
        return ("selector", name, tuple(found))


@dataclass
class Vector:
    labels: list[str]
    frame: DataFrame


class Evaluator:
    """Evaluates trees over ``metrics``: measurements whose tags are the labels
    and whose first field is the value, by name. Times are microseconds."""

    def __init__(self, spark: SparkSession, metrics: dict[str, Measurement], start: int, stop: int, step: int, *, lookback: int = 5 * MINUTE, anchored: bool = True):
        self.spark, self.metrics, self.start, self.stop, self.step, self.lookback, self.anchored = spark, metrics, start, stop, max(1, step), lookback, anchored

    def moved(self, start: int, stop: int, step: int | None = None) -> Evaluator:
        return Evaluator(self.spark, self.metrics, start, stop, step or self.step, lookback=self.lookback, anchored=self.anchored)

    @property
    def grid(self) -> tuple[int, int, int]:
        return self.start, self.stop, self.step

    def ticks(self) -> DataFrame:
        return self.spark.range(self.start, self.stop + 1, self.step).select(F.col("id").alias("time"))

    def run(self, text: str) -> DataFrame:
        """time and value, after the labels, on the grid."""
        found = self.of(Parser(text).parse())
        return found.frame if isinstance(found, Vector) else self.ticks().select("time", found.cast("double").alias("value"))

    def of(self, tree) -> Vector | Column:
        return getattr(self, f"_{tree[0]}")(tree)

    def vector(self, tree) -> Vector:
        out = self.of(tree)
        if not isinstance(out, Vector):
            raise PromError("a vector is needed")
        return out

    def scalar(self, tree) -> float:
        if tree[0] == "neg":
            return -self.scalar(tree[1])
        if tree[0] != "number":
            raise PromError("a number is needed")
        return tree[1]

    @staticmethod
    def text(tree) -> str:
        if tree[0] != "string":
            raise PromError("a string is needed")
        return tree[1]

    # Leaves.
    def samples(self, tree, span: int) -> Vector:
        _, name, matchers = tree
        if name not in self.metrics:
            raise PromError(f"unknown metric {name}")
        m = self.metrics[name].between(self.start - span, self.stop + 1)
        labels = list(m.tags)
        frame = m.frame.select(*(F.coalesce(F.col(t).cast("string"), F.lit("")).alias(t) for t in labels), "time", F.col(m.fields[0]).cast("double").alias("value")).where("value is not null")
        for label, op, value in matchers:
            x = F.col(label) if label in labels else F.lit("")
            met = x == value if op in ("=", "!=") else F.rlike(x, F.lit(f"^(?:{value})$" if self.anchored else value))
            frame = frame.where(met if op in ("=", "=~") else ~met)
        return Vector(labels, frame)

    def _number(self, tree):
        return F.lit(tree[1])

    def _string(self, tree):
        raise PromError("a string can't stand here")

    def _selector(self, tree):
        found = self.samples(tree, self.lookback)
        return Vector(found.labels, V.instant(found.frame, found.labels, *self.grid, self.lookback))

    def _range(self, tree):
        raise PromError("a range needs a function")

    _subquery = _range

    def _offset(self, tree):
        inner = self.moved(self.start - tree[2], self.stop - tree[2]).of(tree[1])
        return Vector(inner.labels, inner.frame.withColumn("time", F.col("time") + tree[2])) if isinstance(inner, Vector) else inner

    def _at(self, tree):
        at = {"start": self.start, "end": self.stop}.get(tree[2], tree[2])
        return self._everywhere(self.moved(at, at).of(tree[1]))

    def _everywhere(self, inner):
        if not isinstance(inner, Vector):
            return inner
        steps = F.explode(F.sequence(F.lit(self.start).cast("long"), F.lit(self.stop).cast("long"), F.lit(self.step).cast("long"))).alias("time")
        return Vector(inner.labels, inner.frame.select(*inner.labels, steps, "value"))

    def windowed(self, tree) -> tuple[Vector, int, int]:
        """The samples of a range, its span, and by how much it is shifted."""
        if tree[0] == "range":
            return self.samples(tree[1], tree[2]), tree[2], 0
        if tree[0] == "subquery":
            _, inner, span, step = tree
            step = step or self.step
            first = -(-(self.start - span) // step) * step
            found = self.moved(first, self.stop // step * step, step).of(inner)
            if not isinstance(found, Vector):
                ticks = self.moved(first, self.stop // step * step, step).ticks()
                found = Vector([], ticks.select("time", found.cast("double").alias("value")))
            return found, span, 0
        if tree[0] == "offset":
            moved = self.moved(self.start - tree[2], self.stop - tree[2])
            found, span, shift = moved.windowed(tree[1])
            return Vector(found.labels, found.frame.withColumn("time", F.col("time") + tree[2])), span, shift + tree[2]
        raise PromError("a range vector is needed")

    # Functions.
    def _call(self, tree):
        _, name, args = tree
        if name in RANGE:
            return self.ranged(name, args)
        if name in INSTANT:
            return self.mapped(args[0], MATH[INSTANT[name]])
        if name in ("clamp", "clamp_min", "clamp_max"):
            numbers = [self.scalar(a) for a in args[1:]]
            out = self.mapped(args[0], lambda v: MATH[name](v, *numbers))
            return Vector(out.labels, out.frame.where("value is not null"))
        if name == "round":
            return self.mapped(args[0], lambda v: MATH["round_to"](v, self.scalar(args[1]) if len(args) > 1 else 1.0))
        if name == "time":
            return F.col("time") / F.lit(float(SECOND))
        if name == "vector":
            return Vector([], self.ticks().select("time", self.of(args[0]).cast("double").alias("value")))
        if name in TIMES or name == "timestamp":
            return self.timed(name, args)
        if name == "scalar":
            one = self.vector(args[0]).frame.groupBy("time").agg(F.when(F.count("*") == 1, F.max("value")).otherwise(float("nan")).alias("value"))
            return Vector([], self.ticks().join(one, "time", "left").select("time", F.coalesce("value", F.lit(float("nan"))).alias("value")))
        if name == "absent":
            found = self.vector(args[0])
            return self.missing(found.frame, args[0])
        if name in ("sort", "sort_desc"):
            found = self.vector(args[0])
            by = F.col("value").desc() if name == "sort_desc" else F.col("value").asc()
            return Vector(found.labels, found.frame.orderBy("time", by, *found.labels))
        if name in ("sort_by_label", "sort_by_label_desc"):
            found, keys = self.vector(args[0]), [self.text(a) for a in args[1:]]
            order = [F.col(k).desc() if name.endswith("desc") else F.col(k).asc() for k in keys if k in found.labels]
            return Vector(found.labels, found.frame.orderBy("time", *order, *found.labels))
        if name == "label_replace":
            return self.replaced(args)
        if name == "label_join":
            found, target, between, *names = self.vector(args[0]), *(self.text(a) for a in args[1:])
            joined = F.concat_ws(between, *(F.col(n) if n in found.labels else F.lit("") for n in names))
            return self.labelled(found, target, joined)
        if name == "histogram_quantile":
            phi, found = self.scalar(args[0]), self.vector(args[1])
            if "le" not in found.labels:
                return Vector(found.labels, found.frame.limit(0))
            by = [n for n in found.labels if n != "le"]
            bounds = F.when(F.col("le").isin("+Inf", "Inf", "inf", "Infinity"), float("inf")).otherwise(F.col("le").try_cast("double"))
            return Vector(by, V.histogram_quantile(found.frame.withColumn("le", bounds).where("le is not null"), by, phi))
        raise PromError(f"unknown function {name}")

    def mapped(self, arg, f):
        found = self.of(arg)
        return Vector(found.labels, found.frame.withColumn("value", f(F.col("value")).cast("double"))) if isinstance(found, Vector) else f(found.cast("double"))

    def timed(self, name, args):
        found = self.vector(args[0]) if args else Vector([], self.ticks().withColumn("value", F.col("time") / float(SECOND)))
        if name == "timestamp":
            if args[0][0] == "selector":
                samples = self.samples(args[0], self.lookback)
                own = samples.frame.withColumn("value", F.col("time") / float(SECOND))
                return Vector(samples.labels, V.instant(own, samples.labels, *self.grid, self.lookback))
            return Vector(found.labels, found.frame.withColumn("value", F.col("time") / float(SECOND)))
        at = F.expr("timestampadd(SECOND, cast(floor(value) as long), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
        return Vector(found.labels, found.frame.withColumn("value", TIMES[name](at).cast("double")))

    def missing(self, frame: DataFrame, tree) -> Vector:
        """1 at the grid times without a row, with the labels that are fixed."""
        while tree[0] in ("offset", "at", "range", "subquery"):
            tree = tree[1]
        fixed = {label: value for label, op, value in (tree[2] if tree[0] == "selector" else ()) if op == "="}
        gone = self.ticks().join(frame.select("time").distinct(), "time", "left_anti")
        return Vector(list(fixed), gone.select(*(F.lit(v).alias(k) for k, v in fixed.items()), "time", F.lit(1.0).alias("value")))

    def ranged(self, name, args):
        numbers = {"quantile_over_time": args[:1], "predict_linear": args[1:], "holt_winters": args[1:]}.get(name, [])
        numbers = [self.scalar(a) for a in numbers]
        window = args[-1] if name == "quantile_over_time" else args[0]
        if window[0] == "at":
            at = {"start": self.start, "end": self.stop}.get(window[2], window[2])
            return self._everywhere(self.moved(at, at).ranged(name, [window[1] if a is window else a for a in args]))
        found, span, _ = self.windowed(window)
        labels, more = found.labels, (*self.grid, span)
        if name == "absent_over_time":
            return self.missing(V.over_time(found.frame, labels, *more, "present"), window)
        if name in ("rate", "increase", "delta"):
            out = V.extrapolated(found.frame, labels, *more, name)
        elif name in ("irate", "idelta"):
            out = V.last_two(found.frame, labels, *more, name == "irate")
        elif name == "predict_linear":
            out = V.predict_linear(found.frame, labels, *more, numbers[0])
        elif name == "holt_winters":
            out = V.double_smoothed(found.frame, labels, *more, *numbers)
        elif name == "quantile_over_time":
            out = V.over_time(found.frame, labels, *more, "quantile", numbers[0])
        else:
            out = V.over_time(found.frame, labels, *more, name.removesuffix("_over_time"))
        return Vector(labels, out.select(*labels, "time", "value"))

    def labelled(self, found: Vector, target: str, value: Column) -> Vector:
        labels = [*[n for n in found.labels if n != target], target]
        return Vector(labels, found.frame.select(*(F.col(n) if n != target else value.alias(target) for n in labels), "time", "value"))

    def replaced(self, args):
        found, (target, text, source, pattern) = self.vector(args[0]), (self.text(a) for a in args[1:])
        x = F.col(source) if source in found.labels else F.lit("")
        old = F.col(target) if target in found.labels else F.lit("")
        java = re.sub(r"\$\{(\w+)\}", r"$\1", text)
        return self.labelled(found, target, F.when(F.rlike(x, F.lit(f"^(?:{pattern})$")), F.regexp_replace(x, f"^(?:{pattern})$", java)).otherwise(old))

    # Aggregators.
    def _aggregate(self, tree):
        _, name, args, how, labels = tree
        found = self.vector(args[-1])
        by = [n for n in found.labels if (n in labels) == (how == "by")]
        if name in ("topk", "bottomk"):
            return Vector(found.labels, V.topk(found.frame, by, int(self.scalar(args[0])), found.labels, name == "topk"))
        if name == "count_values":
            target = self.text(args[0])
            text = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
            counted = found.frame.withColumn("_v", text).groupBy(*[b for b in by if b != target], F.col("_v").alias(target), "time").agg(F.count("*").cast("double").alias("value"))
            return Vector([*[b for b in by if b != target], target], counted)
        phi = self.scalar(args[0]) if name == "quantile" else 0.5
        return Vector(by, V.aggregated(found.frame, by, name, phi))

    # Operators.
    def _neg(self, tree):
        return self.mapped(tree[1], lambda v: -v)

    def _binary(self, tree):
        _, op, left, right, how = tree
        a, b = self.of(left), self.of(right)
        compares = op in COMPARISONS
        if isinstance(a, Vector) and isinstance(b, Vector):
            labels, frame = J.vector_matched(a.frame, a.labels, b.frame, b.labels, op, **how)
            return Vector(labels, frame)
        if op in ("and", "or", "unless"):
            raise PromError(f"{op} takes vectors")
        if not isinstance(a, Vector) and not isinstance(b, Vector):
            if compares and not how["bool"]:
                raise PromError("comparisons of scalars need bool")
            out = J.operated(a.cast("double"), b.cast("double"), op)
            return out.cast("double") if compares else out
        found, flipped = (a, False) if isinstance(a, Vector) else (b, True)
        x, y = (a.cast("double"), F.col("value")) if flipped else (F.col("value"), b.cast("double"))
        out = J.operated(x, y, op)
        if compares and not how["bool"]:
            return Vector(found.labels, found.frame.where(out))
        return Vector(found.labels, found.frame.withColumn("value", out.cast("double")))


def run_promql(spark: SparkSession, text: str, metrics: dict[str, Measurement], start: int, stop: int | None = None, step: int = MINUTE, **settings) -> DataFrame:
    """A query over a range, or at one instant."""
    return Evaluator(spark, metrics, start, start if stop is None else stop, step, **settings).run(text)
