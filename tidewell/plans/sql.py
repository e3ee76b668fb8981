"""The query language: trees to DataFrames; Catalyst does the rest.

    [WITH name AS (query), ...]
    SELECT expression [AS name], ... [INTO measurement]
    FROM measurement | /pattern/ | (query) | function(...) [AS alias] [JOIN ... ON ...], ...
    [WHERE condition] [GROUP BY time(1h[, offset]), tag, *, /pattern/ [EXCEPT tag, ...]]
    [fill(null|none|previous|linear|n)] [ORDER BY column [DESC]] [LIMIT n] [OFFSET n]
    [SLIMIT n] [SOFFSET n] [tz('Area/City')] [UNION [ALL] [BY NAME] query]

A query's result is a measurement again (its GROUP BY tags are tags, its other
columns fields), so that queries nest. Times are microseconds; ``now()`` is
handed in, so that a query can be repeated.
"""

from __future__ import annotations

import datetime
import re
import time as clock
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import CASTS, FUNCTIONS, int_divide, int_modulo, ip_in_range, like_token, matches_phrase, type_name
from tidewell.model import SECOND, Measurement
from tidewell.operators import aggregates as A
from tidewell.operators import transforms as T
from tidewell.operators.causes import TABLES
from tidewell.operators.fill import fill
from tidewell.operators.forecast import holt_winters
from tidewell.operators.joins import contained
from tidewell.plans.parser import Parser, Select, SqlError, Union, With, parse

__all__ = ["Parser", "Planner", "SqlError", "parse", "run_sql"]

#: One value of a group each, by a window over the group.
RANKED = {"percentile": A.percentile, "mode": A.mode, "irate": A.irate, "integral": A.integral, "regr_slope": A.regr_slope, "ad_rmse_ext": A.rmse_of_halves}
RANKED_COLUMN = {"regr_slope": "slope", "ad_rmse_ext": "rmse"}
#: Selectors, which can carry other columns of their point along.
SELECTORS = ("min", "max", "first", "last")
#: Several rows for each group.
MULTI = ("top", "bottom", "sample", "distinct", "topn_ddcm", "topn_nagt2")
TRANSFORMS = ("difference", "non_negative_difference", "derivative", "non_negative_derivative", "cumulative_sum", "moving_average", "elapsed")
BUCKETED = ("sliding_window", "holt_winters", "holt_winters_with_fit", "compare")
#: Functions whose arguments are all columns, literals included.
ALL_COLUMNS = ("row_max", "levenshtein_distance", "atan2", "pow", "log", "if")
_INTEGRAL = ("bigint", "int", "smallint", "tinyint")


def instant(value) -> int:
    if isinstance(value, str):
        return int(datetime.datetime.fromisoformat(value.replace("Z", "")).replace(tzinfo=datetime.UTC).timestamp() * 1_000_000)
    return int(value)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def calls_in(tree) -> list[tuple]:
    """The calls of aggregates in an expression, outermost first."""
    if not isinstance(tree, tuple):
        return [x for t in tree for x in calls_in(t)] if isinstance(tree, list) else []
    if tree[0] == "call" and is_aggregate(tree[1]):
        return [tree]
    return [x for t in tree[1:] for x in calls_in(t)]


def is_aggregate(name: str) -> bool:
    return name in A.GROUPED or name in RANKED or name in MULTI or name in TRANSFORMS or name in BUCKETED or name in A.AGGREGATES


def names_in(tree) -> list[str]:
    if isinstance(tree, list):
        return [n for t in tree for n in names_in(t)]
    if not isinstance(tree, tuple):
        return []
    if tree[0] == "col":
        return [tree[1]]
    if tree[0] == "call":
        return [tree[1]]
    return [n for t in tree[1:] for n in names_in(t)]


class Planner:
    """Plans queries over named measurements.

    ``tables`` are functions that stand after FROM: they get the planner and
    their arguments, and return a measurement. ``write`` gets what SELECT INTO
    makes; without it the result becomes a source of this planner.
    """

    def __init__(self, sources: dict[str, Measurement], *, now: int | None = None, tables: dict[str, Callable] | None = None, write: Callable[[str, Measurement], None] | None = None):
        self.sources, self.tables, self.write = dict(sources), TABLES | (tables or {}), write
        self.now = int(clock.time() * 1_000_000) if now is None else now

    def run(self, tree) -> Measurement:
        if isinstance(tree, With):
            inner = Planner(self.sources, now=self.now, tables=self.tables, write=self.write)
            for name, part in tree.parts:
                inner.sources[name] = inner.run(part)
            return inner.run(tree.query)
        if isinstance(tree, Union):
            return self.union(tree)
        return self.select(tree)

    def union(self, tree: Union) -> Measurement:
        a, b = self.run(tree.left), self.run(tree.right)
        if tree.by_name:
            both = a.frame.unionByName(b.frame, allowMissingColumns=True)
        else:
            if len(a.frame.columns) != len(b.frame.columns):
                raise SqlError("UNION needs equally many columns")
            both = a.frame.union(b.frame)
        tags = tuple(t for t in a.tags if t in both.columns)
        return Measurement(both if tree.every_row else both.distinct(), tags, tuple(c for c in both.columns if c not in tags and c != "time"))

    # Sources.
    def source(self, tree) -> tuple[Measurement, str]:
        kind = tree[0]
        if kind == "table":
            name = tree[1] if tree[1] in self.sources else tree[1].rsplit(".", 1)[-1]
            if name not in self.sources:
                raise SqlError(f"unknown measurement {tree[1]}")
            return self.sources[name], tree[2] or name
        if kind == "tables":
            found = [m for n, m in sorted(self.sources.items()) if re.search(tree[1], n)]
            if not found:
                raise SqlError(f"no measurement matches {tree[1]}")
            return self.appended(found), ""
        if kind == "query":
            return self.run(tree[1]), tree[2] or ""
        if kind == "function":
            if tree[1] not in self.tables:
                raise SqlError(f"unknown table function {tree[1]}")
            return self.tables[tree[1]](self, *tree[2]), tree[3] or tree[1]
        return self.join(tree), ""

    def appended(self, found: list[Measurement]) -> Measurement:
        if len(found) == 1:
            return found[0]
        frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (m.frame for m in found))
        tags = tuple(dict.fromkeys(t for m in found for t in m.tags))
        return Measurement(frame, tags, tuple(dict.fromkeys(f for m in found for f in m.fields if f not in tags)))

    def join(self, tree) -> Measurement:
        _, how, left, right, on = tree
        sides = [self.source(left), self.source(right)]
        named = []
        for (m, alias), own in zip(sides, (left, right)):
            whole = own[0] == "join"
            names = {c: c if whole else f"{alias}.{c}" for c in m.frame.columns}
            named.append((m.frame.select(*(col(c).alias(n) for c, n in names.items())), names, m))
        (a, an, am), (b, bn, bm) = named
        pairs = []

        def collect(t):
            if t[0] == "and":
                collect(t[1])
                collect(t[2])
            elif t[0] == "cmp" and t[1] == "=" and t[2][0] == t[3][0] == "col":
                x, y = t[2][1], t[3][1]
                pick = lambda n, names, m: names.get(n, n if n in names.values() else None)
                pair = (pick(x, an, am), pick(y, bn, bm))
                pair = pair if None not in pair else (pick(y, an, am), pick(x, bn, bm))
                if None in pair:
                    raise SqlError(f"unknown columns in {x} = {y}")
                pairs.append(pair)
            else:
                raise SqlError("ON takes equalities of columns, joined by AND")

        collect(on)
        timed = [p for p in pairs if p[0].rsplit(".", 1)[-1] == "time"]
        if how == "full":
            # At most one partner for each time: the n-th with the n-th.
            times = timed or [(an["time"], bn["time"])]
            keys = [p for p in pairs if p not in timed] + times
            a = a.withColumn("_nth", F.row_number().over(Window.partitionBy(*(col(x) for x, _ in keys)).orderBy(*(col(c) for c in a.columns))))
            b = b.withColumn("_mth", F.row_number().over(Window.partitionBy(*(col(y) for _, y in keys)).orderBy(*(col(c) for c in b.columns))))
            pairs = [*keys, ("_nth", "_mth")]
        condition = reduce(lambda x, y: x & y, (col(x) == col(y) for x, y in pairs))
        out = a.join(b, condition, {"outer": "full"}.get(how, how)).drop("_nth", "_mth")
        if an.get("time") and bn.get("time"):
            first, second = (bn["time"], an["time"]) if how == "right" else (an["time"], bn["time"])
            out = out.withColumn("time", F.coalesce(col(first), col(second)))
        elif (only := an.get("time") or bn.get("time")) and only != "time":
            out = out.withColumn("time", col(only))
        tags = tuple(an[t] for t in am.tags) + tuple(bn[t] for t in bm.tags)
        return Measurement(out, tags, tuple(c for c in out.columns if c not in tags and c != "time"))

    # Expressions.
    def resolve(self, m: Measurement, name: str) -> str:
        columns = m.frame.columns
        if name in columns:
            return name
        if "." in name and name.split(".", 1)[1] in columns:
            return name.split(".", 1)[1]
        found = [c for c in columns if c.endswith("." + name)]
        if len(found) != 1:
            raise SqlError(f"{'ambiguous' if found else 'unknown'} column {name}")
        return found[0]

    def constant(self, tree):
        """The value of an expression without columns, or None."""
        kind = tree[0]
        if kind in ("num", "dur", "str", "bool"):
            return tree[1]
        if kind == "now":
            return self.now
        if kind == "neg":
            v = self.constant(tree[1])
            return None if v is None else -v
        if kind == "bin" and tree[1] in "+-":
            a, b = self.constant(tree[2]), self.constant(tree[3])
            if a is None or b is None:
                return None
            a, b = (instant(x) if isinstance(x, str) else x for x in (a, b))
            return a + b if tree[1] == "+" else a - b
        return None

    def kind(self, frame: DataFrame, c: Column) -> str:
        return frame.select(c.alias("x")).schema[0].dataType.simpleString()

    def column(self, m: Measurement, tree, known: dict[str, Column] | None = None) -> Column:
        """An expression over a measurement; ``known`` has columns of calls."""
        known = known or {}
        if repr(tree) in known:
            return known[repr(tree)]
        of = lambda t: self.column(m, t, known)
        kind = tree[0]
        if kind == "num":
            return F.lit(tree[1]).cast("long" if isinstance(tree[1], int) else "double")
        if kind in ("str", "bool"):
            return F.lit(tree[1])
        if kind == "dur":
            return F.lit(tree[1]).cast("long")
        if kind == "null":
            return F.lit(None)
        if kind == "now":
            return F.lit(self.now).cast("long")
        if kind == "col":
            return col(self.resolve(m, tree[1]))
        if kind == "neg":
            return -of(tree[1])
        if kind == "not":
            return ~of(tree[1])
        if kind == "and":
            return of(tree[1]) & of(tree[2])
        if kind == "or":
            return of(tree[1]) | of(tree[2])
        if kind == "cmp":
            return self.comparison(m, tree, of)
        if kind == "in":
            if not isinstance(tree[2], list):
                raise SqlError("IN (query) stands alone or with AND")
            found = of(tree[1]).isin(tree[2])
            return ~found if tree[3] else found
        if kind == "like":
            return like_token(of(tree[1]), tree[2])
        if kind == "case":
            out = None
            for condition, value in tree[1]:
                out = F.when(of(condition), of(value)) if out is None else out.when(of(condition), of(value))
            return out.otherwise(of(tree[2]))
        if kind == "cast":
            if tree[2] not in CASTS:
                raise SqlError(f"unknown type {tree[2]}")
            return CASTS[tree[2]](of(tree[1]), self.kind(m.frame, of(tree[1])) if not known else "double")
        if kind == "bin":
            return self.arithmetic(m, tree, of, known)
        if kind == "call":
            return self.call(m, tree, of)
        raise SqlError(f"{kind} can't stand here")

    def comparison(self, m, tree, of) -> Column:
        _, op, a, b = tree
        if op in ("=~", "!~"):
            found = F.rlike(of(a).cast("string"), F.lit(b[1]))
            return found if op == "=~" else ~found
        if ("col", "time") in (a, b):
            other = self.constant(b if a == ("col", "time") else a)
            if other is not None:
                x, y = of(a) if a == ("col", "time") else F.lit(instant(other)), of(b) if b == ("col", "time") else F.lit(instant(other))
                return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        x, y = of(a), of(b)
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def arithmetic(self, m, tree, of, known) -> Column:
        _, op, a, b = tree
        x, y = of(a), of(b)
        if op in "&|^":
            return {"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y)
        if op in "+-*":
            return {"+": x + y, "-": x - y, "*": x * y}[op]
        frame = known.get("frame", m.frame)
        if self.kind(frame, x) in _INTEGRAL and self.kind(frame, y) in _INTEGRAL:
            return (int_divide if op == "/" else int_modulo)(x, y)
        x, y = x.cast("double"), y.cast("double")
        inf = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        if op == "/":
            return F.when(y == 0, inf).otherwise(x / F.nullif(y, F.lit(0.0)))
        return F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.nullif(y, F.lit(0.0)))

    def call(self, m, tree, of) -> Column:
        _, name, args, _ = tree
        if is_aggregate(name):
            raise SqlError(f"{name} is an aggregate and can't stand here")
        if name in ("match", "matchphrase"):
            return matches_phrase(of(args[0]), self.constant(args[1]))
        if name == "ipinrange":
            return ip_in_range(of(args[0]), self.constant(args[1]))
        if name == "typeof":
            return F.lit(type_name(self.kind(m.frame, of(args[0]))))
        if name in CASTS or name.removeprefix("cast_") in CASTS and name.startswith("cast_"):
            return CASTS[name.removeprefix("cast_")](of(args[0]), self.kind(m.frame, of(args[0])))
        if name not in FUNCTIONS:
            raise SqlError(f"unknown function {name}")
        if name in ALL_COLUMNS:
            return FUNCTIONS[name](*(of(a) for a in args))
        if name == "json_object":
            return FUNCTIONS[name](*(of(a) if i % 2 else self.constant(a) for i, a in enumerate(args)))
        if name == "is_subnet_of":
            return FUNCTIONS[name](self.constant(args[0]), of(args[1]))
        values = [of(args[0])]
        for a in args[1:]:
            v = self.constant(a)
            values.append(of(a) if v is None else v)
        return FUNCTIONS[name](*values)

    # Conditions.
    def time_range(self, tree) -> tuple[int | None, int | None]:
        """The range of time that a condition's conjuncts leave: [start, stop)."""
        if tree is None:
            return None, None
        if tree[0] == "and":
            (a, b), (c, d) = self.time_range(tree[1]), self.time_range(tree[2])
            return max((x for x in (a, c) if x is not None), default=None), min((x for x in (b, d) if x is not None), default=None)
        if tree[0] != "cmp" or ("col", "time") not in (tree[2], tree[3]) or tree[1] not in ("=", "<", "<=", ">", ">="):
            return None, None
        op, a, b = tree[1:]
        if b == ("col", "time"):
            op, b = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), a
        value = self.constant(b)
        if value is None:
            return None, None
        t = instant(value)
        return {">": (t + 1, None), ">=": (t, None), "<": (None, t), "<=": (None, t + 1), "=": (t, t + 1)}[op]

    def filtered(self, m: Measurement, tree) -> Measurement:
        start, stop = self.time_range(tree)
        if start is not None or stop is not None:
            m = m.between(start, stop)
        conjuncts = []

        def split(t):
            if t[0] == "and":
                split(t[1])
                split(t[2])
            else:
                conjuncts.append(t)

        split(tree)
        for t in conjuncts:
            if calls_in(t):
                raise SqlError("aggregates can't stand in WHERE")
            if t[0] == "in" and not isinstance(t[2], list):
                inner = self.run(t[2])
                values = [c for c in inner.frame.columns if c != "time"] or ["time"]
                name = self.resolve(m, t[1][1]) if t[1][0] == "col" else None
                if name is None:
                    raise SqlError("IN (query) takes a column")
                m = Measurement(contained(m.frame, name, inner.frame.select(col(values[-1]).alias("_value")), t[3]), m.tags, m.fields)
            else:
                m = m.where(self.column(m, t))
        return m

    # SELECT.
    def select(self, tree: Select) -> Measurement:
        found = [self.source(s) for s in tree.sources]
        m = self.appended([x for x, _ in found])
        start, stop = self.time_range(tree.where)
        if tree.where is not None:
            m = self.filtered(m, tree.where)
        by = self.dimensions(m, tree)
        items = self.expanded(m, tree, by)
        out = self.planned(m, tree, items, by, start, stop)
        if "filter_null_column" in tree.hints:
            seen = out.frame.agg(*(F.count(col(c)).alias(c) for c in out.frame.columns)).first()
            out = Measurement(out.frame.select(*(col(c) for c in out.frame.columns if seen[c])), out.tags, out.fields)
        out = self.limited(out, tree, by)
        if tree.into:
            if self.write:
                self.write(tree.into, out)
            else:
                self.sources[tree.into] = out
        return out

    def dimensions(self, m: Measurement, tree: Select) -> tuple[str, ...]:
        by: list[str] = []
        for d in tree.by:
            if d[0] == "star":
                by += m.tags
            elif d[0] == "regex":
                by += [t for t in m.tags if re.search(d[1], t)]
            else:
                by.append(self.resolve(m, d[1]))
        gone = {self.resolve(m, n) for n in tree.without}
        return tuple(b for b in dict.fromkeys(by) if b not in gone)

    def expanded(self, m: Measurement, tree: Select, by) -> list[tuple[tuple, str]]:
        out: list[tuple[tuple, str]] = []
        fields = [f for f in m.fields if f != "time" and f in m.frame.columns]
        for item, alias in tree.items:
            if item[0] == "star":
                names = {"tag": list(m.tags), "field": fields}.get(item[1], fields + [t for t in m.tags if t not in by])
                out += [(("col", n), n) for n in names]
            elif item[0] == "regex":
                out += [(("col", n), n) for n in [*fields, *m.tags] if re.search(item[1], n)]
            elif item[0] == "call" and is_aggregate(item[1]) and item[2] and item[2][0][0] in ("star", "regex"):
                some = [f for f in fields if item[2][0][0] == "star" or re.search(item[2][0][1], f)]
                out += [(("call", item[1], [("col", f), *item[2][1:]], item[3]), f"{alias or item[1]}_{f}") for f in some]
            else:
                out.append((item, alias or "_".join(dict.fromkeys(names_in(item))) or "expr"))
        if not out:
            raise SqlError("nothing is selected")
        seen: dict[str, int] = {}
        named = []
        for item, name in out:
            seen[name] = seen.get(name, -1) + 1
            named.append((item, f"{name}_{seen[name]}" if seen[name] else name))
        return named

    def planned(self, m, tree, items, by, start, stop) -> Measurement:
        calls = list({repr(c): c for item, _ in items for c in calls_in(item)}.values())
        if not calls:
            if tree.every:
                raise SqlError("GROUP BY time needs an aggregate")
            if tree.filled and tree.fill in ("none", "linear"):
                raise SqlError(f"fill({tree.fill}) needs an aggregate")
            timed = ["time"] if "time" in m.frame.columns else []
            kept = [c for c in dict.fromkeys([*timed, *by])]
            chosen = [self.column(m, item).alias(n) for item, n in items if not (n in kept and item == ("col", n))]
            frame = m.frame.select(*(col(c) for c in kept), *chosen)
            tags = by or tuple(n for item, n in items if item[0] == "col" and n in m.tags)
            return Measurement(frame, tags, tuple(c for c in frame.columns if c not in tags and c != "time"))
        names = [c[1] for c in calls]
        raw = [(item, n) for item, n in items if not calls_in(item) and names_in(item)]
        if any(n in MULTI for n in names):
            return self.multi(m, tree, items, by, calls, raw)
        if any(n in TRANSFORMS or n in BUCKETED for n in names):
            return self.series(m, tree, items, by, calls, raw, start, stop)
        if raw:
            return self.selected(m, tree, items, by, calls, raw)
        return self.aggregated(m, tree, items, by, calls, start, stop)

    def bucket(self, tree) -> Column:
        return A.local_bucket(tree.every, tree.zone) if tree.zone else A.bucket(tree.every, tree.offset)

    def keyed(self, m: Measurement, tree, by) -> tuple[Measurement, tuple[str, ...]]:
        if not tree.every:
            return m, by
        return Measurement(m.frame.withColumn("_bucket", self.bucket(tree)), m.tags, m.fields), (*by, "_bucket")

    def argument(self, m: Measurement, call, names: dict) -> str:
        """The column that an aggregate's first argument names or makes."""
        arg = call[2][0] if call[2] else ("col", "time")
        if arg[0] == "call" and arg[1] == "distinct":
            arg = arg[2][0]
        if arg[0] == "col":
            return self.resolve(m, arg[1])
        if calls_in(arg):
            raise SqlError(f"{call[1]} can't be taken of an aggregate")
        return names.setdefault(repr(arg), (f"_arg{len(names)}", self.column(m, arg)))[0]

    def aggregated(self, m, tree, items, by, calls, start, stop) -> Measurement:
        made: dict = {}
        fields = [self.argument(m, c, made) for c in calls]
        m = Measurement(m.frame.withColumns({n: c for n, c in made.values()}) if made else m.frame, m.tags, m.fields)
        m, keys = self.keyed(m, tree, by)
        grouped, ranked = {}, {}
        for i, (c, f) in enumerate(zip(calls, fields)):
            more = [self.constant(a) for a in c[2][1:]]
            if c[1] in RANKED:
                name = {"regr_slope": "slope", "ad_rmse_ext": "rmse"}.get(c[1], c[1])
                extra = [more[0]] if c[1] in ("percentile", "irate", "integral") and more else []
                out = RANKED[c[1]](m, f, extra[0], keys) if c[1] == "percentile" else RANKED[c[1]](m, f, keys, *extra)
                ranked[f"_c{i}"] = out.select(*(col(k) for k in keys), F.col(name).alias(f"_c{i}"))
            elif c[1] == "count" and (c[3] or c[2] and c[2][0][0] == "call"):
                grouped[f"_c{i}"] = F.count_distinct(col(f))
            elif c[1] in A.AGGREGATES:
                grouped[f"_c{i}"] = A.AGGREGATES[c[1]](f, *more)
            else:
                grouped[f"_c{i}"] = A.GROUPED[c[1]](f, *more)
        frame = m.frame.groupBy(*(col(k) for k in keys)).agg(*(c.alias(n) for n, c in (grouped or {"_n": F.count("*")}).items()))
        for n, part in ranked.items():
            on = [F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) for k in keys]
            pair = frame.alias("_l").join(part.alias("_r"), reduce(lambda x, y: x & y, on) if on else F.lit(True), "left")
            frame = pair.select(*(F.col(f"_l.`{c}`") for c in frame.columns), F.col(f"_r.{n}"))
        known = {repr(c): F.col(f"_c{i}") for i, c in enumerate(calls)}
        known["frame"] = frame
        result = Measurement(frame, by, ())
        chosen = [self.column(result, item, known).alias(n) for item, n in items]
        out = frame.select(*(col(b) for b in by), *([F.col("_bucket").alias("time")] if tree.every else []), *chosen)
        values = [n for _, n in items]
        if tree.every and tree.fill != "none" and start is not None and stop is not None:
            if tree.zone and isinstance(tree.fill, str) is False or not tree.zone:
                first = start - (start - tree.offset) % tree.every
                how = 0 if len(calls) == 1 and len(items) == 1 and calls[0][1] == "count" and tree.fill == "null" else tree.fill
                out = fill(out, by, values, first, stop, tree.every, how)
        return Measurement(out, by, tuple(values))

    def selected(self, m, tree, items, by, calls, raw) -> Measurement:
        """One selector with other columns of its point."""
        if len(calls) != 1 or calls[0][1] not in SELECTORS or any(c != calls[0] for item, _ in items for c in calls_in(item)):
            raise SqlError("aggregates and raw columns can't be mixed, but for one selector")
        made: dict = {}
        f = self.argument(m, calls[0], made)
        m = Measurement(m.frame.withColumns({n: c for n, c in made.values()}) if made else m.frame, m.tags, m.fields)
        m, keys = self.keyed(m.where(col(f).isNotNull()), tree, by)
        order = {"min": F.struct(col(f), "time"), "max": F.struct(col(f), -F.col("time")), "first": F.struct("time", -col(f)), "last": F.struct("time", col(f))}[calls[0][1]]
        pick = F.min_by if calls[0][1] in ("min", "first") else F.max_by
        others = [self.column(m, item).alias(f"_r{i}") for i, (item, _) in enumerate(raw)]
        point = pick(F.struct(F.col("time").alias("_t"), col(f).alias("_v"), *others), order).alias("_p")
        frame = m.frame.groupBy(*(col(k) for k in keys)).agg(point).select(*(col(k) for k in keys), "_p.*")
        known = {repr(calls[0]): F.col("_v"), "frame": frame} | {repr(item): F.col(f"_r{i}") for i, (item, _) in enumerate(raw)}
        result = Measurement(frame, by, ())
        chosen = [self.column(result, item, known).alias(n) for item, n in items if n not in by]
        time = F.col("_bucket" if tree.every else "_t").alias("time")
        return Measurement(frame.select(*(col(b) for b in by), time, *chosen), by, tuple(n for _, n in items if n not in by))

    def multi(self, m, tree, items, by, calls, raw) -> Measurement:
        if len(calls) != 1 or any(item not in (calls[0], *(r for r, _ in raw)) for item, _ in items):
            raise SqlError(f"{calls[0][1]} must be the only call")
        call, args = calls[0], calls[0][2]
        name = next(n for item, n in items if item == call)
        made: dict = {}
        f = self.argument(m, call, made)
        m = Measurement(m.frame.withColumns({n: c for n, c in made.values()}) if made else m.frame, m.tags, m.fields)
        if call[1] in ("topn_ddcm", "topn_nagt2"):
            share, n = self.constant(args[1]), self.constant(args[2])
            out = A.heavy_hitters(m, f, n, self.constant(args[3]) if len(args) > 3 else "count", by or (f,), share)
            return Measurement(out.withColumnRenamed("total", name), by or (f,), (name,))
        m, keys = self.keyed(m, tree, by)
        time = [F.col("_bucket").alias("time")] if tree.every else []
        if call[1] == "distinct":
            out = m.where(col(f).isNotNull()).frame.select(*(col(b) for b in by), *time, col(f).alias(name)).distinct()
            return Measurement(out, by, (name,))
        n, tags = self.constant(args[-1]), [self.resolve(m, a[1]) for a in args[1:-1]]
        if call[1] == "sample":
            rows = A.sample(m, f, n, keys)
        else:
            if tags:  # the best point of each combination of tags first
                m = Measurement(A.top(m, f, 1, (*keys, *tags), call[1] == "top"), m.tags, m.fields)
            rows = A.top(m, f, n, keys, call[1] == "top")
        chosen = [col(f).alias(name), *(col(t) for t in tags), *(self.column(m, item).alias(k) for item, k in raw if k not in by and k not in tags)]
        out = rows.select(*(col(b) for b in by), "time", *chosen)
        return Measurement(out, by, tuple(c for c in out.columns if c not in by and c != "time"))

    def series(self, m, tree, items, by, calls, raw, start, stop) -> Measurement:
        """Functions of the points of a series, or of its buckets."""
        if raw or any(item[0] != "call" for item, _ in items):
            raise SqlError(f"{calls[0][1]} stands alone or with its like")
        if len(items) > 1 and all(item[1] in TRANSFORMS and not (item[2][0][0] == "call" and is_aggregate(item[2][0][1])) for item, _ in items):
            return self.point_steps(m, tree, items, by)
        parts = [self.one_series(m, tree, item, n, by, start, stop) for item, n in items]
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, [*by, "time"], "full")
        return Measurement(out, by, tuple(c for c in out.columns if c not in by and c != "time"))

    def point_steps(self, m, tree, items, by) -> Measurement:
        """Functions of points side by side, in one pass, as times may repeat."""
        made: dict = {}
        fields = [self.argument(m, item, made) for item, _ in items]
        m = Measurement(m.frame.withColumns({n: c for n, c in made.values()}) if made else m.frame, m.tags, m.fields)
        parts = [(n, *self.step(item[1], [self.constant(a) for a in item[2][1:]], tree), f) for (item, n), f in zip(items, fields)]
        return Measurement(T.side_by_side(m, by, parts), by, tuple(n for _, n in items if n not in by and n != "time"))

    def one_series(self, m, tree, item, name, by, start, stop) -> DataFrame:
        _, call, args, _ = item
        inner = args[0]
        more = [self.constant(a) for a in args[1:]]
        if call in BUCKETED:
            if inner[0] != "call" or inner[1] not in A.GROUPED or not tree.every:
                raise SqlError(f"{call} takes an aggregate and GROUP BY time")
            field = self.resolve(m, inner[2][0][1])
            if call == "sliding_window":
                return T.sliding_window(m, inner[1], field, more[0], tree.every, by).withColumnRenamed("value", name)
            if call == "compare":
                offsets = [o if a[0] == "dur" else o * SECOND for o, a in zip(more, args[1:])]
                return T.compare(m, inner[1], field, tree.every, offsets, by).withColumnsRenamed({f"value_{i}": f"{name}_{i}" for i in range(len(offsets) + 1)})
            buckets = A.aggregate(m, {"value": (inner[1], field)}, by=by, every=tree.every, offset=tree.offset)
            return holt_winters(buckets, by, "value", tree.every, more[0], more[1], with_fit=call.endswith("fit")).withColumnRenamed("value", name)
        if inner[0] == "call" and is_aggregate(inner[1]):
            if not tree.every:
                raise SqlError(f"{call} of an aggregate needs GROUP BY time")
            plain = self.aggregated(m, tree, [(inner, "_inner")], by, [inner], start, stop)
            m, field = Measurement(plain.frame, by, ("_inner",)), "_inner"
        else:
            made: dict = {}
            field = self.argument(m, item, made)
            m = Measurement(m.frame.withColumns({n: c for n, c in made.values()}) if made else m.frame, m.tags, m.fields)
        step, args = self.step(call, more, tree)
        out = getattr(T, step)(m, field, by=by, **args)
        return out.withColumnRenamed("value", name)

    def step(self, call, more, tree) -> tuple[str, dict]:
        """A transform's function and its arguments."""
        name, non_negative = call.removeprefix("non_negative_"), call.startswith("non")
        if name == "difference":
            return name, {"kind": more[0] if more else "behind", "non_negative": non_negative}
        if name == "derivative":
            return name, {"unit": more[0] if more else tree.every or SECOND, "non_negative": non_negative}
        if name == "moving_average":
            return name, {"n": more[0]}
        return name, {"unit": more[0] if more else 1} if name == "elapsed" else {}

    def limited(self, out: Measurement, tree: Select, by) -> Measurement:
        frame = out.frame
        known = frame.columns
        order = [col(self.resolve(out, c)).desc() if desc else col(self.resolve(out, c)).asc() for c, desc in tree.order]
        within = [*order, *([F.col("time").asc()] if "time" in known and "time" not in [c for c, _ in tree.order] else [])]
        kept = [b for b in by if b in known]
        if tree.slimit is not None or tree.sskip:
            if not kept:
                raise SqlError("SLIMIT needs GROUP BY tags")
            series = frame.select(*(col(b) for b in kept)).distinct().orderBy(*(col(b) for b in kept))
            series = series.offset(tree.sskip) if tree.sskip else series
            series = series.limit(tree.slimit) if tree.slimit is not None else series
            on = reduce(lambda x, y: x & y, (F.col(f"_f.`{b}`").eqNullSafe(F.col(f"_s.`{b}`")) for b in kept))
            frame = frame.alias("_f").join(series.alias("_s"), on, "left_semi")
        if tree.limit is not None and kept and within:
            place = F.row_number().over(Window.partitionBy(*(col(b) for b in kept)).orderBy(*within))
            frame = frame.withColumn("_place", place).where((F.col("_place") > tree.skip) & (F.col("_place") <= tree.skip + tree.limit)).drop("_place")
        if order:
            frame = frame.orderBy(*order)
        if tree.limit is not None and not (kept and within):
            if not order and within:
                frame = frame.orderBy(*within)
            frame = (frame.offset(tree.skip) if tree.skip else frame).limit(tree.limit)
        return Measurement(frame, out.tags, out.fields)


def run_sql(text: str, sources: dict[str, Measurement], **settings) -> DataFrame:
    return Planner(sources, **settings).run(parse(text)).frame
