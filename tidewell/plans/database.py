"""Stored measurements and the statements about them.

A database is a folder: one folder of Parquet for each measurement, and what its
tags and fields are as a line of JSON. Everything is read and written by Spark,
so that the folder can be in any store.
"""

from __future__ import annotations

import json
import re
import time as clock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import Measurement
from tidewell.operators.aggregates import GROUPED
from tidewell.plans.parser import Parser, SqlError, duration
from tidewell.plans.sql import Planner
from tidewell.sources.line_protocol import number, parse_lines, text_value
from tidewell.streaming import rollup

KINDS = {"tag": "string", "string": "string", "float": "double", "float64": "double", "double": "double", "int": "bigint", "int64": "bigint", "integer": "bigint", "bool": "boolean", "boolean": "boolean"}


def merged_points(frame: DataFrame, tags: tuple[str, ...], fields: tuple[str, ...], order: str) -> DataFrame:
    """One row for each series and time: of each field the last known value in
    the order of writing; a later null leaves it alone."""
    last = [F.max_by(f"`{f}`", F.when(F.col(f"`{f}`").isNotNull(), F.col(order))).alias(f) for f in fields]
    return frame.groupBy(*tags, "time").agg(*last).select("time", *tags, *fields)


class Database:
    def __init__(self, spark: SparkSession, folder: str, *, now: int | None = None, tables: dict | None = None):
        self.spark, self.folder, self.now, self.tables = spark, folder.rstrip("/"), now, tables or {}
        self.streams: dict[str, tuple] = {}
        self.continuous: dict[str, tuple] = {}
        self.retention: int | None = None

    # Storage.
    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def names(self) -> list[str]:
        fs, where = self._path(f"{self.folder}/catalog")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def shape(self, name: str) -> tuple[tuple[str, ...], dict[str, str]]:
        """Tags, and fields with their types."""
        if name not in self.names():
            raise SqlError(f"unknown measurement {name}")
        found = json.loads(self.spark.read.text(f"{self.folder}/catalog/{name}").first()[0])
        return tuple(found["tags"]), found["fields"]

    def create(self, name: str, tags: list[str], fields: dict[str, str]) -> None:
        row = json.dumps({"tags": list(tags), "fields": fields})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/catalog/{name}")

    def write(self, name: str, m: Measurement) -> None:
        """Appends points; a new measurement is made, new fields are added. Points
        are dealt to folders by day, so that a time range prunes them."""
        frame = m.frame if "time" in m.frame.columns else m.frame.withColumn("time", F.lit(0).cast("long"))
        kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
        fields = {f: kinds[f] for f in m.fields if f in kinds}
        tags, known = self.shape(name) if name in self.names() else (m.tags, {})
        if clash := [f for f in fields if f in known and known[f] != fields[f]]:
            raise SqlError(f"field type conflict: {', '.join(clash)}")
        if not known or set(fields) - set(known) or set(m.tags) - set(tags):
            tags = tuple(dict.fromkeys([*tags, *m.tags]))
            self.create(name, list(tags), known | fields)
        seq = F.lit(int(clock.time() * 1_000_000)).cast("long").alias("_seq")
        day = F.floor(F.col("time") / 86_400_000_000).cast("int").alias("_day")
        out = frame.select("time", *(F.col(f"`{t}`").cast("string").alias(t) for t in m.tags), *(F.col(f"`{f}`") for f in fields), seq, day)
        out.write.mode("append").partitionBy("_day").parquet(f"{self.folder}/data/{name}")

    def read(self, name: str) -> Measurement:
        tags, fields = self.shape(name)
        schema = ", ".join(["time bigint", *(f"`{t}` string" for t in tags), *(f"`{f}` {k}" for f, k in fields.items()), "_seq bigint", "_day int"])
        fs, where = self._path(f"{self.folder}/data/{name}")
        stored = self.spark.read.schema(schema).parquet(f"{self.folder}/data/{name}") if fs.exists(where) else self.spark.createDataFrame([], schema)
        return Measurement(merged_points(stored, tags, tuple(fields), "_seq"), tags, tuple(fields))

    def insert(self, lines: DataFrame, column: str = "value") -> None:
        """Line protocol: each measurement of the lines is written by itself."""
        rows = parse_lines(lines, column).where("size(fields) > 0")
        time = F.coalesce(F.expr("(time_ns - pmod(time_ns, 1000)) div 1000"), F.lit(self._now())).cast("long").alias("time")
        keys = rows.groupBy("measurement").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("tags"))))).alias("tags"), F.collect_set(F.map_keys("fields")).alias("f"), F.map_from_entries(F.array_distinct(F.flatten(F.collect_set(F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("k"), F.rlike(e["value"], F.lit('^"')).cast("string").alias("v"))))))).alias("quoted"))
        for row in keys.collect():  # as many as there are measurements
            names = sorted({n for ns in row["f"] for n in ns})
            fields = [(text_value(F.col("fields")[n]) if row["quoted"].get(n) == "true" else number(F.col("fields")[n])).alias(n) for n in names]
            frame = rows.where(F.col("measurement") == row["measurement"]).select(time, *(F.col("tags")[t].alias(t) for t in row["tags"]), *fields)
            self.write(row["measurement"], Measurement(frame, tuple(row["tags"]), tuple(names)))

    def export(self, name: str, path: str) -> None:
        """A measurement's points as Parquet files, sorted by series and time."""
        m = self.read(name)
        m.frame.repartition(*m.tags).sortWithinPartitions(*m.tags, "time").write.mode("overwrite").parquet(path) if m.tags else m.frame.write.mode("overwrite").parquet(path)

    def _now(self) -> int:
        return int(clock.time() * 1_000_000) if self.now is None else self.now

    # Statements.
    def planner(self) -> Planner:
        return Planner({n: self.read(n) for n in self.names()}, now=self._now(), tables=self.tables, write=self.write)

    def execute(self, text: str) -> DataFrame | None:
        parser = Parser(text)
        word = parser.value.lower()
        if word in ("select", "with", "("):
            tree = parser.query()
            parser.end()
            return self.planner().run(tree).frame
        handler = getattr(self, f"_{word}", None)
        if handler is None:
            raise SqlError(f"unknown statement {parser.value}")
        parser.advance()
        return handler(parser, text)

    def _explain(self, parser, text) -> DataFrame:
        analyze = parser.maybe("analyze")
        tree = parser.query()
        parser.end()
        frame = self.planner().run(tree).frame
        if analyze:
            frame.write.format("noop").mode("overwrite").save()
        plan = frame._jdf.queryExecution().toString()
        return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")

    def _insert(self, parser, text) -> None:
        line = re.sub(r"^\s*insert\s+(into\s+\S+\s+)?", "", text, flags=re.I)
        self.insert(self.spark.createDataFrame([(line,)], "value string"))

    def _create(self, parser, text):
        kind = parser.name().lower()
        if kind == "measurement":
            name = parser.name()
            tags, fields = [], {}
            parser.need("(")
            while not parser.maybe(")"):
                column, of = parser.name(), parser.name().lower()
                if of not in KINDS:
                    raise SqlError(f"unknown type {of}")
                if of == "tag":
                    tags.append(column)
                else:
                    if parser.at("field"):
                        parser.advance()
                    fields[column] = KINDS[of]
                parser.maybe(",")
            self.create(name, tags, fields)
        elif kind == "stream":
            name = parser.name()
            parser.need("into")
            target = parser.name()
            parser.need("on")
            tree = parser.select()
            delay = parser.literal() if parser.maybe("delay") else 0
            parser.end()
            self._check_stream(tree, delay)
            self.streams[name] = (target, tree, delay)
        elif kind == "continuous":
            parser.name()
            name = parser.name()
            every = span = None
            if parser.maybe("resample"):
                every = parser.literal() if parser.maybe("every") else None
                span = parser.literal() if parser.maybe("for") else None
            parser.need("begin")
            tree = parser.select()
            parser.need("end")
            span = span or every or tree.every
            if not span or not tree.into:
                raise SqlError("a continuous query needs INTO and an interval")
            self.continuous[name] = (tree, every or span, span)
        elif kind == "retention":
            found = re.search(r"duration\s+((?:\d+[a-zµ]+)+)", text, re.I)
            if not found:
                raise SqlError("a retention policy needs a DURATION")
            self.retention = duration(found[1])
        else:
            raise SqlError(f"can't create {kind}")

    @staticmethod
    def _check_stream(tree, delay: int) -> None:
        calls = [t for t, _ in tree.items if t[0] == "call"]
        if tree.every and (len(calls) != len(tree.items) or any(c[1] not in rollup.STREAM_CALLS for c in calls)):
            raise SqlError("a stream takes min, max, sum and count")
        if not tree.every and calls:
            raise SqlError("a stream's aggregates need GROUP BY time")
        if tree.every and delay >= rollup.MOST_WINDOWS * tree.every:
            raise SqlError("a stream's delay is under ten windows")

    def run_stream(self, name: str) -> None:
        """What arrived since the last run, into the stream's target."""
        target, tree, delay = self.streams[name]
        source = tree.sources[0][1]
        tags, fields = self.shape(source)
        schema = ", ".join(["time bigint", *(f"`{t}` string" for t in tags), *(f"`{f}` {k}" for f, k in fields.items()), "_seq bigint"])
        stream = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/data/{source}")
        m = Measurement(stream, tags, tuple(fields))
        if tree.where is not None:
            m = Planner({}, now=self._now()).filtered(m, tree.where)
        by = [b[1] for b in tree.by]
        if not tree.every:
            names = [n for _, n in Planner({}).expanded(m, tree, ())]
            rolled = m.frame.select("time", *(c for c in dict.fromkeys([*tags, *names]) if c != "time"))
        else:
            calls = {(alias or t[1]): (t[1], t[2][0][1]) for t, alias in tree.items}
            timed = m.frame.withColumn("time", F.timestamp_micros("time")).withWatermark("time", f"{delay} microseconds")
            columns = [rollup.STREAM_CALLS[c](f"`{f}`").alias(n) for n, (c, f) in calls.items()]
            rolled = timed.groupBy(F.window("time", f"{tree.every} microseconds").alias("_w"), *by).agg(*columns).select(*by, F.unix_micros("_w.start").alias("time"), *calls)
        kept = tags if not tree.every else tuple(by)

        def write(batch: DataFrame, number: int) -> None:
            self.write(target, Measurement(batch, kept, tuple(c for c in batch.columns if c not in kept and c != "time")))

        rolled.writeStream.outputMode("update" if tree.every else "append").foreachBatch(write).option("checkpointLocation", f"{self.folder}/streams/{name}").trigger(availableNow=True).start().awaitTermination()

    def run_continuous(self, name: str) -> None:
        """One run at ``now``: the whole stretch before it, into the target."""
        tree, _, span = self.continuous[name]
        stop = self._now() - self._now() % span
        timed = ("and", ("cmp", ">=", ("col", "time"), ("num", stop - span)), ("cmp", "<", ("col", "time"), ("num", stop)))
        from dataclasses import replace

        self.planner().run(replace(tree, where=timed if tree.where is None else ("and", tree.where, timed)))

    def retain(self) -> None:
        """Drops the days that the retention no longer covers."""
        if self.retention is None:
            return
        first = (self._now() - self.retention) // 86_400_000_000
        for name in self.names():
            fs, where = self._path(f"{self.folder}/data/{name}")
            for s in fs.listStatus(where) if fs.exists(where) else ():
                day = s.getPath().getName()
                if day.startswith("_day=") and int(day[5:]) < first:
                    fs.delete(s.getPath(), True)

    def downsample(self, name: str, calls: list[str], every: int, target: str) -> None:
        m = self.read(name)
        _, fields = self.shape(name)
        numeric = [f for f, k in fields.items() if k != "string"]
        frame = rollup.downsample(m, {f: [c for c in calls if c in GROUPED] for f in numeric}, every)
        self.write(target, Measurement(frame, m.tags, tuple(c for c in frame.columns if c not in m.tags and c != "time")))

    def _drop(self, parser, text) -> None:
        kind, name = parser.name().lower(), parser.name()
        if kind == "stream":
            self.streams.pop(name)
        elif kind == "continuous":
            self.continuous.pop(parser.name())
        elif kind == "measurement":
            self.shape(name)
            for part in ("data", "catalog"):
                fs, where = self._path(f"{self.folder}/{part}/{name}")
                fs.delete(where, True)
        else:
            raise SqlError(f"can't drop {kind}")

    def _delete(self, parser, text) -> None:
        """Rewrites the days that hold points to delete."""
        parser.need("from")
        name = parser.name()
        m, (tags, fields) = self.read(name), self.shape(name)
        gone = m if not parser.maybe("where") else Planner({}, now=self._now()).filtered(m, parser.expression())
        parser.end()
        left = m.frame.join(gone.frame.select(*tags, "time"), [*(m.frame[t].eqNullSafe(gone.frame[t]) for t in tags), m.frame["time"] == gone.frame["time"]], "left_anti") if tags else m.frame.join(gone.frame.select("time"), "time", "left_anti")
        fs, where = self._path(f"{self.folder}/data/{name}")
        fresh = f"{self.folder}/data/.{name}.next"
        day = F.floor(F.col("time") / 86_400_000_000).cast("int").alias("_day")
        left.select("*", F.lit(self._now()).cast("long").alias("_seq"), day).write.mode("overwrite").partitionBy("_day").parquet(fresh)
        fs.delete(where, True)
        fs.rename(self._path(fresh)[1], where)

    def _show(self, parser, text) -> DataFrame:
        words = [w.lower() for w in re.findall(r"[A-Za-z_]+", text)][1:]
        found = re.search(r"from\s+\"?(\w+)\"?", text, re.I)
        names = [found[1]] if found else self.names()
        rows, schema = [], ""
        if words[0] == "measurements":
            rows, schema = [(n,) for n in self.names()], "name string"
        elif words[:2] == ["tag", "keys"]:
            rows, schema = [(n, t) for n in names for t in self.shape(n)[0]], "name string, tag string"
        elif words[:2] == ["field", "keys"]:
            rows, schema = [(n, f, k) for n in names for f, k in self.shape(n)[1].items()], "name string, field string, type string"
        elif words[:2] == ["tag", "values"]:
            key = re.search(r"key\s*=\s*\"?(\w+)\"?", text, re.I)
            if not key:
                raise SqlError("SHOW TAG VALUES needs WITH KEY = tag")
            parts = [self.read(n).frame.select(F.lit(n).alias("name"), F.col(key[1]).alias("value")).where("value is not null").distinct() for n in names if key[1] in self.shape(n)[0]]
            return self._all(parts, "name string, value string")
        elif words[0] == "series":
            parts = []
            for n in names:
                tags = self.shape(n)[0]
                text_of = F.concat_ws(",", F.lit(n), *(F.concat(F.lit(f"{t}="), F.col(t)) for t in tags))
                parts.append(self.read(n).frame.select(F.lit(n).alias("name"), text_of.alias("series")).distinct())
            out = self._all(parts, "name string, series string")
            return out.groupBy("name").agg(F.count("*").alias("cardinality")) if "cardinality" in words else out
        elif words[0] == "streams":
            rows, schema = [(n, s[0]) for n, s in self.streams.items()], "name string, target string"
        elif words[:2] == ["continuous", "queries"]:
            rows, schema = [(n, q[0].into) for n, q in self.continuous.items()], "name string, target string"
        else:
            raise SqlError(f"can't show {' '.join(words)}")
        return self.spark.createDataFrame(rows, schema)

    def _all(self, parts: list[DataFrame], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for part in parts:
            out = out.unionByName(part)
        return out
