"""Line protocol: ``measurement,tag=value field=value[,field=value] [time]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A separator that no backslash escapes.
_UNESCAPED = r"(?<!\\)"


def _pairs(text: Column) -> Column:
    parts = F.filter(F.split(text, _UNESCAPED + ","), lambda p: p != "")
    pair = lambda p: F.split(p, _UNESCAPED + "=", 2)
    clean = lambda s: F.regexp_replace(s, r"\\([,= ])", "$1")
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(clean(F.get(pair(p), 0)), clean(F.get(pair(p), 1)))))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """measurement, tags, fields (as text, with their type marks), time in ns.

    Blank lines and comments are left out; lines without fields give nulls.
    Blanks and commas inside quoted field values are not split at.
    """
    line = F.trim(F.col(column))
    kept = lines.where((line != "") & ~line.startswith("#")).select(line.alias("line"))
    found = kept.select(F.regexp_extract("line", r"^((?:\\.|[^ ])+) ", 1).alias("head"), F.regexp_extract("line", r'^(?:\\.|[^ ])+ ((?:"(?:\\.|[^"])*"|\\.|[^ "])+)', 1).alias("body"), F.regexp_extract("line", r" (-?\d+)$", 1).try_cast("long").alias("time_ns"))
    quoted = F.regexp_replace("body", r'("(?:\\.|[^"])*")', "$1")
    tags = F.regexp_extract("head", r"^(?:\\.|[^,])+,(.*)$", 1)
    return found.select(F.regexp_extract("head", r"^((?:\\.|[^,])+)", 1).alias("measurement"), _pairs(tags).alias("tags"), _fields(quoted).alias("fields"), "time_ns")


def _fields(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r'((?:\\.|[^,=])+=(?:"(?:\\.|[^"])*"|(?:\\.|[^,"])+))'), F.lit(1))
    return F.map_from_entries(F.transform(found, lambda p: F.struct(F.regexp_extract(p, r"^((?:\\.|[^,=])+)=", 1), F.regexp_extract(p, r"^(?:\\.|[^,=])+=(.*)$", 1))))


def number(field: Column) -> Column:
    """A float (1.5), integer (3i) or boolean (t) field as a double."""
    return F.when(F.lower(field).isin("t", "true"), 1.0).when(F.lower(field).isin("f", "false"), 0.0).otherwise(F.regexp_replace(field, "[iu]$", "").try_cast("double"))


def text_value(field: Column) -> Column:
    """A quoted field without its quotes and escapes."""
    return F.regexp_replace(F.regexp_replace(field, r'^"|"$', ""), r"\\([\"\\])", "$1")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), r"([,= ])", r"\\$1")


def lines_of(frame: DataFrame, name: str, tags: list[str], fields: list[str], time: str = "time") -> DataFrame:
    """Points (times in microseconds) as line protocol, one column ``value``;
    points without any field are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}

    def shown(f: str) -> Column:
        x = F.col(f)
        if kinds[f] == "string":
            x = F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
        elif kinds[f] in ("bigint", "int", "smallint", "tinyint"):
            x = F.concat(x.cast("string"), F.lit("i"))
        return F.concat(F.lit(f"{f}="), x.cast("string"))

    head = F.concat_ws(",", F.lit(name), *(F.when(F.col(t).isNotNull() & (F.col(t).cast("string") != ""), F.concat(F.lit(f"{t}="), _escaped(F.col(t)))) for t in tags))
    body = F.concat_ws(",", *(shown(f) for f in fields))
    return frame.select(F.concat(head, F.lit(" "), body, F.lit(" "), F.col(time).cast("string"), F.lit("000")).alias("value")).where(body != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))
