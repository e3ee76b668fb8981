"""The log search language: conditions, then extractions behind pipes.

    level:error "disk full" OR host IN ("a", "b") | EXTRACT(content: "id=(\\d+)") AS (id)

Terms side by side must all hold. A bare word or a quoted phrase is searched in
the text column; ``field:word`` in that field; ``field IN (a b]`` is a range, open
at a round bracket and closed at a square one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import matches_phrase

_TOKEN = re.compile(r"\s*(?:(?P<string>\"(?:[^\"\\]|\\.)*\")|(?P<op><=|>=|!=|[()\[\]:,|<>=])|(?P<word>[^\s()\[\]:,|<>=\"]+))")


class LogError(ValueError):
    pass


class Search:
    def __init__(self, text: str, columns: list[str], content: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            found = _TOKEN.match(text, at)
            if not found:
                raise LogError(f"unexpected text at {at}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at, self.columns, self.content = 0, columns, content

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def here(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind != "string" and text.lower() in words

    def maybe(self, *words: str) -> bool:
        if self.here(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.maybe(word):
            raise LogError(f"expected {word}, found {self.peek()[1] or 'the end'}")

    def value(self) -> str:
        kind, text = self.peek()
        if kind not in ("word", "string"):
            raise LogError(f"expected a value, found {text or 'the end'}")
        self.at += 1
        return re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "string" else text

    def either(self) -> Column:
        left = self.both()
        while self.maybe("or"):
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.term()
        while not self.here("or", ")", "|") and self.peek()[0] != "end":
            self.maybe("and")
            left = left & self.term()
        return left

    def term(self) -> Column:
        if self.maybe("not"):
            return ~self.term()
        if self.maybe("("):
            inner = self.either()
            self.need(")")
            return inner
        if self.maybe("*"):
            return F.lit(True)
        kind, text = self.peek()
        after = self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else ("end", "")
        if kind == "word" and text in self.columns and (after[1].lower() == "in" or after[0] == "op" and after[1] in (":", "=", "!=", "<", "<=", ">", ">=")):
            self.at += 1
            return self.field(text)
        return F.coalesce(matches_phrase(F.col(self.content), self.value()), F.lit(False))

    def field(self, name: str) -> Column:
        x = F.col(name)
        if self.maybe("in"):
            low_closed = self.here("[")
            if not self.maybe("(", "["):
                raise LogError("expected a list or a range")
            values = [self.value()]
            listed = False
            while self.maybe(","):
                listed = True
                values.append(self.value())
            if not listed and not self.here(")", "]"):
                values.append(self.value())
            high_closed = self.here("]")
            if not self.maybe(")", "]"):
                raise LogError("expected a closing bracket")
            if listed or len(values) == 1:
                return x.cast("string").isin(values)
            low, high = (F.lit(float(v)) if v not in ("*",) else None for v in values)
            y = x.try_cast("double") if not isinstance(x, str) else x
            out = F.lit(True)
            if low is not None:
                out = out & ((y >= low) if low_closed else (y > low))
            if high is not None:
                out = out & ((y <= high) if high_closed else (y < high))
            return F.coalesce(out, F.lit(False))
        op = self.peek()[1]
        self.at += 1
        value = self.value()
        if op == ":":
            return F.coalesce(matches_phrase(x.cast("string"), value), F.lit(False))
        y, v = (x, F.lit(value)) if op in ("=", "!=") else (x.try_cast("double"), F.lit(float(value)))
        y = y.cast("string") if op in ("=", "!=") else y
        return F.coalesce({"=": y == v, "!=": y != v, "<": y < v, "<=": y <= v, ">": y > v, ">=": y >= v}[op], F.lit(False))


def extracted(frame: DataFrame, column: str, pattern: str, names: list[str]) -> DataFrame:
    """The groups of a pattern as columns, null where it doesn't match; all null
    if it has another number of groups than there are names."""
    groups = re.compile(pattern).groups
    found = F.rlike(F.col(column), F.lit(pattern))
    return frame.withColumns({n: F.when(found, F.regexp_extract(column, pattern, i + 1)) if groups == len(names) else F.lit(None).cast("string") for i, n in enumerate(names)})


def search(frame: DataFrame, text: str, content: str = "content") -> DataFrame:
    """The rows that the conditions leave, with what the pipes extract."""
    parser = Search(text, frame.columns, content)
    out = frame if parser.peek()[0] == "end" or parser.here("|") else frame.where(parser.either())
    while parser.maybe("|"):
        if not parser.maybe("extract"):
            parser.columns = out.columns
            out = out.where(parser.either())
            continue
        parser.need("(")
        column = parser.value()
        parser.need(":")
        pattern = parser.peek()[1][1:-1]
        parser.at += 1
        parser.need(")")
        parser.need("as")
        parser.need("(")
        names = [parser.value()]
        while parser.maybe(","):
            names.append(parser.value())
        parser.need(")")
        out = extracted(out, column, pattern, names)
        parser.columns = out.columns
    if parser.peek()[0] != "end":
        raise LogError(f"unexpected {parser.peek()[1]!r}")
    return out


def context(frame: DataFrame, order: str, at: int, before: int, after: int) -> DataFrame:
    """The lines around a place in the order of a column."""
    earlier = frame.where(F.col(order) < at).orderBy(F.desc(order)).limit(before)
    return earlier.unionByName(frame.where(F.col(order) >= at).orderBy(order).limit(after + 1)).orderBy(order)


def read_log_lines(spark, path: str) -> DataFrame:
    """JSON lines; a line that is none stands whole in ``content``."""
    return spark.read.option("columnNameOfCorruptRecord", "content").json(path)
