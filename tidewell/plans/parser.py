"""Text of the query language to trees. Precedence climbs from OR to unary minus.

Expressions are tuples whose first entry names their kind:

    (num v) (str v) (dur micros) (bool v) (col name) (star kind) (regex pattern)
    (call name args distinct) (bin op a b) (neg a) (not a) (and a b) (or a b)
    (cmp op a b) (in a values-or-query negated) (like a pattern) (case pairs else)
    (cast a type) (now)
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

UNITS = {"ns": 0.001, "u": 1, "µ": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86_400 * 10**6, "w": 7 * 86_400 * 10**6}
_TOKEN = re.compile(
    r"\s*(?:(?P<hint>/\*\+.*?\*/)|(?P<note>--[^\n]*|/\*.*?\*/)|(?P<duration>\d+(?:ns|ms|u|µ|s|m|h|d|w)(?:\d+(?:ns|ms|u|µ|s|m|h|d|w))*\b)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)"
    r"|(?P<string>'(?:[^'\\]|''|\\.)*')|(?P<name>\"[^\"]+\"|[A-Za-z_]\w*)|(?P<op>=~|!~|<=|>=|!=|<>|::|[=<>(),*+/%&|^.;-]))",
    re.S,
)
_REGEX = re.compile(r"\s*/(?!\*)((?:[^/\\\n]|\\.)+)/")
#: Words that end an item where a name could stand.
RESERVED = set("select from where group by fill order limit offset slimit soffset union join inner left right full outer on as and or not in like asc desc into tz with case when then else end except all".split())
COMPARISONS = ("=", "!=", "<>", "<", "<=", ">", ">=", "=~", "!~")


class SqlError(ValueError):
    pass


@dataclass
class Select:
    items: list[tuple[tuple, str | None]] = field(default_factory=list)
    sources: list[tuple] = field(default_factory=list)
    into: str | None = None
    where: tuple | None = None
    every: int | None = None
    offset: int = 0
    by: list[tuple] = field(default_factory=list)
    without: list[str] = field(default_factory=list)
    fill: object = "null"
    filled: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    skip: int = 0
    slimit: int | None = None
    sskip: int = 0
    zone: str | None = None
    hints: tuple[str, ...] = ()


@dataclass
class Union:
    left: object
    right: object
    every_row: bool
    by_name: bool


@dataclass
class With:
    parts: list[tuple[str, object]]
    query: object


def duration(text: str) -> int:
    return int(sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(ns|ms|u|µ|s|m|h|d|w)", text)))


class Parser:
    def __init__(self, text: str):
        self.text, self.place, self.kind, self.value, self.prior, self.hints = text.strip().rstrip(";"), 0, "", "", "", []
        self.advance()

    # Tokens.
    def advance(self) -> None:
        self.prior = self.value if self.kind != "string" else "'"
        while True:
            # A regular expression can only stand after these.
            if self.prior.lower() in ("=~", "!~", "(", ",", "from", "select", "by", "except"):
                if found := _REGEX.match(self.text, self.place):
                    self.kind, self.value, self.place = "regex", found[1].replace(r"\/", "/"), found.end()
                    return
            if self.place >= len(self.text) or not self.text[self.place :].strip():
                self.kind, self.value, self.place = "end", "", len(self.text)
                return
            found = _TOKEN.match(self.text, self.place)
            if not found:
                raise SqlError(f"unexpected text at {self.place}: {self.text[self.place : self.place + 20]!r}")
            self.kind, self.value, self.place = found.lastgroup, found[found.lastgroup], found.end()
            if self.kind == "hint":
                self.hints.append(self.value[3:-2].strip())
            elif self.kind != "note":
                return

    def at(self, *words: str) -> bool:
        return self.kind in ("name", "op") and self.value.lower() in words

    def maybe(self, *words: str) -> bool:
        if self.at(*words):
            self.advance()
            return True
        return False

    def need(self, word: str) -> None:
        if not self.maybe(word):
            raise SqlError(f"expected {word}, found {self.value or 'the end'}")

    def name(self) -> str:
        if self.kind != "name" or self.value.lower() in RESERVED:
            raise SqlError(f"expected a name, found {self.value or 'the end'!r}")
        out = self.value.strip('"')
        self.advance()
        while self.kind == "op" and self.value == ".":
            self.advance()
            if self.kind != "name":
                raise SqlError("expected a name after the dot")
            out += "." + self.value.strip('"')
            self.advance()
        return out

    def number(self) -> int:
        if self.kind != "number" or not self.value.isdigit():
            raise SqlError(f"expected a whole number, found {self.value or 'the end'!r}")
        out = int(self.value)
        self.advance()
        return out

    def end(self):
        if self.kind != "end":
            raise SqlError(f"unexpected {self.value!r}")

    # Queries.
    def query(self):
        if self.maybe("with"):
            parts = []
            while True:
                name = self.name()
                self.need("as")
                self.need("(")
                parts.append((name, self.query()))
                self.need(")")
                if not self.maybe(","):
                    return With(parts, self.query())
        left = self._one()
        while self.maybe("union"):
            every = self.maybe("all")
            by_name = self.maybe("by") and (self.need("name") or True)
            left = Union(left, self._one(), every, by_name)
        return left

    def _one(self):
        if self.maybe("("):
            out = self.query()
            self.need(")")
            return out
        return self.select()

    def select(self) -> Select:
        self.need("select")
        out = Select()
        while True:
            tree = self.expression()
            out.items.append((tree, self.name() if self.maybe("as") else None))
            if not self.maybe(","):
                break
        out.hints, self.hints = tuple(self.hints), []
        if self.maybe("into"):
            out.into = self.name()
        self.need("from")
        out.sources.append(self.source())
        while self.maybe(","):
            out.sources.append(self.source())
        if self.maybe("where"):
            out.where = self.expression()
        if self.maybe("group"):
            self.need("by")
            self.dimensions(out)
        if self.maybe("fill"):
            self.need("(")
            out.filled = True
            out.fill = self.name().lower() if self.kind == "name" else self.literal()
            self.need(")")
        if self.maybe("order"):
            self.need("by")
            while True:
                name = self.name()
                if name in [n for n, _ in out.order]:
                    raise SqlError(f"{name} is sorted by twice")
                out.order.append((name, self.maybe("desc") or (self.maybe("asc") and False)))
                if not self.maybe(","):
                    break
        if self.maybe("limit"):
            out.limit = self.number()
        if self.maybe("offset"):
            out.skip = self.number()
            out.limit = 1 if out.limit is None else out.limit
        if self.maybe("slimit"):
            out.slimit = self.number()
        if self.maybe("soffset"):
            out.sskip = self.number()
        if self.maybe("tz"):
            self.need("(")
            out.zone = self.literal()
            self.need(")")
        return out

    def dimensions(self, out: Select) -> None:
        while True:
            if self.kind == "regex":
                out.by.append(("regex", self.value))
                self.advance()
            elif self.maybe("*"):
                out.by.append(("star",))
            else:
                name = self.name()
                if name.lower() == "time" and self.maybe("("):
                    out.every = self.literal()
                    if self.maybe(","):
                        sign = -1 if self.maybe("-") else 1
                        out.offset = sign * self.literal()
                    self.need(")")
                else:
                    out.by.append(("col", name))
            if not self.maybe(","):
                break
        if self.maybe("except"):
            while True:
                out.without.append(self.name())
                if not self.maybe(","):
                    break

    def source(self):
        left = self._table()
        while True:
            if self.maybe("join"):
                how = "inner"
            elif self.at("inner", "left", "right", "full", "outer"):
                how = self.value.lower()
                self.advance()
                self.maybe("outer")
                self.need("join")
            else:
                return left
            right = self._table()
            self.need("on")
            left = ("join", how, left, right, self.expression())

    def _table(self):
        if self.kind == "regex":
            out = ("tables", self.value)
            self.advance()
            return out
        if self.maybe("("):
            inner = self.query()
            self.need(")")
            return ("query", inner, self._alias())
        name = self.name()
        if self.maybe("("):
            args = []
            while not self.at(")"):
                args.append(self.literal() if self.kind == "string" else self.name())
                self.maybe(",")
            self.need(")")
            return ("function", name.lower(), args, self._alias())
        return ("table", name, self._alias())

    def _alias(self) -> str | None:
        if self.maybe("as"):
            return self.name()
        return self.name() if self.kind == "name" and self.value.lower() not in RESERVED else None

    # Expressions.
    def expression(self) -> tuple:
        left = self._and()
        while self.maybe("or"):
            left = ("or", left, self._and())
        return left

    def _and(self) -> tuple:
        left = self._not()
        while self.maybe("and"):
            left = ("and", left, self._not())
        return left

    def _not(self) -> tuple:
        return ("not", self._not()) if self.maybe("not") else self._comparison()

    def _comparison(self) -> tuple:
        left = self._sum()
        if self.kind == "op" and self.value in COMPARISONS:
            op = self.value
            self.advance()
            if op in ("=~", "!~"):
                if self.kind not in ("regex", "string"):
                    raise SqlError("expected a regular expression")
                pattern = self.value if self.kind == "regex" else self.literal()
                if self.kind == "regex":
                    self.advance()
                return ("cmp", op, left, ("str", pattern))
            return ("cmp", "!=" if op == "<>" else op, left, self._sum())
        negated = self.maybe("not")
        if self.maybe("in"):
            self.need("(")
            if self.at("select", "with", "("):
                values = self.query()
            else:
                values = [self.literal()]
                while self.maybe(","):
                    values.append(self.literal())
            self.need(")")
            return ("in", left, values, negated)
        if self.maybe("like"):
            found = ("like", left, self.literal())
            return ("not", found) if negated else found
        if negated:
            raise SqlError("expected IN or LIKE after NOT")
        return left

    def _sum(self) -> tuple:
        left = self._product()
        while self.at("+", "-", "|", "^"):
            op = self.value
            self.advance()
            left = ("bin", op, left, self._product())
        return left

    def _product(self) -> tuple:
        left = self._unary()
        while self.at("*", "/", "%", "&"):
            op = self.value
            self.advance()
            left = ("bin", op, left, self._unary())
        return left

    def _unary(self) -> tuple:
        if self.maybe("-"):
            return ("neg", self._unary())
        self.maybe("+")
        return self._primary()

    def literal(self):
        kind, text = self.kind, self.value
        if kind == "op" and text == "-":
            self.advance()
            return -self.literal()
        self.advance()
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", text[1:-1].replace("''", "'"))
        if kind == "duration":
            return duration(text)
        if kind == "number":
            return int(text) if text.isdigit() else float(text)
        if kind == "name" and text.lower() in ("true", "false"):
            return text.lower() == "true"
        raise SqlError(f"expected a value, found {text or 'the end'!r}")

    def _primary(self) -> tuple:
        if self.maybe("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.kind == "regex":
            out = ("regex", self.value)
            self.advance()
            return out
        if self.maybe("*"):
            return ("star", self.name().lower() if self.maybe("::") else None)
        if self.kind in ("string", "duration", "number") or self.at("true", "false"):
            kind = {"string": "str", "duration": "dur", "number": "num"}.get(self.kind, "bool")
            return (kind, self.literal())
        if self.maybe("case"):
            pairs, other = [], ("null",)
            if not self.at("when"):
                raise SqlError("only CASE WHEN is known")
            while self.maybe("when"):
                condition = self.expression()
                self.need("then")
                pairs.append((condition, self.expression()))
            if self.maybe("else"):
                other = self.expression()
            self.need("end")
            return ("case", pairs, other)
        name = self.name()
        if self.maybe("::"):
            self.name()
            return ("col", name)
        if not self.maybe("("):
            return ("col", name)
        name = name.lower()
        if name == "cast":
            inner = self.expression()
            self.need("as")
            kind = self.name().lower()
            self.need(")")
            return ("cast", inner, kind)
        args = []
        distinct = name == "count" and self.maybe("distinct")
        if distinct and self.at("("):  # count(distinct(f))
            args.append(self._primary())
        while not self.at(")"):
            args.append(self.expression())
            if not self.maybe(","):
                break
        self.need(")")
        return ("now",) if name == "now" else ("call", name, args, distinct)


def parse(text: str):
    parser = Parser(text)
    out = parser.query()
    parser.end()
    return out
