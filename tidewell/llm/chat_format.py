"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, from a user to an assistant. Dynamic programming over that
automaton finds the cheapest repair: turns are kept, joined to the turn before
(merge), given another role (relabel), or preceded by an empty turn (insert);
nothing is dropped. Ties fall to the earlier of keep, merge, insert and to the
turn's own role.

Two passes over sorted partitions. The first sees roles only: it keeps one byte
for each turn and state of the automaton, and hands the cheapest path on as one
byte for each turn, in chunks. The second has a conversation's chunks before its
turns, and renders the turns as they stream by. So memory is three bytes for each
turn of the longest conversation, whatever its roles and texts are. The result
has one row for each source turn and each inserted turn; ``segment`` in the order
of (seq, part) is the rendered text.

Defined results: turns sort by (turn, role, text), nulls first; an unknown or
null role may take any role at a small cost; a null text is rendered empty; rows
with a null conv_id are one conversation; repeated rows are repeated turns; texts
of any length are passed on one at a time; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import partitions, tidied

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
#: Role that may follow; None: the start.
LEGAL = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: The one empty turn that makes a pair legal, where a pair isn't.
BETWEEN = {(a, b): x for a in LEGAL for b in ROLES for x in ROLES if b not in LEGAL[a] and x in LEGAL[a] and b in LEGAL[x]}
#: Empty turns after the last, to end with an assistant's.
ENDING = {None: (), "system": ("user", "assistant"), "user": ("assistant",), "assistant": ()}
#: Turns whose decisions go into one row.
CHUNK, STEPS = 1 << 16, 512
_STATES, _HOWS = (None, *ROLES), ("keep", "merge", "insert")


def moves(state: str | None, role: str | None) -> Iterator[tuple[int, str, str, str | None]]:
    """Cost, new role, how it joins, and the role of an inserted turn."""
    for to in ROLES:
        cost = 0 if to == role else RELABEL if role in ROLES else UNKNOWN
        if to in LEGAL[state]:
            yield cost, to, "keep", None
        if to == state:
            yield cost + MERGE, to, "merge", None
        if (state, to) in BETWEEN:
            yield cost + INSERT, to, "insert", BETWEEN[state, to]


class Repair:
    """Dynamic programming over the roles of one conversation.

    A step depends on the role and on by how much the states' costs differ; both
    take few values as a rule, so that ``STEPS`` steps at most are remembered.
    """

    steps: dict = {}

    def __init__(self):
        self.least, self.costs, self.back = 0, (0, None, None, None), bytearray()

    def add(self, role: str | None) -> None:
        role = role if role in ROLES else None
        key = (self.costs, role)
        if key not in self.steps:
            best: dict = {}
            for i, so_far in enumerate(self.costs):
                if so_far is None:
                    continue
                for cost, to, how, _ in moves(_STATES[i], role):
                    rank = (so_far + cost, _HOWS.index(how), to != role, i)
                    if to not in best or rank < best[to][0]:
                        best[to] = (rank, 3 * i + _HOWS.index(how))
            least = min(x[0][0] for x in best.values())
            if len(self.steps) >= STEPS:  # costs can drift apart without end
                self.steps.clear()
            self.steps[key] = (least, (None, *(best[r][0][0] - least if r in best else None for r in ROLES)), bytes(best[r][1] if r in best else 0 for r in ROLES))
        least, self.costs, back = self.steps[key]
        self.least += least
        self.back += back

    def end(self) -> tuple[int, bytes]:
        """The least cost, and a byte for each turn: 12 times the new role, plus
        3 times the state before, plus how the turn joins it."""
        cost, i = min((c + INSERT * len(ENDING[s]), i) for i, (c, s) in enumerate(zip(self.costs, _STATES)) if c is not None)
        n = len(self.back) // 3
        out = bytearray(n)
        for k in range(n - 1, -1, -1):
            code = self.back[3 * k + i - 1]
            out[k] = 12 * (i - 1) + code
            i = code // 3
        return self.least + cost, bytes(out)


def decision(code: int) -> tuple[str, str, str | None]:
    """A turn's new role, how it joins, and the role of an inserted turn."""
    role, before, how = ROLES[code // 12], _STATES[code % 12 // 3], _HOWS[code % 3]
    return role, how, BETWEEN[before, role] if how == "insert" else None


class Renderer:
    """Turns decisions into rows, one for each turn or part of a merged turn."""

    def __init__(self, conv):
        self.conv, self.seq, self.part, self.open = conv, -1, 0, False

    def inserted(self, role: str) -> tuple:
        self.seq, self.part = self.seq + 1, 0
        return self.conv, self.seq, 0, None, role, None, "insert", f"{self._closed()}<|{role}|>\n"

    def _closed(self) -> str:
        before, self.open = "<|end|>\n" * self.open, True
        return before

    def turn(self, turn, said: str | None, text: str | None, decision) -> Iterator[tuple]:
        role, how, extra = decision
        if extra:
            yield self.inserted(extra)
        if how == "merge":
            self.part += 1
            yield self.conv, self.seq, self.part, turn, role, said, "merge", f"\n{text or ''}"
        else:
            self.seq, self.part = self.seq + 1, 0
            yield self.conv, self.seq, 0, turn, role, said, "keep" if role == said else "relabel", f"{self._closed()}<|{role}|>\n{text or ''}"

    def end(self, empties: tuple[str, ...]) -> Iterator[tuple]:
        for role in empties:
            yield self.inserted(role)
        if self.open:
            yield self.conv, self.seq, self.part + 1, None, None, None, "end", "<|end|>\n"


def _said(role: str | None) -> str | None:
    return role.strip().lower() if role else role


def rendered(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of (conv_id, codes, turn, role, text), a conversation's codes before
    its turns, to rows of the result."""
    key, render, codes, at = (), None, bytearray(), 0

    def finish():
        yield from render.end(ENDING[ROLES[codes[-1] // 12]] if codes else ())

    for conv, more, turn, role, text in rows:
        if key != (conv,):
            if key:
                yield from finish()
            key, render, codes, at = (conv,), Renderer(conv), bytearray(), 0
        if more is not None:
            codes += more
            continue
        yield from render.turn(turn, _said(role), text, decision(codes[at]))
        at += 1
    if key:
        yield from finish()


def repaired(turns: list[tuple]) -> Iterator[tuple]:
    """Rows of one conversation (conv_id, turn, role, text), sorted, to rows of
    the result."""
    repair = Repair()
    for _, _, role, _ in turns:
        repair.add(_said(role))
    if turns:
        yield from rendered([(turns[0][0], repair.end()[1], None, None, None), *((c, None, t, r, x) for c, t, r, x in turns)])


_OUT = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("part", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("said", pa.string()), ("action", pa.string()), ("segment", pa.string())])


def chat_format(turns: DataFrame) -> DataFrame:
    """conv_id, seq, part, turn, role, said (the role before), action, segment.

    Roles are shuffled by conv_id, then the turns with their decisions; rows of
    one conversation are sorted, then streamed.
    """

    def decide(batches):
        key, repair = (), None

        def chunks():
            codes = repair.end()[1]
            every = [codes[i : i + CHUNK] for i in range(0, len(codes), CHUNK)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(every), pa.int64()), pa.array(range(len(every)), pa.int64()), pa.array(every, pa.binary())], ["conv_id", "turn", "codes"])

        for batch in batches:
            for conv, role in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != (conv,):
                    if key:
                        yield chunks()
                    key, repair = (conv,), Repair()
                repair.add(_said(role))
        if key:
            yield chunks()

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    yield from zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns))

        out, held = [], 0
        for row in rendered(rows()):
            out.append(row)
            held += len(row[-1])
            if len(out) >= 5000 or held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    n = partitions(turns)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    roles = rows.select("conv_id", "turn", "role").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role")
    codes = roles.select("conv_id", "role").mapInArrow(tidied(decide), "conv_id long, turn long, codes binary")
    both = codes.selectExpr("conv_id", "0 as kind", "codes", "turn", "null as role", "null as text").unionByName(rows.selectExpr("conv_id", "1 as kind", "null as codes", "turn", "role", "text"))
    dealt = both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return dealt.select("conv_id", "codes", "turn", "role", "text").mapInArrow(tidied(run), "conv_id long, seq long, part long, turn long, role string, said string, action string, segment string")
