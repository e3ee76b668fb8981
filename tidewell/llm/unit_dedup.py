"""Substring deduplication by hashed lines and the sentences in them.

A text is cut into units: its lines, and within a line its sentences, so that a
passage that was pasted into a line is found as well. A unit is normalised
(white space to single blanks, lower case) and digested. Over all texts, the
occurrence that ranks first (smallest doc_id, then digest of the text, then
place) stays, and later ones are repeats. A repeat by itself says little if it
is short, so what goes are stretches of neighbouring repeats of ``run_words``
words or more, and whole lines of ``line_words`` or more that consist of
repeats. A stretch goes on from one unit to the next only if the pair of them is
a repeat as well, so that no stretch is stitched from units that repeat in
different places. Spans are offsets of the original text.

Within each batch of rows, all but a digest's first occurrence are known to be
repeats at once; only that first one is compared globally, so that a digest that
a third of all rows hold arrives once for each batch, not for each row. Pairs are
reduced to their first occurrence by a grouped minimum.

Defined results: a null text stays null, an empty one empty, both without units;
rows are known by doc_id and text, so that each text of a doc_id is cut by its
own units only; rows that are equal in both are one document and all lose the
same units; a null doc_id ranks after all others; ties do not occur, as equal
rows are one; very long texts are cut up like others, one at a time; an empty
table gives an empty table; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import fresh, keyed, stored, tidied

RUN_WORDS, LINE_WORDS = 20, 5
_SENTENCE = re.compile(r"[^\s][^.!?\n]*(?:[.!?]+(?!\s|\Z)[^.!?\n]*)*[.!?]*")
_SPANS = "array<struct<start:int,stop:int>>"


def cut_up(text: str | None) -> list[tuple[int, int, str, bool, bool]]:
    """start, stop, normalised unit, whether it begins and ends its line."""
    found = []
    for m in _SENTENCE.finditer(text or ""):
        words = m[0].split()
        stop = m.start() + len(m[0].rstrip())
        found.append((m.start(), stop, words))
    out = []
    for i, (a, b, words) in enumerate(found):
        begins = i == 0 or "\n" in text[found[i - 1][1] : a]
        ends = i == len(found) - 1 or "\n" in text[b : found[i + 1][0]]
        out.append((a, b, words, begins, ends))
    return out


def units(docs: DataFrame) -> DataFrame:
    """_id, _digest, unit (its place), start, stop, words, edge (1: begins its
    line, 2: ends it), h1, h2, known (a repeat for sure), led (has known repeats)
    of each unit."""

    def run(batches):
        for batch in batches:
            owners, place, digests = [], [], []
            for k, text in enumerate(batch.column(2)):
                for i, (a, b, words, begins, ends) in enumerate(cut_up(text.as_py())):
                    owners.append(k)
                    place.append((i, a, b, len(words), begins + 2 * ends))
                    digests.append(xxhash.xxh3_128_digest(" ".join(words).lower().encode()))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            p, owner = np.array(place, np.int32).reshape(-1, 5), np.array(owners, np.int64)
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()[owner]
            digest = batch.column(1).to_numpy(zero_copy_only=False)[owner]
            order = np.lexsort((p[:, 0], digest, ids, h[:, 1], h[:, 0]))
            s, where = h[order], np.column_stack([ids, digest, p[:, 0]])[order]
            first = np.r_[True, (s[1:] != s[:-1]).any(1)][: len(s)]
            leader = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = (where != where[leader]).any(1)  # a repeated row ranks as its first one
            known, led = np.empty(len(s), bool), np.empty(len(s), bool)
            known[order], led[order] = later, ~later & (np.bincount(leader, later, len(s)) > 0)[leader]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(digest), *(pa.array(p[:, k]) for k in range(5)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].astype(np.int32)), pa.array(known), pa.array(led)], ["_id", "_digest", "unit", "start", "stop", "words", "edge", "h1", "h2", "known", "led"])

    rows = keyed(docs).select("_id", F.coalesce("_digest", F.lit(0)).alias("_digest"), "_text")
    return rows.mapInArrow(tidied(run), "_id long, _digest long, unit int, start int, stop int, words int, edge int, h1 long, h2 int, known boolean, led boolean")


def repeats(docs: DataFrame) -> DataFrame:
    """_id, _digest, units (sorted repeats) and apart: the places of units whose
    pair with the next one is no repeat, of the rows with repeats."""
    salt = F.when(F.col("known"), F.hash("_id", "_digest", "unit")).otherwise(0)
    group = Window.partitionBy("h1", "h2", "salt")
    order = (F.col("_id").isNull(), "_id", "_digest", "unit")
    place = ("unit", "start", "stop", "words", "edge")
    ranked = units(docs).withColumn("salt", salt).withColumn("rank", F.rank().over(group.orderBy(*order))).withColumn("n", F.lead("h1").over(group.orderBy(*order)).isNotNull())
    later = F.col("known") | (F.col("rank") > 1)
    shared = ranked.where(later | F.col("led") | F.col("n")).select("_id", "_digest", *place, "h1", later.alias("later"))
    # Of repeated rows, a unit comes once.
    rows = stored(shared.groupBy("_id", "_digest").agg(F.array_sort(F.collect_set(F.struct(*place, "h1", "later"))).alias("units")))
    pair = F.transform(F.sequence(F.lit(1), F.size("units") - 1), lambda i: F.struct(F.get("units", i - 1).alias("a"), F.get("units", i).alias("b")))
    pairs = rows.where(F.size("units") > 1).select("_id", "_digest", F.explode(pair).alias("p")).where("p.b.unit = p.a.unit + 1")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_digest", F.col("p.a.unit").alias("unit"))).alias("f")
    firsts = pairs.groupBy(F.col("p.a.h1").alias("ha"), F.col("p.b.h1").alias("hb")).agg(first).select("f.*")
    apart = firsts.groupBy(F.col("_id").alias("_aid"), F.col("_digest").alias("_adigest")).agg(F.collect_list("unit").alias("apart"))
    gone = rows.select("_id", "_digest", F.filter("units", lambda u: u["later"]).alias("units")).where(F.size("units") > 0)
    return gone.join(apart, F.col("_id").eqNullSafe(F.col("_aid")) & (F.col("_digest") == F.col("_adigest")), "left").select("_id", "_digest", "units", "apart")


def removed(found: list[dict], apart: set[int] = frozenset(), run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> list[dict]:
    """The spans that go, from a document's repeats in their order; after the
    units ``apart`` neither a stretch nor a line goes on."""
    long, stretch, lines, line = [], [], [], []

    def close():
        if sum(u["words"] for u in stretch) >= run_words:
            long.append((stretch[0]["start"], stretch[-1]["stop"]))
        stretch.clear()

    for u in found:
        if stretch and (u["unit"] != stretch[-1]["unit"] + 1 or stretch[-1]["unit"] in apart):
            close()
        stretch.append(u)
        if line and (u["unit"] != line[-1]["unit"] + 1 or line[-1]["unit"] in apart):
            line = []
        line = [u] if u["edge"] & 1 else [*line, u] if line else []
        if line and u["edge"] & 2:
            if sum(x["words"] for x in line) >= line_words:
                lines.append((line[0]["start"], u["stop"]))
            line = []
    close()
    out: list[dict] = []
    for a, b in sorted(long + lines):  # both kinds consist of whole units: they nest or share units
        if out and a < out[-1]["stop"]:
            out[-1]["stop"] = max(b, out[-1]["stop"])
        else:
            out.append({"start": a, "stop": b})
    return out


def without_spans(text: str | None, spans: list[dict]) -> str | None:
    """The text without the spans, each with the white space that follows it up
    to the end of its line; a line that it filled goes with its line break."""
    if text is None or not spans:
        return text
    kept, at = [], 0
    for span in spans:
        a, b = span["start"], span["stop"]
        while b < len(text) and text[b] in " \t":
            b += 1
        if b < len(text) and text[b] == "\n" and (a == 0 or text[a - 1] == "\n"):
            b += 1
        kept.append(text[at:a])
        at = max(at, b)
    return "".join([*kept, text[at:]])


def unit_dedup(docs: DataFrame, *, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` with repeats cut out of text, plus n_removed and removed_spans:
    struct(start, stop) in characters of the original text.

    Units are shuffled once by digest, texts once by their key.
    """
    names = [c for c in docs.columns if c not in ("n_removed", "removed_spans")]
    typed = docs.withColumn("text", F.col("text").cast("string")).select(*(F.col(f"`{c}`") for c in names))
    own = {c: fresh(f"_own_{c}", docs.columns) for c in ("id", "digest", "fid", "fdigest", "units", "apart")}
    found = repeats(docs).select(F.col("_id").alias(own["fid"]), F.col("_digest").alias(own["fdigest"]), F.col("units").alias(own["units"]), F.col("apart").alias(own["apart"]))
    known = typed.select("*", F.col("doc_id").cast("long").alias(own["id"]), F.xxhash64("text").alias(own["digest"]))
    joined = known.join(found, F.col(own["id"]).eqNullSafe(F.col(own["fid"])) & (F.col(own["digest"]) == F.col(own["fdigest"])), "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in names), own["units"], own["apart"])
    place = names.index("text")

    def run(batches):
        for batch in batches:
            texts, every, apart = (batch.column(k).to_pylist() for k in (place, len(names), len(names) + 1))
            spans = [removed(x or [], set(y or ()), run_words, line_words) for x, y in zip(every, apart)]
            cleaned = pa.array([without_spans(t, s) for t, s in zip(texts, spans)], pa.string())
            columns = [cleaned if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], [*names, "n_removed", "removed_spans"])

    schema = ", ".join([*(f"`{c}` {typed.schema[c].dataType.simpleString()}" for c in names), "n_removed long", f"removed_spans {_SPANS}"])
    return joined.mapInArrow(tidied(run), schema)
