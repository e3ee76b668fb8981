"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Texts are compared as words: lower case, ASCII punctuation and white space
between them. Every n-gram of a test item is counted over all training texts.
Those that occur are its seeds: the rarest ``share`` of them, and the others as
well, since an edited copy may hold none but n-grams that exact copies made
common. N-grams that no text holds take no place among them. Where a seed
occurs, the text around it is aligned with the item (Smith-Waterman: +2 for the
same word, -1 for another or a missing one). The score is the best alignment's
over that of the item with itself; from ``threshold`` on, the text is
contaminated. A stretch of text that holds too few of the item's words to reach
the threshold, whatever their order, is not aligned; that loses nothing.

The benchmark goes to every worker in blocks of ``BLOCK_WORDS`` words at most,
each with its own two passes over the texts, so that what is broadcast or held by
the driver is bounded: a block is done before the next one is read.

Defined results: null and empty texts have no words and match nothing, nor do
items of fewer words than a seed; of equally good places the first counts; very
long texts are held one at a time, and only windows around seeds are aligned;
repeated rows of one doc_id give one row for
each item; an empty table on either side gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, tidied

SEED_WORDS, SHARE, THRESHOLD = 3, 0.67, 0.5
BLOCK_WORDS = 2_000_000
_BETWEEN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BETWEEN).split()


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and where it ends in ``text``."""
    place = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(text == word, 2, -1), row[1:] - 1)
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + place) - place, 0)
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


class Seeds:
    """Word numbers and n-gram codes of a block of test items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], n: int):
        self.n = n
        self.number = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        self.base = len(self.number) + 1
        self.items = [(k, np.array([self.number[w] for w in ws], np.int64)) for k, ws in items]
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, codes) in enumerate(self.items):
            for j, g in enumerate(self.coded(codes)):
                self.at[int(g)].append((i, j))
        self.grams = np.array(sorted(self.at), np.int64)

    def coded(self, ids: np.ndarray) -> np.ndarray:
        """A number for each n-gram; below zero where a word is unknown."""
        m = len(ids) - self.n + 1
        if m <= 0:
            return np.empty(0, np.int64)
        code, known = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(self.n):
            code = code * self.base + ids[k : k + m]
            known &= ids[k : k + m] > 0
        return np.where(known, code, -1)

    def found(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text's word numbers, and the places and codes of known n-grams."""
        ws = words(text)
        ids = np.fromiter(map(self.number.get, ws, repeat(0)), np.int64, len(ws))
        codes = self.coded(ids)
        at = np.flatnonzero(codes >= 0)
        if not len(at) or not len(self.grams):
            return ids, at[:0], at[:0]
        spot = np.minimum(np.searchsorted(self.grams, codes[at]), len(self.grams) - 1)
        hit = self.grams[spot] == codes[at]
        return ids, at[hit], codes[at][hit]

    def rank(self, counts: dict[int, int], share: float) -> None:
        """Keep the n-grams that occur; mark the rarest ``share`` of an item's."""
        kept: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
        for i, (_, codes) in enumerate(self.items):
            grams = sorted((counts[int(g)], j, int(g)) for j, g in enumerate(self.coded(codes)) if int(g) in counts)
            rare = -(-int(len(grams) * share * 100) // 100)
            for nth, (_, j, g) in enumerate(grams):
                kept[g].append((i, j, nth < rare))
        self.at, self.grams = kept, np.array(sorted(kept), np.int64)

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
        """item_id, score, first and last word (exclusive) of what matches."""
        ids, places, codes = self.found(text)
        windows: dict[int, list[tuple[int, int, bool]]] = defaultdict(list)
        for p, g in zip(places.tolist(), codes.tolist()):
            for i, j, rare in self.at[g]:
                m = len(self.items[i][1])
                windows[i].append((max(0, p - j - m), min(len(ids), p - j + 2 * m), rare))
        out = []
        for i, spans in windows.items():
            (item, codes_i), best = self.items[i], (0.0, 0, 0)
            merged: list[list] = []
            for a, b, rare in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1:] = max(b, merged[-1][1]), rare or merged[-1][2]
                else:
                    merged.append([a, b, rare])
            # Rare seeds first: what they reach spares the others' alignment.
            for a, b, _ in sorted(merged, key=lambda w: not w[2]):
                most = np.isin(codes_i, ids[a:b]).sum() / len(codes_i)
                if most < max(threshold, best[0]) or (most == best[0] and a > best[1]):
                    continue
                score, end = align(codes_i, ids[a:b])
                score /= 2 * len(codes_i)
                if score > best[0] or (score == best[0] and a < best[1]):
                    best = (score, a, a + end)
            if best[0] >= threshold:
                _, back = align(codes_i[::-1], ids[best[1] : best[2]][::-1])
                out.append((item, best[0], best[2] - back, best[2]))
        return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks of at most so many words (or one larger item); the
    driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").distinct().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        ws = words(text)
        if block and size + len(ws) > block_words:
            yield block
            block, size = [], 0
        block.append((item, ws))
        size += len(ws)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, *, seed_words: int = SEED_WORDS, share: float = SHARE, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of all contaminated pairs.

    Two passes over the texts for each block of items: one counts n-grams, one
    aligns. Only counts and results are shuffled.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = _blocks(benchmark, block_words)
    items = next(blocks, None)
    while items is not None:
        after = next(blocks, None)
        seeds = Seeds(items, seed_words)
        if seeds.base**seed_words >= 1 << 62:
            raise ValueError("a block has too many words for its n-gram codes; lower block_words")
        sent = spark.sparkContext.broadcast(seeds)

        def count(batches, sent=sent):
            total: Counter = Counter()
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    codes, n = np.unique(sent.value.found(text)[2], return_counts=True)
                    total.update(dict(zip(codes.tolist(), n.tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

        counts = dict(rows.mapInArrow(tidied(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect())
        seeds.rank(counts, share)
        ranked = spark.sparkContext.broadcast(seeds)

        def match(batches, ranked=ranked):
            for batch in batches:
                found = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in ranked.value.matches(text, threshold)]
                columns = list(zip(*found)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "end_word"])

        sent.unpersist()
        part = rows.mapInArrow(tidied(match), schema)
        if after is not None or out is not None:  # of several blocks, each is done before the next
            part = cut(part)
            ranked.unpersist()
        out = part if out is None else out.unionByName(part)
        items = after
    if out is None:
        return spark.createDataFrame([], schema)
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"), -F.col("end_word"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that match no item."""
    bad = contaminated(docs, benchmark, **settings).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_bad")), "left_anti")
