"""Token counts with overlap resynchronisation for huge documents.

A text over ``chunk_chars`` characters is encoded as overlapping chunks. Each
chunk lists the offsets at which the tokenizer's words start, with the tokens
up to there. Chunks are spliced at an offset that is a word start in both and
far enough from either end; from a common word start on, the rest of both
encodings must agree, as the word pattern looks at most one character ahead.
If the overlap holds no such offset, it is doubled, if need be past the start
of the chunk before, which then grows instead.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
give repeated rows; an empty table gives an empty table; other columns of the
input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import pieces

#: Remembered words in a Python worker; the memory for them stays bounded.
MEMO = 400_000
#: Pieces without a blank that are longer than this list their inner words.
LONG_PIECE = 512


class Counts(dict):
    """Tokens of ``prefix + key``, from the library, remembered."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, key: str) -> int:
        n = len(self.encode(self.prefix + key, add_special_tokens=False))
        if len(key) <= LONG_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[key] = n
        return n


class ChunkCounter:
    """Counts tokens of whole texts, by chunks where they are long."""

    def __init__(self, tokenizer, chunk_chars: int = 32_768, overlap_chars: int = 512):
        if chunk_chars < 64 or overlap_chars < 1:
            raise ValueError("chunk_chars must be 64 at least, overlap_chars 1")
        self.first, self.rest = Counts(tokenizer.encode, ""), Counts(tokenizer.encode, " ")
        self.pre = tokenizer.pre_tokenizer
        self.special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self.margin = 2 + max(map(len, self.special), default=0)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.widened = 0

    def count(self, text: str) -> int:
        if len(text) > self.chunk:
            return self._spliced(text)
        if not text:
            return 0
        first, *rest = pieces(text)
        return self.first[first] + sum(map(self.rest.__getitem__, rest))

    def words(self, text: str) -> Iterator[tuple[int, str]]:
        """Starts and texts of the tokenizer's words; special tokens are words."""
        at = 0
        while text:
            found = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=(len(text), ""))
            plain = text[: found[0]]
            for _, (a, b) in self.pre.pre_tokenize_str(plain) if plain else ():
                yield at + a, plain[a:b]
            if found[1]:
                yield at + found[0], found[1]
            step = found[0] + len(found[1])
            at, text = at + step, text[step:]

    def starts(self, text: str) -> tuple[list[int], list[int], int]:
        """Word starts, tokens before each, and all tokens of a chunk."""
        at, before, offset, total = [], [], 0, 0
        for i, piece in enumerate(pieces(text)):
            known = self.rest if i else self.first
            if len(piece) <= LONG_PIECE:
                at.append(offset)
                before.append(total)
                total += known[piece]
            else:
                for a, word in self.words(" " * (i > 0) + piece):
                    at.append(offset + a)
                    before.append(total)
                    total += self.first[word]
            offset += len(piece) + (i > 0)
        return at, before, total

    def _spliced(self, text: str) -> int:
        size, chunk = len(text), self.chunk
        start, end = 0, min(size, chunk)
        at, before, total = self.starts(text[start:end])
        since, result = 0, 0
        while end < size:
            overlap, splice = self.overlap, None
            while splice is None and overlap < end - start:
                b0 = end - overlap
                b_end = min(size, b0 + max(chunk, 2 * overlap))
                b_at, b_before, b_total = self.starts(text[b0:b_end])
                mine = {p + start: n for p, n in zip(at, before) if b0 + self.margin <= p + start <= end - self.margin and p + start > since}
                splice = max((p + b0 for p in b_at if p + b0 in mine), default=None)
                if splice is None:
                    self.widened += 1
                    overlap *= 2
            if splice is None:  # no common word start at all: one larger chunk
                self.widened += 1
                end = min(size, end + max(chunk, end - start))
                at, before, total = self.starts(text[start:end])
                continue
            result += mine[splice] - (before[bisect_left(at, since - start)])
            start, end, since = b0, b_end, splice
            at, before, total = b_at, b_before, b_total
        return result + total - before[bisect_left(at, since - start)]


_COUNTERS: dict = {}


def _counter(data: bytes, chunk: int, overlap: int) -> ChunkCounter:
    key = (hash(data), chunk, overlap)
    if key not in _COUNTERS:
        from tokenizers import Tokenizer

        _COUNTERS.clear()
        _COUNTERS[key] = ChunkCounter(Tokenizer.from_buffer(data), chunk, overlap)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer_path: str, *, over: int = 1024, chunk_chars: int = 32_768, overlap_chars: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chars of every whole text.

    No shuffle: one pass of the text through Python. The tokenizer's file (a
    few MB, read on the driver) is broadcast.
    """
    with open(tokenizer_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = _counter(data.value, chunk_chars, overlap_chars)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > over)
