"""Removal of long repeated byte strings with a family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else
as well, in the same text or another. The string that starts at a byte is the
*suffix* there, cut to ``length``.

1. Sampling. Each suffix is filed under the smallest hash among the grams of
   ``GRAM`` bytes that it holds. Equal suffixes are filed alike. Neighbouring
   suffixes that are filed alike make one run, kept as a row of file, digest and
   place: one row for many suffixes.
2. Files with a single row can't hold a match, unless the run repeats its gram.
   Runs with equal digests match as a whole. What is left are runs that share a
   file but differ somewhere, and those that may match themselves.
3. Only for those, the bytes are fetched and dealt out by file. Each task holds
   a logarithmic family of suffix arrays (``SuffixFamily``): every batch of runs
   gets a suffix array, sorted by fingerprints of the suffixes, which is
   merge-scanned against each level; levels of one size class are merged.
4. Matches become spans of the texts, which are cut out.

A run's digest and a suffix's fingerprint are 64-bit hashes that are compared
within one file only.

Within a task, strings come file by file, and a family lives as long as its files
do, so that a task holds ``FAMILY`` bytes of strings or one file's. A file is one
gram: where very many different runs share it, its task sorts them by spilling and
then holds their fingerprints.

Defined results: a null text counts as empty; very long texts are hashed a block
at a time, whose ends overlap; ties do not matter, as all copies of a string go;
texts under ``length`` bytes keep
everything; repeated rows match each other; an empty table gives an empty table;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, partitions, tidied

LENGTH, GRAM = 200, 48
#: Bytes of strings after which a family is given up, once its last file has ended.
FAMILY = 1 << 24
#: Bytes of a text that are hashed at once; the next block overlaps.
BLOCK = 1 << 20
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte value, and the powers of an odd base and of its
    inverse, modulo 2**64."""
    number = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0xD1342543DE82EF95
    size = BLOCK + 2 * 4096
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return number, np.cumprod(up), np.cumprod(down)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    number, up, _ = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(number[data] * up[: len(data)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    """Mixed hashes of the byte strings between places."""
    down = _tables()[2]
    x = (sums[stop] - sums[start]) * (down[start] if isinstance(start, np.ndarray) else down[: len(sums)][start])
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from minima to and from block ends."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def inner_repeats(order: np.ndarray, least: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Whether a run's smallest gram stands at more than one place within it.

    A gram that is the least of some suffix equals the largest of the minima of
    all suffixes that hold it.
    """
    around = np.r_[np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]
    top = ~sliding_min(~around, width)
    places = np.flatnonzero(order == top)
    low, high = np.searchsorted(places, first), np.searchsorted(places, first + size + width - 1)
    count = high - low
    run = np.repeat(np.arange(len(first)), count)
    inside = places[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(run))]
    return np.bincount(run[order[inside] == least[first][run]], minlength=len(first)) > 1


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """File, digest, start, number of suffixes, and whether two of the run's own
    suffixes may be equal, for each run of a text."""
    out = []
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, BLOCK + length - 1), at)
        sums = prefix_sums(part)
        order = hashes(sums, slice(0, len(part) - gram + 1), slice(gram, len(part) + 1))
        least = sliding_min(order, length - gram + 1)
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        size = np.diff(np.r_[new, len(least)])
        most = length - gram + 1
        if size.max() > most:  # a text that repeats itself: no longer runs than others
            pieces = -(-size // most)
            first = np.repeat(new, pieces)
            nth = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            new = first + nth * most
            size = np.diff(np.r_[new, len(least)])
        digest = hashes(sums, new, new + size + length - 1) ^ size.astype(np.uint64)
        out.append((least[new], digest, new + at, size, inner_repeats(order, least, new, size, most)))
    if not out:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out))


class SuffixFamily:
    """Sorted arrays of suffix fingerprints, of geometrically growing sizes.

    ``add`` takes the fingerprints of a batch and their numbers and returns the
    numbers of all suffixes, new or held, that are now known to repeat.
    """

    def __init__(self, least: int = 1 << 12):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.least = least
        self.merges = 0

    def add(self, prints: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        order = np.argsort(prints, kind="stable")
        prints, numbers = prints[order], numbers[order]
        repeats = []
        if len(prints) > 1:
            same = prints[1:] == prints[:-1]
            repeats.append(numbers[np.r_[same, False] | np.r_[False, same]])
            first = np.r_[True, ~same]
            prints, numbers, group = prints[first], numbers[first], np.cumsum(first) - 1
        else:
            group = np.zeros(len(prints), np.int64)
        fresh = np.ones(len(prints), bool)
        for held, names in self.levels:
            if not len(held) or not len(prints):
                continue
            spot = np.minimum(np.searchsorted(held, prints), len(held) - 1)
            met = held[spot] == prints
            repeats += [names[spot[met]], numbers[met]]
            fresh &= ~met
        if fresh.any():
            self.levels.append((prints[fresh], numbers[fresh]))
            while len(self.levels) > 1 and self._rank(-2) <= self._rank(-1):
                (a, i), (b, j) = self.levels.pop(), self.levels.pop()
                both = np.concatenate([a, b])
                order = np.argsort(both, kind="stable")  # two sorted runs: a merge
                self.levels.append((both[order], np.concatenate([i, j])[order]))
                self.merges += 1
        del group
        return np.concatenate(repeats) if repeats else numbers[:0]

    def _rank(self, level: int) -> int:
        return max(0, len(self.levels[level][0]) // self.least).bit_length()


def repeated_in(batches, length: int = LENGTH):
    """For batches of (file, bytes): which suffixes of which row repeat.

    Yields arrays row, start, stop: maximal runs of repeating suffixes, rows
    numbered over all batches.
    """
    family, bounds, marks, rows = SuffixFamily(), [0], [], 0
    for files, strings in batches:
        data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(sizes)
        prints, numbers, total = [], [], bounds[-1]
        at = 0
        while at < len(strings):  # as many strings at once as the tables allow
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            base = int(ends[at - 1]) if at else 0
            sums = prefix_sums(data[base : int(ends[to - 1])])
            count = np.maximum(0, sizes[at:to] - length + 1)
            start = np.repeat(ends[at:to] - sizes[at:to] - base, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            x = hashes(sums, start, start + length) ^ np.repeat(files[at:to], count)
            prints.append((x ^ (x >> np.uint64(31))) * _ODD)
            numbers.append(total + np.arange(len(start)))
            bounds.extend((total + np.cumsum(count)).tolist())
            total += len(start)
            at = to
        rows += len(strings)
        if prints:
            marks.append(family.add(np.concatenate(prints), np.concatenate(numbers)))
    found = np.unique(np.concatenate(marks)) if marks else np.empty(0, np.int64)
    if not len(found):
        return found, found, found
    limits = np.array(bounds)
    row = np.searchsorted(limits, found, "right") - 1
    new = np.flatnonzero(np.r_[True, (found[1:] != found[:-1] + 1) | (row[1:] != row[:-1])])
    last = np.r_[new[1:], len(found)] - 1
    return row[new], found[new] - limits[row[new]], found[last] - limits[row[new]] + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a digest of both to tell rows apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("of", F.xxhash64("doc_id", "text"))


def suffix_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """file, digest, of, start, n, own: the runs of all texts."""

    def run(batches):
        for batch in batches:
            found = [(of, runs(text.encode(), length, gram)) for text, of in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            found = [(of, x) for of, x in found if len(x[0])]
            if found:
                files, digests, starts, sizes, own = (np.concatenate([x[k] for _, x in found]) for k in range(5))
                of = np.repeat(np.array([k for k, _ in found], np.int64), [len(x[0]) for _, x in found])
                yield pa.RecordBatch.from_arrays([_signed(files), _signed(digests), pa.array(of), pa.array(starts.astype(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(own)], ["file", "digest", "of", "start", "n", "own"])

    return _keyed(docs).mapInArrow(tidied(run), "file long, digest long, of long, start long, n int, own boolean")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """of, start, stop: byte spans that are covered by repeated strings."""
    if not 1 <= gram <= length <= 4096:
        raise ValueError("1 <= gram <= length <= 4096")
    file = Window.partitionBy("file")
    near = file.orderBy("digest")
    rows = suffix_runs(docs, length, gram)
    marked = rows.select("*", F.lag("digest").over(near).eqNullSafe(F.col("digest")).alias("again"), F.lead("digest").over(near).eqNullSafe(F.col("digest")).alias("more"), (F.min("digest").over(file) != F.max("digest").over(file)).alias("mixed"))
    kept = cut(marked.where("again or more or mixed or own"))
    whole = kept.where("again or more").select("of", "start", (F.col("start") + F.col("n") + length - 1).alias("stop"))
    unclear = kept.where("(mixed or own and not more) and not again").select("of", "file", "start", "n")
    lists = unclear.groupBy("of").agg(F.collect_list(F.struct("file", "start", "n")).alias("runs"))

    def fetch(batches):
        for batch in batches:
            files, ofs, starts, strings = [], [], [], []
            for text, of, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for x in wanted:
                    files.append(x["file"])
                    ofs.append(of)
                    starts.append(x["start"])
                    strings.append(data[x["start"] : x["start"] + x["n"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(ofs, pa.int64()), pa.array(starts, pa.int64()), pa.array(strings, pa.binary())], ["file", "of", "start", "bytes"])

    texts = _keyed(docs).select("text", "of").join(lists, "of").select("text", "of", "runs")
    strings = texts.mapInArrow(tidied(fetch), "file long, of long, start long, bytes binary").repartition(partitions(docs), "file").sortWithinPartitions("file")

    def scan(batches):
        held, size = [], 0

        def settle():
            of, start = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (1, 2))
            parts = ((b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(3).to_pylist()) for b in held)
            row, a, b = repeated_in(parts, length)
            return pa.RecordBatch.from_arrays([pa.array(of[row]), pa.array(start[row] + a), pa.array(start[row] + b + length - 1)], ["of", "start", "stop"])

        # Rows come file by file: a family is given up once its files have ended.
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                files = part.column(0).to_numpy(zero_copy_only=False)
                if held and size > FAMILY:
                    ended = int(np.searchsorted(files, held[-1].column(0)[-1].as_py(), "right")) if files[0] == held[-1].column(0)[-1].as_py() else 0
                    if ended < part.num_rows:
                        if ended:
                            held.append(part.slice(0, ended))
                        yield settle()
                        held, size, part = [], 0, part.slice(ended)
                held.append(part)
                size += part.nbytes
        if held:
            yield settle()

    return whole.unionByName(strings.mapInArrow(tidied(scan), "of long, start long, stop long"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, with_rest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row.

    ``with_rest`` adds the bytes that are left. Texts are shuffled by their key,
    once to fetch unclear runs and once to cut spans out.
    """
    spans = repeated_spans(docs, length, gram).distinct().groupBy("of").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["rest"] * with_rest]

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                data, kept, at = text.encode(), [], 0
                found = merged([(x["start"], x["stop"]) for x in found or ()])
                for a, b in found:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in found], *[kept] * with_rest))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), *[pa.binary()] * with_rest]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], names)

    joined = _keyed(docs).join(spans, "of", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>" + ", rest binary" * with_rest)
