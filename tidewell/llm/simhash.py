"""SimHash near-duplicates through a byte-position inverted index.

Fingerprints of 64 bits are eight positional bytes. Two that differ in ``bits``
bits (4 at most) share at least ``8 - bits`` of them; that is the guaranteed
count. A posting list of one byte value would hold 1/256 of all rows and the
pairs to tally would grow with the square of that, so the lists are kept
intersected: for each choice of that many positions, the list of the
fingerprints with the same bytes there (70 lists of 32-bit keys for 4 bits; a
list of n rows is cut to n / 2^32). Within a list the shared positional bytes of
each candidate are tallied, those that reach the guaranteed count are retained,
and links are verified by their differing bits while walking outwards from a
start, each fingerprint being dropped once it is reached: the walk emits a
spanning tree of the list's links, never all its pairs, and keeps every
connection. Equal fingerprints are one entry.

``near_copies`` takes a similarity instead (the Jaccard index of five-word
shingles, 0.8 or more). There 64 bits say too little: a pair at 0.8 differs in
0.15 of the bits. The fingerprint of a text's set of shingles is ``WIDE`` bytes
then, the lists are ``LISTS`` choices of ``SHARED`` positions, each position in
equally many. Texts that share a list and agree in all of ``CARRIED`` bytes' bits
but four deviations more than a pair at the threshold is expected to differ in
are one family, made from spanning trees of the lists, never all their pairs.
By simulation, lists miss 3.3 % of the pairs at 0.8 exactly, 1.8 % at 0.82, 0.4 %
at 0.85, none in 20,000 at 0.9. For these, a last pass has a list for each shingle
of the sets' prefixes (a fifth of a set, rare shingles first), one of which any
two sets at the threshold share. Within a family all sets themselves are compared,
and a spanning tree of the true links is emitted. No list, no family and no group
is capped.

Defined results: a null or blank text has the fingerprint zero and links like
any other; rows are told apart by doc_id and text, repeated rows come back
repeated, with one component; a null doc_id never names a component and ranks
last; very long texts are hashed a stretch of shingles at a time; an empty table
gives an empty table; other columns of the input are ignored or left alone.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, keyed, partitions, tidied
from tidewell.llm.components import component_roots

SHINGLE_WORDS, DIFFERING_BITS, SEED = 4, 4, 42
#: For similarities: words of a shingle, the threshold, bytes of a fingerprint, lists and their positions.
NEAR_WORDS, LEAST, WIDE, LISTS, SHARED = 5, 0.8, 96, 256, 3
#: Lists of the first pass (the second has all others), bytes of a fingerprint that entries of lists carry.
FIRST_LISTS, CARRIED = 32, 16
#: Shingles in a block of a family; a task compares two blocks at once.
PER_BLOCK = 1 << 19
#: About so many texts tell which shingles are frequent: those in so many of them, and how many are held.
SAMPLED, OFTEN, HELD = 4000, 4, 100_000
#: Most keys of texts that are broadcast (24 bytes each).
SENT = 200_000
#: Shingles that are hashed at once, so that very long texts need little memory.
BLOCK = 100_000
#: Odd numbers that make words of a wide fingerprint of a shingle's hash.
_ODD = np.random.default_rng(9).integers(0, 1 << 63, WIDE // 8, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n, ones = len(words) - words_each + 1, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        last = min(n, at + BLOCK)
        hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:last], ends[at + words_each - 1 : last + words_each - 1])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, words_each) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, fp long")


def masks(bits: int) -> list[int]:
    """For each choice of ``8 - bits`` byte positions, the bits there, signed."""
    full = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(8), 8 - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def close(x: np.ndarray, y: np.uint64, bits: int) -> np.ndarray:
    """Which of ``x`` link with ``y``: their shared positional bytes are tallied,
    and the bits of those that reach the guaranteed count are verified."""
    differ = x ^ y
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    out = tally >= 8 - bits
    out[out] = np.bitwise_count(differ[out]) <= bits
    return out


def walk(found: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within ``found`` (distinct)."""
    out, left = [], found
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = close(left, x, bits)
            if near.any():
                reached, left = left[near], left[~near]
                out += [(x, y) for y in reached]
                front.extend(reached)
    return out


def links(fps: DataFrame, bits: int = DIFFERING_BITS) -> DataFrame:
    """Pairs a, b of distinct fingerprints, enough to connect all within ``bits``.

    ``fps`` has distinct values in fp. Lists are streamed in sorted order; one
    list is held at a time, eight bytes for each distinct fingerprint in it.
    """
    if not 0 <= bits <= 7:
        raise ValueError("bits must be 0 to 7")
    lists = ", ".join(f"struct({i} as m, fp & {m}L as key)" if m != -(1 << 63) else f"struct({i} as m, fp & shiftleft(1L, 63) as key)" for i, m in enumerate(masks(bits)))
    # 70 entries are made of each fingerprint: first dealt out, so that all tasks share in it.
    entries = fps.repartition(partitions(fps), "fp").select("fp", F.expr(f"inline(array({lists}))"))

    def run(batches):
        held = np.empty((0,), np.uint64)
        held_key = None

        def pairs(edges):
            a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*edges) if edges else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            m, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            new = np.flatnonzero((m[1:] != m[:-1]) | (key[1:] != key[:-1])) + 1
            begins, ends, edges = np.r_[0, new], np.r_[new, len(fp)], []
            if held_key == (m[0], key[0]):
                held = np.concatenate([held, fp[: ends[0]]])
                begins, ends = begins[1:], ends[1:]
            if len(begins):
                edges += walk(held, bits)
                size = ends - begins
                two = begins[:-1][size[:-1] == 2]
                near = two[close(fp[two] ^ fp[two + 1], np.uint64(0), bits)]
                edges += zip(fp[near], fp[near + 1])
                for a, b in zip(begins[:-1][size[:-1] > 2], ends[:-1][size[:-1] > 2]):
                    edges += walk(fp[a:b], bits)
                held = fp[begins[-1] :].copy()
                held_key = (m[-1], key[-1])
            yield pairs(edges)
        yield pairs(walk(held, bits))

    n = partitions(fps)
    dealt = entries.repartition(n, "m", "key").sortWithinPartitions("m", "key")
    return dealt.mapInArrow(tidied(run), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, *, words_each: int = SHINGLE_WORDS, bits: int = DIFFERING_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the smallest doc_id that a chain of links reaches.
    """
    rows = cut(fingerprints(docs, words_each))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = component_roots(links(distinct.select("fp"), bits), "a", "b")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words_each: int = NEAR_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words_each - 1 :])], np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """A signed number that equal sets share."""
    n = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return n - (1 << 64) if n >> 63 else n


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """The SimHash of a set of hashes, ``WIDE`` bytes."""
    ones = np.zeros(8 * WIDE, np.int64)
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096, None]
        x = (x ^ (x >> np.uint64(32))) * _ODD
        x = (x ^ (x >> np.uint64(29))) * _ODD[::-1]
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def positions(lists: int = LISTS) -> np.ndarray:
    """The byte positions of each list: cut from shuffles of all positions."""
    random, out = np.random.default_rng(SEED), []
    while len(out) < lists:
        order = random.permutation(WIDE)
        out += [order[i : i + SHARED] for i in range(0, WIDE - SHARED + 1, SHARED)]
    return np.array(out[:lists])


def most_bits(least: float, bits: int = 8 * WIDE) -> int:
    """Bits in which a pair of similarity ``least`` differs at most: what is
    expected of two equally large sets, and four deviations more."""
    p = np.arccos(2 * least / (1 + least)) / np.pi
    return int(bits * p + 4 * (bits * p * (1 - p)) ** 0.5)


def _frequent(docs: DataFrame, words_each: int) -> np.ndarray:
    """The ``HELD`` most frequent shingles in ``OFTEN`` or more of about ``SAMPLED``
    texts, from rare to frequent."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(x, words_each).view(np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["shingle"])

    texts = keyed(docs)
    some = texts.where(F.pmod("_digest", F.lit(max(1, texts.count() // SAMPLED))) == 0).dropDuplicates(["_digest"]).select("_text")
    counted = some.mapInArrow(tidied(run), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(HELD)
    return np.array([r[0] for r in sorted(counted.collect(), key=lambda r: (r[1], r[0]))], np.int64).view(np.uint64)


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """So many members of a set, in an order that all sets share, that any two
    sets of similarity ``least`` have one of them in common.

    Those in ``frequent`` (sorted) come last, by ``rank``; whatever it holds
    makes lists short or long, and loses nothing.
    """
    k = len(shingles) - int(np.ceil(least * len(shingles) - 1e-6)) + 1
    if not len(frequent) or not len(shingles):
        return shingles[:k]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    often = frequent[at] == shingles
    last = np.argsort(rank[at[often]])
    return np.concatenate([shingles[~often], shingles[often][last]])[:k]


def _wide(docs: DataFrame, words_each: int, least: float) -> DataFrame:
    """_id, _digest, node, size of its set, fp and prefix of every row."""
    found = _frequent(docs, words_each)
    rank = np.argsort(found)
    frequent = found[rank]

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x, words_each) for x in batch.column(2).to_pylist()]
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_fingerprint(s) for s in sets], pa.binary()), pa.array([prefix(s, frequent, rank, least).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_id", "_digest", "node", "size", "fp", "prefix"])

    return keyed(docs).select("_id", "_digest", "_text").mapInArrow(tidied(run), "_id long, _digest long, node long, size long, fp binary, prefix binary")


def _keys(fp: np.ndarray, chosen: np.ndarray, first: int = 0) -> np.ndarray:
    """The list of each fingerprint (a row of bytes) for each choice of positions."""
    number = first + np.arange(len(chosen), dtype=np.int64)
    return number << 24 | fp[:, chosen[:, 0]].astype(np.int64) << 16 | fp[:, chosen[:, 1]].astype(np.int64) << 8 | fp[:, chosen[:, 2]]


def _loose(nodes: DataFrame, first: int, last: int, least: float) -> DataFrame:
    """Pairs a, b of roots, enough to connect all that share one of these lists
    (or, for none, a shingle of their prefixes) and agree in what entries carry.

    ``nodes`` has size, fp, prefix, root. Rows of a list carry ``CARRIED`` bytes of
    their fingerprints, by which unrelated ones are told apart. A walk emits one
    pair for each root it reaches, so that a list of n roots makes n - 1 at most.
    """
    chosen, most = positions()[first:last], most_bits(least, 8 * CARRIED)

    def enter(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, WIDE)
                words = fp[:, :CARRIED].copy().view(np.int64)
                if len(chosen):
                    key, many = _keys(fp, chosen, first).ravel(), len(chosen)
                else:
                    prefixes = part.column(3).to_pylist()
                    key, many = np.frombuffer(b"".join(prefixes), np.int64), np.array([len(x) // 8 for x in prefixes])
                size, root, *words = (np.repeat(x, many) for x in (part.column(0).to_numpy(zero_copy_only=False).astype(np.int32), part.column(2).to_numpy(zero_copy_only=False), *words.T))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, size, root, *words)], ["key", "size", "root", *names])

    def close_in(x, y, size, words):
        away = np.bitwise_count((words[x] ^ words[y]).view(np.uint64)).sum(-1, dtype=np.int32)
        # A set that is too small can't be similar.
        return (away <= most) & (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]))

    def walk_roots(size, root, words):
        out, left = [], np.arange(len(root))
        while len(left):
            own = root[left] == root[left[0]]
            front, left = [left[own]], left[~own]
            while front and len(left):
                some, most_rows = front.pop(), max(1, min(64, (1 << 20) // len(left)))
                if len(some) > most_rows:
                    front.append(some[most_rows:])
                    some = some[:most_rows]
                near = close_in(some[:, None], left[None], size, words)
                hit = near.any(0)
                if hit.any():
                    reached, at = np.unique(root[left[hit]], return_index=True)
                    out.append((root[some[near[:, hit][:, at].argmax(0)]], reached))
                    now = np.isin(root[left], reached)
                    front.append(left[now])
                    left = left[~now]
        return out

    def run(batches):
        held = None

        def found_in(key, size, root, *words):
            words = np.stack(words, 1)
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[begins[1:], len(key)]
            two = begins[ends - begins == 2]
            two = two[root[two] != root[two + 1]]
            two = two[close_in(two, two + 1, size, words)]
            out = [(root[two], root[two + 1])]
            for a, b in zip(begins[ends - begins > 2], ends[ends - begins > 2]):
                if (root[a:b] != root[a]).any():
                    out += walk_roots(size[a:b], root[a:b], words[a:b])
            a, b = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            # The last list may go on in the next batch.
            last = np.searchsorted(columns[0], columns[0][-1])
            if last:
                yield found_in(*(c[:last] for c in columns))
            held = [c[last:].copy() for c in columns]
        if held is not None:
            yield found_in(*held)

    names = [f"word{i}" for i in range(CARRIED // 8)]
    entered = nodes.select("size", "fp", "root", *([] if len(chosen) else ["prefix"])).mapInArrow(tidied(enter), "key long, size int, root long, " + ", ".join(f"{n} long" for n in names))
    dealt = entered.repartition(partitions(nodes), "key").sortWithinPartitions("key")
    met = dealt.mapInArrow(tidied(run), "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links a, b (places in ``sets``) of Jaccard index ``least`` or more that
    connect whatever such links connect.

    Each set is compared, by the postings of its members, with all sets that the
    walk has not reached yet; the postings are made anew when half are reached.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts, owner = np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(n), sizes)
    reached = np.zeros(n, bool)

    def postings():
        live = ~reached[owner]
        ids = at[live]
        return owner[live][np.argsort(ids, kind="stable")], np.r_[0, np.cumsum(np.bincount(ids, minlength=len(values)))]

    (posts, begin), indexed, left, out = postings(), n, n, []
    for start in range(n):
        if reached[start]:
            continue
        reached[start] = True
        front, left = [start], left - 1
        while front and left:
            if 2 * left <= indexed:
                (posts, begin), indexed = postings(), left
            x = front.pop()
            ids = at[starts[x] : starts[x + 1]]
            low, many = begin[ids], begin[ids + 1] - begin[ids]
            met = posts[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            if 4 * len(met) < n:
                y, both = np.unique(met, return_counts=True)
            else:
                both = np.bincount(met, minlength=n)
                y = np.flatnonzero(both)
                both = both[y]
            y = y[~reached[y] & (both / (sizes[x] + sizes[y] - both) >= least)]
            if len(y):
                reached[y] = True
                left -= len(y)
                out.append((np.full(len(y), x), y))
                front.extend(y.tolist())
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2
    return a, b


def _links_within(nodes: DataFrame, roots: DataFrame, docs: DataFrame, words_each: int, least: float) -> DataFrame:
    """Pairs a, b of nodes of one root, enough to connect all whose sets are
    similar enough.

    The sets of a family (the nodes of a root) meet in one task. A family of more
    than ``PER_BLOCK`` shingles is dealt into blocks, each of which meets each
    other one, so that all pairs are compared and a task holds two blocks.
    """
    sized = nodes.join(roots.hint("merge"), "node")
    families = sized.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / PER_BLOCK).alias("blocks")).where("n > 1").drop("n")
    wanted = cut(sized.join(families.hint("merge"), "root").select(F.col("_id").alias("_wid"), F.col("_digest").alias("_wdigest"), "node", "root", "blocks"))
    # Keys that are counted and few go to the texts; else the texts are shuffled to them.
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted.hint("merge")

    def to_sets(batches):
        for batch in batches:
            sets = [shingle_set(x, words_each).tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["node", "root", "blocks", "shingles"])

    def run(batches):
        held, nodes, sets = None, [], []

        def found():
            a, b = alike(sets, least) if len(sets) > 1 else (np.empty(0, np.int64),) * 2
            at = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at[a], pa.int64()), pa.array(at[b], pa.int64())], ["a", "b"])

        for batch in batches:
            for root, pair, node, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (root, pair):
                    if len(sets) > 1:
                        yield found()
                    held, nodes, sets = (root, pair), [], []
                # Repeated rows are one node.
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(shingles, np.uint64))
        yield found()

    texts = keyed(docs).join(wanted, F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_digest") == F.col("_wdigest"))).select("node", "root", "blocks", "_text")
    sets = texts.mapInArrow(tidied(to_sets), "node long, root long, blocks long, shingles binary").withColumn("mine", F.expr("pmod(xxhash64(node), blocks)"))
    meeting = F.expr("explode(if(blocks = 1, array(0L), transform(filter(sequence(0L, blocks - 1), j -> j <> mine), j -> least(j, mine) * blocks + greatest(j, mine))))")
    dealt = sets.select("root", meeting.alias("pair"), "node", "shingles").repartition(partitions(docs), "root", "pair").sortWithinPartitions("root", "pair", "node")
    return dealt.mapInArrow(tidied(run), "a long, b long")


def near_copies(docs: DataFrame, *, words_each: int = NEAR_WORDS, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _digest, node) and node, root of texts that chains of links of
    similarity ``least`` or more connect; texts without words are copies.

    Lists connect what may be similar to families, in passes: a few lists first,
    so that large groups are mostly one root when all others follow, and prefixes
    of the sets last, for what no list holds together. The sets of each family
    are then compared, and its true links connected.
    """
    rows = cut(_wide(docs, words_each, least))
    first = F.struct(F.col("_id").isNull(), "_id", "_digest")
    nodes = cut(rows.groupBy("node").agg(F.min(first).alias("r"), *(F.first(c).alias(c) for c in ("size", "fp", "prefix"))).select("node", "size", "fp", "prefix", "r._id", "r._digest"))
    roots = nodes.select("node", F.col("node").alias("root"))

    def joined(roots, edges):
        step = component_roots(edges, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("to"))
        return cut(roots.join(step.hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))

    for begin, end in ((0, FIRST_LISTS), (FIRST_LISTS, LISTS), (LISTS, LISTS)):
        rooted = nodes.where("size > 0").join(roots.hint("merge"), "node")
        roots = joined(roots, _loose(rooted, begin, end, least))
    links = _links_within(nodes, roots, docs, words_each, least)
    return rows.select("_id", "_digest", "node"), joined(nodes.select("node", F.col("node").alias("root")), links)


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (of equal
    ones, the smallest digest of the text; null ids last); of repeated rows one."""
    rows, roots = near_copies(docs, **settings)
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_digest")).alias("r")
    counted = rows.groupBy("_id", "_digest", "node").agg(F.count("*").alias("n"))
    firsts = counted.join(roots, "node").groupBy("root").agg(first).select(F.col("r._id").alias("_kid"), F.col("r._digest").alias("_kdigest"))
    keep = cut(firsts.join(counted, F.col("_kid").eqNullSafe(F.col("_id")) & (F.col("_kdigest") == F.col("_digest"))).select("_kid", "_kdigest", "n"))
    of = lambda rows, keys: rows.join(keys, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_digest") == F.col("_kdigest")), "left_semi")
    known = keyed(docs, every=True)
    once, more = of(known, keep.where("n = 1")), of(known, keep.where("n > 1")).dropDuplicates(["_id", "_digest"])
    return once.select(docs.columns).unionByName(more.select(docs.columns))
