"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the corpus are counted over all texts. The most frequent ones (a
bounded number) are encoded once and compiled, from sorted order, into a
minimal automaton with shared suffixes: the numbers on the arcs of a path add
up to the word's rank, which leads to its token ids. Workers memory-map the
compiled file. Words that it lacks are merged exactly, pair by pair, by rank.

Texts are handled as bytes, a block at a time. A block is cut into words by the
classes of its bytes; what holds other than Latin letters is cut at blanks, and
the tokenizer's own pattern cuts on. Equal words are found by a 64-bit hash, and
only new ones are looked up. The ids are then decoded and compared with the text,
byte by byte; where they differ (two words of one hash), the text is encoded
again word by word, so that no result rests on a hash.

Defined results: a null or empty text gives no ids, and the digests of nothing;
a very long text is cut at blanks into parts, whose ids follow each other, so
that memory does not grow with it; ties of merges fall to the leftmost pair;
repeated rows give repeated rows; an empty table gives an empty table; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, tidied

#: Most words in the lexicon and most bytes of one: its size is bounded by both.
LEXICON_WORDS, WORD_BYTES = 50_000, 48
#: Distinct words that a worker remembers or counts before it forgets or hands on.
REMEMBERED, GATHERED = 1 << 19, 1 << 18
#: Bytes of a word that is remembered, of a block of texts, of a word that is merged with others.
LONG_PIECE, BLOCK, TOGETHER, NONE = 96, 1 << 20, 40, 1 << 30
#: Texts of Latin letters, ASCII and its blanks are cut by a pattern, as the tokenizer would.
_LATIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*").fullmatch
_WORDS = re.compile("'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\\s+(?!\\S)|\\s+").findall
_RANDOM = np.random.default_rng(10)
_NUMBER = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHT = _RANDOM.integers(0, 1 << 63, LONG_PIECE, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are or may begin white space, and second bytes of those that do.
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_MAYBE = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: characters to bytes."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """A compiled lexicon over a buffer, a memory-mapped file as a rule."""

    HEAD = struct.Struct("<4I")

    def __init__(self, buffer):
        self.buffer = buffer
        states, arcs, words, ids = self.HEAD.unpack_from(buffer, 0)
        view, at = memoryview(buffer), self.HEAD.size

        def ints(n):
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("I")

        self.first, self.target, self.adds, self.spans, self.ids = ints(states + 1), ints(arcs), ints(arcs), ints(words + 1), ints(ids)
        self.final, self.labels = at, at + states
        self.words, self.states, self.all_ids = words, states, np.asarray(self.ids)
        self.arcs = np.repeat(np.arange(states, dtype=np.int64) << 8, np.diff(np.asarray(self.first)))
        self.arcs |= np.frombuffer(buffer, np.uint8, arcs, self.labels)

    def rank(self, word: bytes) -> int:
        """The word's place in sorted order, or -1."""
        buffer, first, labels, state, total = self.buffer, self.first, self.labels, 0, 0
        for i in range(len(word)):
            arc = buffer.find(word[i : i + 1], labels + first[state], labels + first[state + 1]) - labels
            if arc < 0:
                return -1
            total += self.adds[arc]
            state = self.target[arc]
        return total if buffer[self.final + state] in (1, b"\x01") else -1

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers."""
        if (rank := self.rank(word)) < 0:
            return None
        return self.at(rank)

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """``rank`` of each row of a matrix of bytes: all walk at the same pace."""
        out, row = np.full(len(words), -1), np.arange(len(words))
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        target, adds = np.asarray(self.target), np.asarray(self.adds)
        for column in words.T:
            if not len(row) or not len(self.arcs):
                return out
            key = state << 8 | column[row]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            there = self.arcs[arc] == key
            row, arc, total = row[there], arc[there], total[there]
            total, state = total + adds[arc], target[arc].astype(np.int64)
        ends = np.frombuffer(self.buffer, np.uint8, self.states, self.final)[state] == 1
        out[row[ends]] = total[ends]
        return out

    def spans_of(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words' ids begin and end in ``all_ids``."""
        spans = np.asarray(self.spans)
        return spans[ranks].astype(np.int64), spans[ranks + 1].astype(np.int64)

    def at(self, rank: int) -> bytes:
        return self.ids[self.spans[rank] : self.spans[rank + 1]].tobytes()


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Words and ids as a minimal automaton, built in one pass over the words."""
    children: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path, before = [0], b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state, parent = path.pop(), path[-1]
            key = (final[state], *children[state].items())
            children[parent][before[len(path) - 1]] = known.setdefault(key, state)

    for word in sorted(entries):
        same = next((i for i, (a, b) in enumerate(zip(word, before)) if a != b), min(len(word), len(before)))
        settle(same)
        for byte in word[same:]:
            children.append({})
            final.append(False)
            children[path[-1]][byte] = len(children) - 1
            path.append(len(children) - 1)
        final[path[-1]] = True
        before = word
    settle(0)

    order, number = [0], {0: 0}
    for state in order:
        for child in children[state].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
    below: dict[int, int] = {}

    def count(root: int) -> None:
        todo = [root]
        while todo:
            state = todo[-1]
            if state in below:
                todo.pop()
            elif missing := [c for c in children[state].values() if c not in below]:
                todo += missing
            else:
                below[state] = final[state] + sum(below[c] for c in children[state].values())
                todo.pop()

    count(0)
    first, target, adds, labels = array("I", [0]), array("I"), array("I"), bytearray()
    for state in order:
        passed = int(final[state])
        for byte, child in sorted(children[state].items()):
            labels.append(byte)
            target.append(number[child])
            adds.append(passed)
            passed += below[child]
        first.append(len(labels))
    spans, ids = array("I", [0]), array("I")
    for word in sorted(entries):
        ids.extend(entries[word])
        spans.append(len(ids))
    head = Transducer.HEAD.pack(len(order), len(labels), len(entries), len(ids))
    return head + b"".join(x.tobytes() for x in (first, target, adds, spans, ids)) + bytes(final[s] for s in order) + bytes(labels)


class Merger:
    """Exact byte-pair merges by rank, and the bytes of each id."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        model = json.loads(data)
        to_byte = byte_characters()
        as_bytes = lambda token: bytes(map(to_byte.__getitem__, token))
        vocab = model["model"]["vocab"]
        self.ids = {as_bytes(t): i for t, i in vocab.items()}
        pairs = [tuple(map(as_bytes, m if isinstance(m, list) else m.split(" "))) for m in model["model"]["merges"]]
        self.single = [self.ids[bytes([i])] for i in range(256)]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.special_bytes = [s.encode() for s in self.special]
        self.find_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        self.table = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pre = Tokenizer.from_buffer(data).pre_tokenizer
        self.singles = np.array(self.single, np.int64)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        self.order = np.argsort(keys)
        self.keys, self.products = keys[self.order], np.array([*self.merged, NONE], np.int64)

    def merge(self, word: bytes) -> list[int]:
        """The pair of lowest rank, leftmost first, until none is left."""
        ids, rank, merged = list(map(self.single.__getitem__, word)), self.ranks.get, self.merged
        if len(ids) > 256:
            return self._merge_long(ids)
        near = [rank(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while near:
            best = min(near)
            if best == NONE:
                break
            i = near.index(best)
            ids[i] = merged[best]
            del ids[i + 1], near[i]
            if i:
                near[i - 1] = rank(ids[i - 1] << 32 | ids[i], NONE)
            if i < len(near):
                near[i] = rank(ids[i] << 32 | ids[i + 1], NONE)
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge_many(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``merge`` of each row of a matrix of bytes: numbers of rows that end
        with equally many ids, and those ids.

        Each round makes one merge in every row that has one left, so that the
        rows still at work are always of one length.
        """
        out, row = [], np.arange(len(words))
        ids = self.singles[words]
        near = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(row):
            if near.shape[1]:
                best = near.argmin(1)
                rank = near[np.arange(len(row)), best]
            else:
                rank = np.full(len(row), NONE)
            done = rank == NONE
            if done.any():
                out.append((row[done], ids[done]))
                left = ~done
                if not left.any():
                    break
                row, ids, near, best, rank = row[left], ids[left], near[left], best[left], rank[left]
            n, length = ids.shape
            ids[np.arange(n), best] = self.products[rank]
            ids = ids[np.arange(length) != best[:, None] + 1].reshape(n, length - 1)
            near = near[np.arange(length - 1) != best[:, None]].reshape(n, length - 2)
            for side in (best - 1, best):
                there = np.flatnonzero((side >= 0) & (side < length - 2))
                at = side[there]
                near[there, at] = self._ranks(ids[there, at], ids[there, at + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap, for words without an end in sight."""
        import heapq

        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merged[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := ranks.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [k for k, x in zip(ids, alive) if x]

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        if _LATIN(text) and not self.find_special(text):
            return _WORDS(text)
        out = []
        while text:
            at, special = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=(len(text), ""))
            if at:
                out += [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text[:at])]
            if special:
                out.append(special)
            text = text[at + len(special) :]
        return out


#: Letters, digits, other signs, white space, and bytes that the tokenizer's own pattern is asked about.
_LETTER, _DIGIT, _SIGN, _WHITE, _OTHER = range(5)
_CLASS = np.array([_DIGIT if chr(b) in "0123456789" else _LETTER if chr(b).isalpha() and b < 0x80 or b == 0xC3 else _SIGN if 0x21 <= b < 0x7F else _WHITE if b in (9, 10, 13, 32) else _OTHER for b in range(256)], np.uint8)


def piece_starts(data: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Where a block can be cut whatever it holds: at the texts' starts, and at
    each blank that stands before a character that is no white space.

    Byte-level BPE never merges across such a cut: white space before the blank
    ends as a word of its own kind, and the blank goes with the next word.
    """
    fine = data == 0x20
    fine[:-1] &= ~_SPACE[data[1:]] & ~opens[1:]
    fine[-1] = False
    for lead, second in _MAYBE.items():
        for i in np.flatnonzero(fine[:-1] & (data[1:] == lead)):
            fine[i] = int(data[i + 2]) not in second
    return np.flatnonzero(fine | opens)


def word_starts(data: np.ndarray, texts: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a block begin, and which are still to be cut.

    A word is a run of letters, digits or other signs with the blank before it;
    of white space before a word, the last character is apart.
    """
    n = len(data)
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    kind[lead + 1] = _LETTER
    signs = lead[np.isin(data[lead + 1], (0x97, 0xB7))]
    kind[signs] = kind[signs + 1] = _SIGN
    if special:
        raw = data.tobytes()
        for s in special:
            at = raw.find(s)
            while at >= 0:
                kind[at : at + len(s)] = _OTHER
                at = raw.find(s, at + 1)
    opens = np.zeros(n + 1, bool)
    opens[texts] = True
    opens[n] = True
    first = opens[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    white = kind == _WHITE
    ends = np.flatnonzero(white & np.append(first[1:], True) & ~opens[1:])  # the last of white space before a word
    first[ends] = True
    first[ends[data[ends] == 0x20] + 1] = False
    for i in np.flatnonzero(first & (data == 0x27)).tolist():
        if i + 1 < n and first[i + 1] and not opens[i + 1]:
            after = data[i + 1 : i + 3].tobytes()
            size = 2 if after[:1] in (b"s", b"t", b"m", b"d") else 3 if after in (b"re", b"ve", b"ll") and not opens[i + 2] else 0
            if size:
                first[i + 1] = False
                if i + size < n:
                    first[i + size] = True
    other = np.flatnonzero(kind == _OTHER)
    if not len(other):
        starts = np.flatnonzero(first)
        return starts, np.zeros(len(starts), bool)
    pieces = piece_starts(data, opens[:n])
    ends, whole = np.append(pieces[1:], n), np.zeros(n, bool)
    for k in np.unique(np.searchsorted(pieces, other, "right") - 1).tolist():
        first[pieces[k] : ends[k]] = False
        first[pieces[k]] = whole[pieces[k]] = True
    starts = np.flatnonzero(first)
    return starts, whole[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a block."""
    place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    summands = _NUMBER[data]
    summands *= _WEIGHT[np.minimum(place, LONG_PIECE - 1)]
    out = np.add.reduceat(summands, starts)
    for i in np.flatnonzero(sizes > LONG_PIECE):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return (out ^ (out >> np.uint64(32))) * _NUMBER[0]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, where each stands first, and which each one is."""
    order = np.argsort(hashes, kind="stable")
    there = hashes[order]
    new = np.r_[True, there[1:] != there[:-1]]
    of = np.empty(len(hashes), np.int64)
    of[order] = np.cumsum(new) - 1
    return there[new], order[new], of


class Numbers:
    """A sorted array of hashes with a number for each."""

    def __init__(self):
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of hashes, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == hashes, self.numbers[spot], -1)

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """``hashes`` are sorted and new."""
        spot = np.searchsorted(self.hashes, hashes)
        self.hashes, self.numbers = np.insert(self.hashes, spot, hashes), np.insert(self.numbers, spot, numbers)


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Ids of whole texts: remembered pieces, then the lexicon, then merges."""

    def __init__(self, data: bytes, lexicon: bytes):
        self.merger = Merger(data)
        self.file = tempfile.TemporaryFile()
        self.file.write(lexicon)
        self.file.flush()
        self.lexicon = Transducer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ))
        table = self.merger.table
        size = np.zeros(max(table) + 1, np.int64)
        size[list(table)] = [len(t) for t in table.values()]
        self.token_size, self.token_start = size, np.cumsum(size) - size
        self.tokens = np.frombuffer(b"".join(table[i] for i in sorted(table)), np.uint8)
        self.hits = self.misses = 0
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.size = Numbers(), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def word_ids(self, word: str) -> bytes:
        """Ids of one word, special tokens included."""
        if word in self.merger.special:
            return struct.pack("<I", self.merger.special[word])
        key = word.encode()
        if len(key) <= WORD_BYTES and (ids := self.lexicon.get(key)) is not None:
            self.hits += 1
            return ids
        self.misses += 1
        return np.array(self.merger.merge(key), np.uint32).tobytes()

    def learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the given words, in what order; how many ids each; the ids."""
        order, counts, flat = [], [], []
        plain = ~whole & (sizes <= TOGETHER)
        for size in np.unique(sizes[plain]).tolist():
            group = np.flatnonzero(plain & (sizes == size))
            matrix = data[starts[group][:, None] + np.arange(size)]
            ranks = self.lexicon.ranks(matrix)
            there = ranks >= 0
            if there.any():
                a, b = self.lexicon.spans_of(ranks[there])
                order.append(group[there])
                counts.append(b - a)
                flat.append(gathered(self.lexicon.all_ids, a, b - a))
            for rows, ids in self.merger.merge_many(matrix[~there]):
                order.append(group[~there][rows])
                counts.append(np.full(len(rows), ids.shape[1]))
                flat.append(ids.astype(np.uint32).ravel())
            self.hits += int(there.sum())
            self.misses += int((~there).sum())
        for i in np.flatnonzero(~plain).tolist():
            piece = data[starts[i] : starts[i] + sizes[i]].tobytes()
            ids = self.encode_text(piece.decode()) if whole[i] else np.array(self.merger.merge(piece), np.uint32).tobytes()
            order.append(np.array([i]))
            counts.append(np.array([len(ids) // 4]))
            flat.append(np.frombuffer(ids, np.uint32))
        return np.concatenate(order), np.concatenate(counts), np.concatenate(flat)

    def encode_block(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block, and where each text's begin. ``texts`` has the
        texts' starts and, last, the block's end."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.known.hashes) > REMEMBERED:
            self._forget()
        starts, whole = word_starts(data, texts[:-1], self.merger.special_bytes)
        sizes = np.diff(np.append(starts, len(data)))
        hashes, first, of = distinct(word_hashes(data, starts, sizes))
        number = self.known.find(hashes)
        new = np.flatnonzero(number < 0)
        used, held = self.used, len(self.start)
        if len(new):
            long = sizes[first[new]] > LONG_PIECE
            for some, stays in ((new[~long], True), (new[long], False)):
                if not len(some):
                    continue
                at = first[some]
                order, size, flat = self.learn(data, starts[at], sizes[at], whole[at])
                if self.used + len(flat) > len(self.pool):
                    grown = np.empty(2 * (self.used + len(flat)), np.uint32)
                    grown[: self.used] = self.pool[: self.used]
                    self.pool = grown
                self.pool[self.used : self.used + len(flat)] = flat
                number[some[order]] = len(self.start) + np.arange(len(some))
                self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
                self.size = np.concatenate([self.size, size])
                self.used += len(flat)
                if stays:  # long ones come last and are forgotten again
                    used, held = self.used, len(self.start)
                    self.known.add(hashes[some], number[some])
        size = self.size[number][of]
        out = gathered(self.pool, self.start[number][of], size)
        self.used, self.start, self.size = used, self.start[:held], self.size[:held]
        return out, np.append(0, np.cumsum(size))[np.searchsorted(starts, texts)]

    def decode_block(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return gathered(self.tokens, self.token_start[ids], self.token_size[ids])

    def encode_text(self, text: str) -> bytes:
        """Ids of one text, word by word."""
        words = self.merger.words(text)
        known = {w: self.word_ids(w) for w in set(words)}
        return b"".join([known[w] for w in words])

    def encode(self, text: str) -> bytes:
        data = np.frombuffer(text.encode(), np.uint8)
        ids = self.encode_block(data, np.array([0, len(data)]))[0]
        return ids.tobytes() if np.array_equal(self.decode_block(ids), data) else self.encode_text(text)

    def decode(self, ids: bytes) -> str:
        return self.decode_block(np.frombuffer(ids, np.uint32)).tobytes().decode("utf-8", "replace")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts (null: none) and their bounds, uncopied."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), bounds


def parts(data: np.ndarray, start: int, stop: int, size: int = BLOCK) -> list[tuple[int, int]]:
    """A long text's bounds, cut at blanks before printable ASCII."""
    out = []
    while stop - start > size:
        at = None
        for low in (start + size // 2, start + 1):
            for high in range(start + size, stop + size, size):
                near = data[low : min(high, stop)]
                found = np.flatnonzero((near[:-1] == 0x20) & (near[1:] > 0x20) & (near[1:] < 0x7F))
                if len(found):
                    at = low + int(found[-1] if high == start + size else found[0])
                    break
            if at is not None:
                break
        if at is None:
            break
        out.append((start, at))
        start = at
    return [*out, (start, stop)]


def in_blocks(data: np.ndarray, bounds: np.ndarray):
    """Rows of a block and the bounds of what it holds of them: neighbouring
    short texts, or a part of a long one; last: whether the text ends there."""
    i, n = 0, len(bounds) - 1
    while i < n:
        if bounds[i + 1] - bounds[i] > BLOCK:
            cuts = parts(data, int(bounds[i]), int(bounds[i + 1]))
            for k, (a, b) in enumerate(cuts):
                yield i, i + 1, np.array([a, b]), k == len(cuts) - 1
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1)
        yield i, j, bounds[i : j + 1], True
        i = j


_CACHE: dict = {}


def _cached(key, make):
    if key not in _CACHE:
        for old in [k for k in _CACHE if k[0] == key[0]]:
            del _CACHE[old]
        _CACHE[key] = make()
    return _CACHE[key]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


class WordCounts:
    """How often each distinct word stood in the blocks so far."""

    def __init__(self):
        self.known, self.counts, self.words = Numbers(), np.empty(0, np.int64), []

    def add(self, data: np.ndarray, texts: np.ndarray, merger: Merger) -> None:
        if not len(data):
            return
        starts, whole = word_starts(data, texts[:-1], merger.special_bytes)
        sizes = np.diff(np.append(starts, len(data)))
        hashes, first, of = distinct(word_hashes(data, starts, sizes))
        n, number = np.bincount(of), self.known.find(hashes)
        met = number >= 0
        self.counts[number[met]] += n[met]
        fresh, n, hashes = first[~met], n[~met], hashes[~met]
        short = ~whole[fresh] & (sizes[fresh] <= WORD_BYTES)
        self.known.add(hashes[short], len(self.counts) + np.arange(int(short.sum())))
        self.words += [data[a:b].tobytes() for a, b in zip(starts[fresh[short]].tolist(), (starts + sizes)[fresh[short]].tolist())]
        more = [n[short]]
        for i, times in zip(fresh[~short].tolist(), n[~short].tolist()):  # still to be cut: rows of their own, that no hash leads to
            if whole[i]:
                cut_up = [w for w in (w.encode() for w in merger.words(data[starts[i] : starts[i] + sizes[i]].tobytes().decode())) if len(w) <= WORD_BYTES]
                self.words += cut_up
                more.append(np.full(len(cut_up), times))
        self.counts = np.concatenate([self.counts, *more])

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.words, pa.binary()), pa.array(self.counts)], ["word", "n"])
        self.__init__()
        return out


def frequent_words(docs: DataFrame, data, words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts, counted before they are shuffled.

    Counts fall into classes, 16 to a doubling
    (about 1000 at most); all words of the highest classes that together hold no
    more than ``words`` are taken, so that no partition sends a list of its own
    to the driver. Words seen once stay out.
    """

    def count(batches):
        merger, counts = _cached(("merger", hash(data.value)), lambda: Merger(data.value)), WordCounts()
        for batch in batches:
            flat, bounds = text_bytes(batch.column(1))
            for _, _, part, _ in in_blocks(flat, bounds):
                counts.add(flat[part[0] : part[-1]], part - part[0], merger)
                if len(counts.words) >= GATHERED:
                    yield counts.batch()
        yield counts.batch()

    counts = _texts(docs).mapInArrow(tidied(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts.where("n > 1").select("word", F.floor(16 * F.log2("n")).alias("class")))
    held, least = 0, None
    for found in sorted(counts.groupBy("class").count().collect(), reverse=True):
        held += found[1]
        if held > words:
            break
        least = found[0]
    return [bytes(r.word) for r in counts.where(F.col("class") >= least).collect()] if least is not None else []


def build_lexicon(docs: DataFrame, data, words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon: ``words`` entries of ``WORD_BYTES`` bytes at most."""
    merger = Merger(data.value)
    special = {s.encode() for s in merger.special}
    return compile_lexicon({w: merger.merge(w) for w in frequent_words(docs, data, words) if w not in special})


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, *, words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip of whole texts.

    ``with_ids`` adds the ids themselves as an array. One pass counts words
    (only counts are shuffled), one encodes and decodes.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    lexicon = spark.sparkContext.broadcast(build_lexicon(docs, data, words))

    def run(batches):
        encoder = _cached(("encoder", hash(data.value), hash(lexicon.value)), lambda: Encoder(data.value, lexicon.value))
        for batch in batches:
            flat, bounds = text_bytes(batch.column(1))
            open_: list = []  # the parts of a long text so far: ids, decoded bytes
            for i, j, part, ends in in_blocks(flat, bounds):
                block = flat[part[0] : part[-1]]
                ids, at = encoder.encode_block(block, part - part[0])
                back = encoder.decode_block(ids)
                if not np.array_equal(back, block):  # two pieces of one hash
                    again = [encoder.encode_text(flat[a:b].tobytes().decode()) for a, b in zip(part, part[1:])]
                    ids, at = np.frombuffer(b"".join(again), np.uint32), np.append(0, np.cumsum([len(x) // 4 for x in again]))
                    back = encoder.decode_block(ids)
                if not ends or open_:
                    open_.append((ids, back) if with_ids else None)
                    if len(open_) == 1:
                        n, hashed, decoded, same = 0, hashlib.sha256(), hashlib.sha256(), True
                    n, same = n + len(ids), same and np.array_equal(back, block)
                    hashed.update(ids)
                    decoded.update(back)
                    if ends:
                        every = np.concatenate([x for x, _ in open_]) if with_ids else None
                        yield _result(batch.column(0).slice(i, 1), [n], [hashed.hexdigest()], [decoded.hexdigest()], [same], every, with_ids)
                        open_ = []
                    continue
                texts, same = part - part[0], np.array_equal(back, block)
                places = texts if same else np.append(0, np.cumsum(encoder.token_size[ids]))[at]
                hashed = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())]
                decoded = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(places.tolist(), places[1:].tolist())]
                equal = [same or np.array_equal(back[a:b], block[c:d]) for a, b, c, d in zip(places, places[1:], texts, texts[1:])]
                yield _result(batch.column(0).slice(i, j - i), np.diff(at), hashed, decoded, equal, ids, with_ids)

    return _texts(docs).mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)


def _result(doc: pa.Array, n, hashed, decoded, same, ids, with_ids: bool) -> pa.RecordBatch:
    columns = [doc, pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids.view(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)
