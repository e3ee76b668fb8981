"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic regressions give the document's own evidence. Low quality shows in
a text as a whole: that one sees the shares of words, over the length, and the
shape. Toxic is what holds telling words, be they few in a long text: that one
sees whether a word is there at all, for the words that stand out in labelled
documents far beyond chance, and no length enters. All labels are summed by
path (source and language) and host (source): a path's rate shrinks towards its
host's, the host's towards the global one, each with a strength fitted to the
spread that the sites show beyond chance. The log-odds by which a path differs
from all are added to the document's. A document is kept while the joint
probability of either fault is under one half.

The regressions see ``sample`` labelled documents at most, the first in the
order of a hash; rates and scores cover every row. Equal texts count once, and a
fault that one of them has counts for all. Rows are fitted in the order of a
digest, so that the result does not depend on how the table is split.

Defined results: null and empty texts have no words and are scored by their
shape and site; a null source or language is a site of its own; each fault is
counted and fitted over the rows whose own label is known, whatever the other
one is; several labels of one doc_id are a fault if one of them is; without labels
everything is kept at probability one half of nothing (0.0); a probability of
exactly one half is a fault; very long texts are scored whole, one at a time;
repeated rows come back repeated; an empty table gives an empty table; other
columns stay, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import fresh, tidied, trim

SAMPLE, BUCKETS, STEPS, L2 = 8000, 1 << 15, 150, 2e-5
#: A telling word: documents at least, and deviations from the rate of the fault; their regression's steps and penalty.
LEAST, DEVIATIONS, TELLING_STEPS, TELLING_L2 = 4, 4, 300, 1e-4
SHAPES = 8
_BETWEEN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_UPPER = bytes(range(0x41, 0x5B))
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'")
MEMO = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def features(text: str | None, hashes: dict) -> tuple[list[int], list[float]]:
    """The 32-bit hashes of a text's distinct words, and numbers for its shape."""
    raw = (text or "").encode()
    words = raw.lower().translate(_BETWEEN).split()
    distinct = set(words)
    n, size = max(1, len(words)), max(1, len(raw))
    lines = (text or "").split("\n")
    shape = [
        (len(raw) - len(raw.translate(None, _UPPER))) / size,
        min(1.0, 4 * (len(raw) - len(raw.translate(None, _MARKS))) / size),
        len(distinct) / n,
        len(distinct) / n**0.7 / 2,
        min(1.0, sum(map(len, words)) / n / 20),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(len(words)) / 10),
        min(1.0, raw.count(b".") / n * 5),
    ]
    return sorted({hashes[w] for w in distinct}), shape


def fit(lens: np.ndarray, words: np.ndarray, shapes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of buckets of words, shapes and a constant (Adam, full batch).
    ``words`` has the hashes of all rows, ``lens`` how many each row has."""
    flat = words & (BUCKETS - 1)
    doc = np.repeat(np.arange(len(lens)), lens)
    scale = (1 / np.sqrt(np.maximum(1, lens)))[doc]
    shape = np.column_stack([shapes, np.ones(len(lens))])
    w, v, m, s = np.zeros(BUCKETS + SHAPES + 1), 0, 0, 0
    balance = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    balance = np.sqrt(balance) / np.sqrt(balance).mean()
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, w[flat] * scale, len(lens)) + shape @ w[BUCKETS:]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / len(lens)
        g = np.concatenate([np.bincount(flat, e[doc] * scale, BUCKETS) + L2 * w[:BUCKETS], shape.T @ e + L2 * w[BUCKETS:]])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w


def fit_telling(lens: np.ndarray, hashed: np.ndarray, y: np.ndarray) -> tuple[dict[int, float], float]:
    """Weights of telling words by hash, and a constant (Adam, full batch)."""
    words, flat = np.unique(hashed, return_inverse=True)
    doc, rate, size = np.repeat(np.arange(len(lens)), lens), y.mean(), len(lens)
    n, bad = np.bincount(flat, minlength=len(words)), np.bincount(flat, y[doc], len(words))
    beyond = np.abs(bad - n * rate) / np.sqrt(np.maximum(1e-9, n * rate * (1 - rate) * (1 - n / size)))
    telling = np.flatnonzero((beyond > DEVIATIONS) & (n >= LEAST))
    place = np.full(len(words), -1)
    place[telling] = np.arange(len(telling))
    there = place[flat] >= 0
    flat, doc = place[flat][there], doc[there]
    w, m, s = np.append(np.zeros(len(telling)), np.log(rate / (1 - rate))), 0, 0
    for step in range(1, TELLING_STEPS + 1):
        z = np.bincount(doc, w[flat], size) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / size
        g = np.append(np.bincount(flat, e[doc], len(telling)) + TELLING_L2 * w[:-1], e.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return dict(zip(words[telling].tolist(), w.tolist())), float(w[-1])


def shrunk(bad: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (bad + strength * prior) / (n + strength)


def _strength(sites: DataFrame, fault: str, rate: float) -> float:
    """Prior rows of a beta prior whose spread is the sites' beyond chance."""
    n, bad = F.col(f"n_{fault}"), F.col(fault)
    row = sites.where(n > 0).agg(F.sum(n * (bad / n - rate) ** 2).alias("s"), F.sum(n).alias("n"), F.sum(n**2).alias("q"), F.count("*").alias("k")).first()
    if not row["n"] or row["k"] < 2 or not 0 < rate < 1:
        return 1e6
    chance = rate * (1 - rate)
    spread = (row["s"] - (row["k"] - 1) * chance) / max(1e-9, row["n"] - row["q"] / row["n"])
    return float(np.clip(chance / spread - 1, 2, 1e6)) if spread > 0 else 1e6


FAULTS = ("low", "toxic")


def site_offsets(labelled: DataFrame, faults: tuple[str, ...] = FAULTS) -> tuple[DataFrame, dict[str, float]]:
    """For each host and path, by how much the log-odds of each fault differ.

    ``labelled`` has host, path and a 0/1 column (or null) for each fault. One
    grouped sum by (host, path); hosts are sums of paths. Also returns the
    global rates.
    """
    sums = [x for f in faults for x in (F.count(f).cast("double").alias(f"n_{f}"), F.coalesce(F.sum(f).cast("double"), F.lit(0.0)).alias(f))]
    again = [F.sum(x).alias(x) for f in faults for x in (f"n_{f}", f)]
    paths = labelled.groupBy("host", "path").agg(*sums)
    hosts = paths.groupBy("host").agg(*again)
    total = hosts.agg(*again).first()
    rates = {f: (total[f] + 0.5) / (total[f"n_{f}"] + 1) if total[f"n_{f}"] else 0.0 for f in faults}
    odds = lambda p: F.log(p / (1 - p))
    by_host = hosts.select(F.col("host").alias("_host"), *(shrunk(F.col(f), F.col(f"n_{f}"), F.lit(rates[f]), F.lit(_strength(hosts, f, rates[f]))).alias(f"_{f}") for f in faults))
    joined = paths.join(by_host, F.col("host").eqNullSafe(F.col("_host")))
    strengths = {f: _strength(paths, f, rates[f]) for f in faults}
    offsets = joined.select("host", "path", *(odds(shrunk(F.col(f), F.col(f"n_{f}"), F.col(f"_{f}"), F.lit(strengths[f]))).alias(f"{f}_path") for f in faults), *(odds(F.col(f"_{f}")).alias(f"{f}_host") for f in faults))
    return offsets, rates


def _fitted(docs: DataFrame, known: DataFrame, sample: int):
    """The two models: bucket weights for low, telling words and a constant."""
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def gather(batches):
        hashes = _Hashes()
        for batch in batches:
            found = [features(x, hashes) for x in batch.column(0).to_pylist()]
            keys = [zlib.crc32(np.array(b, np.int64).tobytes()) << 31 ^ zlib.crc32(np.array(s).tobytes()) for b, s in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([b for b, _ in found], pa.list_(pa.int64())), pa.array([s for _, s in found], pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["key", "words", "shape", *FAULTS])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    table = texts.select("text", *FAULTS).mapInArrow(tidied(gather), "key long, words array<long>, shape array<double>, low double, toxic double").toArrow().combine_chunks()
    models: list = [(np.append(np.zeros(BUCKETS + SHAPES), -30.0),), ({}, -30.0)]
    for nth, fault in enumerate(FAULTS):
        rows = table.filter(table[fault].is_valid())
        if not rows.num_rows:
            continue
        keys, first, of = np.unique(rows["key"].to_numpy(), return_index=True, return_inverse=True)
        y = np.zeros(len(keys))
        np.maximum.at(y, of, rows[fault].to_numpy())
        rows = rows.take(pa.array(first))
        if y.min() == y.max():
            sure = 30.0 if y[0] else -30.0
            models[nth] = ({}, sure) if nth else (np.append(np.zeros(BUCKETS + SHAPES), sure),)
            continue
        words = rows["words"].combine_chunks()
        lens, flat = np.diff(words.offsets.to_numpy()), words.flatten().to_numpy()
        shapes = rows["shape"].combine_chunks().flatten().to_numpy().reshape(-1, SHAPES)
        models[nth] = fit_telling(lens, flat, y) if nth else (fit(lens, flat, shapes, y),)
    return models[0][0], *models[1]


def scored(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """``docs`` in one pass, with a last column of struct (p_low, p_toxic,
    site_low, site_toxic, keep).

    Labelled rows are joined to the documents without their texts; only the
    sample's texts are read for the regressions. The offsets of sites are joined
    by host and path: a small table goes to all executors, a large one is
    shuffled, and adaptive execution splits its hot keys.
    """
    fault = lambda c: F.max(c).cast("double")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (1 - F.col("quality")).alias("low"), F.col("toxic").alias("toxic")).where("doc_id is not null and (low is not null or toxic is not null)")
    known = known.groupBy("doc_id").agg(fault("low").alias("low"), fault("toxic").alias("toxic"))
    host, path = F.col("source").cast("string"), F.col("lang").cast("string")
    sites = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path")).join(known, "doc_id")
    offsets, rates = site_offsets(sites)
    sent = docs.sparkSession.sparkContext.broadcast(_fitted(docs, known, sample))
    trim()
    place, text = len(docs.columns), docs.select(F.col("text").cast("string")).schema[0]

    def score(batches):
        hashes, (w, telling, constant) = _Hashes(), sent.value
        words = set(telling)
        for batch in batches:
            out = np.empty((batch.num_rows, 2))
            for i, x in enumerate(batch.column(place)):
                b, s = features(x.as_py(), hashes)
                out[i, 0] = w[np.array(b, np.int64) & (BUCKETS - 1)].sum() / max(1, len(b)) ** 0.5 + w[BUCKETS:-1] @ s + w[-1]
                out[i, 1] = constant + sum(telling[h] for h in sorted(words.intersection(b)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], batch.column(place + 1), batch.column(place + 2), pa.array(out[:, 0]), pa.array(out[:, 1])], names)

    own = [fresh(n, docs.columns) for n in ("_host", "_path", "_zlow", "_ztoxic")]
    names = [*docs.columns, *own]
    as_is = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    every = docs.select("*", F.col("text").cast(text.dataType).alias(fresh("_text", docs.columns)), host.alias(own[0]), path.alias(own[1]))
    found = every.mapInArrow(tidied(score), ", ".join([*as_is, f"`{own[0]}` string, `{own[1]}` string, `{own[2]}` double, `{own[3]}` double"]))
    aliased = {c: fresh(f"_o_{c}", docs.columns) for c in offsets.columns}
    hosts = offsets.groupBy("host").agg(*(F.max(f"{f}_host").alias(aliased[f"{f}_host"]) for f in FAULTS)).withColumnRenamed("host", fresh("_h", docs.columns))
    paths = offsets.select(*(F.col(c).alias(aliased[c]) for c in ("host", "path", "low_path", "toxic_path")))
    joined = found.join(paths, F.col(own[0]).eqNullSafe(F.col(aliased["host"])) & F.col(own[1]).eqNullSafe(F.col(aliased["path"])), "left").join(hosts, F.col(own[0]).eqNullSafe(F.col(hosts.columns[0])), "left")
    logit = {f: float(np.log(r / (1 - r))) if 0 < r < 1 else 0.0 for f, r in rates.items()}
    off = {f: F.coalesce(aliased[f"{f}_path"], aliased[f"{f}_host"], F.lit(logit[f])) - F.lit(logit[f]) for f in FAULTS}
    p = {f: 1 / (1 + F.exp(-(F.col(z) + off[f]))) for f, z in zip(FAULTS, own[2:])}
    verdict = F.struct(*(p[f].alias(f"p_{f}") for f in FAULTS), *(off[f].alias(f"site_{f}") for f in FAULTS), ((1 - p["low"]) * (1 - p["toxic"]) > 0.5).alias("keep"))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), verdict.alias(fresh("_verdict", docs.columns)))


def quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_low, p_toxic, site_low, site_toxic, keep of every row."""
    needed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    return scored(needed, labels, sample=sample).select("doc_id", "_verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    found = scored(docs, labels, **settings)
    return found.where(F.col(found.columns[-1])["keep"]).select(*(F.col(f"`{c}`") for c in docs.columns))
