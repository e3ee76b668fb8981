"""Embedding near-duplicates through a robust-pruned flat graph.

Equal vectors of a label are one node with a number of copies. The nodes of a
label are dealt to cluster shards, each node to its nearest centres; centres are
fitted to a sample of ``SAMPLE`` vectors at most, every vector is indexed. Each
shard builds a flat graph: a node's nearest nodes, pruned so that a neighbour
goes if another kept one is much closer to it. The adjacency lists of all shards
are united. Links along the graph join most of a group of near copies; since a
pruned list can end within a tight sub-group, the nodes of a shard are compared
exactly as well, a block of queries at a time, in double precision. So all links
between nodes that share a shard are found; what can be missed are links of nodes
that share none.

Shards hold ``SHARD`` nodes on average, as centres grow with the rows; beyond
``CENTRES`` centres in all (6.5 million distinct vectors) shards grow instead, and
so does one of a dense group. A shard's task holds its vectors, and compares them
a block of ``PRODUCTS`` at a time, so that its memory stays in proportion to them;
only its time grows with their square. Nothing is dropped either way.

A link is counted in the first shard that both its nodes are in, and only the
counts leave the shard. For components, links are reduced to a spanning forest.

Defined results: vectors that are null, empty, zero, or hold a null or a
non-finite number, and vectors without a label, link with nothing; vectors of
different lengths don't link; repeated vec_ids count as copies; rows with a null
vec_id are counted but name nothing; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut
from tidewell.llm.components import component_roots

THRESHOLD, SHARD, OVERLAP = 0.98, 800, 3
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
#: Most vectors that centres are fitted to, and most centres for all labels, as they are broadcast.
SAMPLE, CENTRES = 40_000, 8192
#: Products that are held at once when queries are compared with the nodes of their shard.
PRODUCTS = 1 << 22


def queries(n: int) -> int:
    """How many queries are compared at once with ``n`` nodes."""
    return max(1, min(512, PRODUCTS // max(1, n)))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on unit rows; the start is spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        step = queries(k)
        nearest = np.concatenate([(sample[at : at + step] @ centres.T).argmax(1) for at in range(0, len(sample), step)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def pruned(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """The adjacency lists of a shard's robust-pruned graph."""
    n, out = len(x), []
    top = min(candidates, n - 1)
    for at in range(0, n, queries(n)):
        near = x[at : at + queries(n)] @ x.T
        for i in range(len(near)):
            near[i, at + i] = -2
        best = np.argpartition(-near, top - 1, 1)[:, :top] if top else np.empty((len(near), 0), int)
        for i, cand in enumerate(best):
            cand = cand[np.argsort(-near[i, cand], kind="stable")]
            away = np.maximum(0, 1 - near[i, cand])
            between = np.maximum(0, 1 - x[cand] @ x[cand].T)
            alive, kept = np.ones(len(cand), bool), []
            for j in range(len(cand)):
                if alive[j]:
                    kept.append(j)
                    if len(kept) == degree:
                        break
                    alive &= alpha * between[j] > away
                    alive[: j + 1] = False
            out.append(cand[kept])
    return out


def counted(x: np.ndarray, of: np.ndarray, copies: np.ndarray, here: int, threshold: float) -> np.ndarray:
    """How many vectors each node links with, of the links that count here.

    All nodes are compared, a block of queries at a time. ``of`` has the shards
    of each node; a link counts in the first shard that both its nodes are in.
    """
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), queries(len(x))):
        close = x[at : at + queries(len(x))] @ x.T >= threshold
        close[np.arange(len(close)), at + np.arange(len(close))] = False
        for i in np.flatnonzero(close.any(1)):
            js = np.flatnonzero(close[i])
            for s in of[at + i]:
                if s < here:
                    js = js[(of[js] != s).all(1)]
            out[at + i] = copies[js].sum()
    return out


def forest(x: np.ndarray, lists: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that connect whatever is connected: along the graph, then exactly.

    The graph's links join most of a group. What they leave apart is compared
    with all nodes of the other components, so that no link is missed.
    """
    parent = np.arange(len(x))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def join(i, js):
        for j in js:
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))

    for i, near in enumerate(lists):
        join(i, near[x[near] @ x[i] >= threshold] if len(near) else near)
    roots = np.array([root(i) for i in range(len(x))], np.int64)
    for at in range(0, len(x), queries(len(x))):
        close = x[at : at + queries(len(x))] @ x.T >= threshold
        close &= roots[at : at + len(close), None] != roots[None]
        for i in np.flatnonzero(close.any(1)):
            js = np.flatnonzero(close[i])
            join(int(at + i), js[np.unique(roots[js], return_index=True)[1]])
    return out


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def nodes(vectors: DataFrame) -> DataFrame:
    """label, embedding, node (its smallest vec_id), copies of usable vectors."""
    usable = vectors.where(usable_vector())
    return usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).where("node is not null").withColumn("dim", F.size("embedding"))


def usable_vector():
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))


def _centres(reps: DataFrame, shard: int) -> dict[tuple, np.ndarray]:
    sizes = {(r.label, r.dim): r["count"] for r in reps.groupBy("label", "dim").count().where(F.col("count") > shard).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    every = max(1, -(-total // SAMPLE) * 2)  # a hash picks one in so many: under SAMPLE on average
    sample = reps.where(F.pmod(F.xxhash64("node"), F.lit(every if total > SAMPLE else 1)) == 0).orderBy(F.xxhash64("node", F.lit(1))).limit(SAMPLE).select("label", "dim", "embedding").toArrow()
    out = {}
    labels, dims, column = sample["label"].to_pylist(), sample["dim"].to_pylist(), sample["embedding"].combine_chunks()
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(labels, dims)):
        rows.setdefault(key, []).append(i)
    # Centres grow with a label's rows; only all of them together are bounded.
    each = max(shard, -(-total // CENTRES))
    for key, size in sizes.items():
        if key in rows:
            x = unit_rows(_matrix(column.take(pa.array(rows[key])), key[1]))
            out[key] = fit_centres(x, min(len(x), -(-size // each)))
    return out


def shards(reps: DataFrame, centres, overlap: int) -> DataFrame:
    """A row of each node for each of its shards, with the list of them all."""

    def run(batches):
        for batch in batches:
            labels, dims = (batch.column(i).to_pylist() for i in (0, 1))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, dims)):
                groups.setdefault(key, []).append(i)
            rows, where, lists = [], [], []
            for key, members in groups.items():
                c = centres.value.get(key)
                if c is None:
                    rows += members
                    where += [0] * len(members)
                    lists += [[0]] * len(members)
                    continue
                x, step = unit_rows(_matrix(batch.column(4).take(pa.array(members)), key[1])), queries(len(c))
                best = np.concatenate([np.argsort(-(x[at : at + step] @ c.T), 1, kind="stable")[:, :overlap] for at in range(0, len(x), step)])
                for nth in range(best.shape[1]):
                    rows += members
                    where += best[:, nth].tolist()
                    lists += best.tolist()
            if rows:
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(where, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "shard", "shards"])

    rows = reps.select("label", "dim", "node", "copies", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "label int, dim int, node long, copies long, embedding array<double>, shard int, shards array<int>")


def vector_groups(vectors: DataFrame, *, threshold: float = THRESHOLD, shard: int = SHARD, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label"))
    reps = cut(nodes(vectors))
    centres = vectors.sparkSession.sparkContext.broadcast(_centres(reps, shard))
    dealt = cut(shards(reps, centres, overlap))

    def build(table: pa.Table) -> pa.Table:
        ids = table["node"].to_numpy()
        order = np.argsort(ids)
        x = unit_rows(_matrix(table["embedding"], table["dim"][0].as_py()))[order]
        lists = pruned(x)
        return pa.table({"node": ids[order], "near": pa.array([ids[order][v] for v in lists], pa.list_(pa.int64()))})

    graph = dealt.groupBy("label", "dim", "shard").applyInArrow(build, "node long, near array<long>")
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def walk(table: pa.Table) -> pa.Table:
        ids = table["node"].to_numpy()
        order = np.argsort(ids)
        ids, here, copies = ids[order], table["shard"][0].as_py(), table["copies"].to_numpy()[order]
        x = unit_rows(_matrix(table["embedding"], table["dim"][0].as_py()))[order]
        of = _matrix(table["shards"], len(table["shards"][0])).astype(np.int32)[order]
        near = table["near"].take(pa.array(order)).to_pylist()
        lists = []
        for v in near:
            spot = np.searchsorted(ids, v := np.array(v or [], np.int64))
            spot = np.minimum(spot, len(ids) - 1)
            lists.append(spot[ids[spot] == v])
        linked = counted(x, of, copies, here, threshold)
        tree = forest(x, lists, threshold)
        some = np.flatnonzero(linked)
        a = [*ids[some], *(ids[i] for i, _ in tree)]
        b = [*[None] * len(some), *(ids[j] for _, j in tree)]
        n = [*linked[some], *[None] * len(tree)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    found = cut(dealt.join(united, "node").groupBy("label", "dim", "shard").applyInArrow(walk, "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = component_roots(found.where("b is not null").select("a", "b"), "a", "b")
    smallest = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = roots.join(smallest, "root").select("node", "component_id")
    done = reps.join(counts, "node", "left").join(named, "node", "left").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    joined = vectors.join(done, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & usable_vector(), "left")
    rows = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audited_recall(vectors: DataFrame, result: DataFrame, *, every: int = 100, threshold: float = THRESHOLD) -> tuple[float, int]:
    """Links found over links there are, for the vec_ids divisible by ``every``.

    The brute force runs over all rows, a batch against the stated queries.
    """
    usable = vectors.where(usable_vector()).select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = usable.where(F.pmod("vec_id", F.lit(every)) == 0).toArrow().to_pydict()
    sent = vectors.sparkSession.sparkContext.broadcast({k: list(v) for k, v in asked.items()})

    def run(batches):
        q = sent.value
        for batch in batches:
            got: dict[int, int] = {}
            ids, labels, es = (batch.column(i).to_pylist() for i in range(3))
            for d in {len(e) for e in es}:
                mine, theirs = [i for i, e in enumerate(es) if len(e) == d], [i for i, e in enumerate(q["embedding"]) if len(e) == d]
                if theirs:
                    close = unit_rows(np.array([q["embedding"][i] for i in theirs])) @ unit_rows(np.array([es[i] for i in mine])).T >= threshold
                    for a, b in np.argwhere(close):
                        if q["label"][theirs[a]] == labels[mine[b]] and q["vec_id"][theirs[a]] != ids[mine[b]]:
                            got[q["vec_id"][theirs[a]]] = got.get(q["vec_id"][theirs[a]], 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], ["vec_id", "n"])

    truth = usable.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    row = result.where(F.pmod("vec_id", F.lit(every)) == 0).join(truth, "vec_id", "left").agg(F.sum("n_links").alias("found"), F.sum("n").alias("there")).first()
    return (row["found"] or 0) / max(1, row["there"] or 0), row["there"] or 0
