"""Nearest neighbours by hierarchical navigable small-world graphs, one for each shard, as flat neighbour arrays.

Distinct vectors are dealt to shards by their hash, about SHARD to each. In a shard, nodes draw levels and are laid out by
falling level, so that layer l is the graph over the first sizes[l] nodes, a flat array of their neighbours (-1: none).
Layers are made from the top. Nodes come in batches: their candidates are what a beam search from the layers above finds
in the graph so far, and the batch itself; of these, neighbours are taken that are nearer to the node than to a neighbour
already taken. Queries descend the layers in the same way. Every shard answers every block of queries, and the answers,
scored again on the original vectors in double precision, are merged.

Copies of a vector are one node, which keeps the COPIES smallest ids (what k answers can need): copies never crowd each
other's neighbours, and no group of copies is gathered.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different
lengths don't meet; equal scores come by ascending vec_id, null ids last; a row with a null id is no query; repeated rows
are candidates of each other and each one is a query; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Nodes of a shard, queries of a block, neighbours of a node (twice as many in the lowest layer), and beams while building and searching.
SHARD, QUERIES, M, EF_BUILD, EF = 8192, 4096, 16, 80, 160
#: Nodes whose candidates are all pairs, nodes inserted at once, and beam entries followed at once.
SEED_NODES, BATCH, WIDE = 512, 512, 4
K = 10
_INDEX = "dim int, shard int, sizes array<int>, neighbours array<array<int>>, vectors array<double>, ids array<array<bigint>>"
_FOUND = "query_id bigint, qk bigint, copies bigint, vec_id bigint, score double"


def _frame(v: np.ndarray) -> tuple[np.ndarray, float]:
    """A middle and a scale that a few far vectors don't move."""
    centre = np.median(v, 0)
    far = np.abs(v / 2 - centre / 2).max(1)
    return centre, 2 * float(np.median(far[far > 0])) if (far > 0).any() else 1.0


def _scaled(v: np.ndarray, centre: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Single-precision vectors near 0, and their squared lengths."""
    with np.errstate(over="ignore"):
        x = np.clip((v / 2 - centre / 2) / scale * 2, -1e15, 1e15).astype(np.float32)
    return x, np.einsum("ij,ij->i", x, x)


def _squares(x: np.ndarray, n2: np.ndarray, y: np.ndarray, m2: np.ndarray) -> np.ndarray:
    return np.maximum(n2[:, None] + m2[None, :] - 2 * (x @ y.T), 0)


def beam(x: np.ndarray, n2: np.ndarray, near: np.ndarray, q: np.ndarray, q2: np.ndarray, starts: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ef nearest nodes found (-1: fewer) and their squared distances, ascending."""
    n_q = len(q)
    ids, dist = np.full((n_q, ef), -1, np.int32), np.full((n_q, ef), np.inf, np.float32)
    done = np.zeros((n_q, ef), bool)
    seen = np.zeros((n_q, len(near)), bool)
    rows = np.arange(n_q)
    fresh = starts.astype(np.int32)
    while len(rows):
        # nodes that a query meets for the first time, each once
        fresh = np.sort(fresh, 1)
        new = fresh >= 0
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        new &= ~seen[rows[:, None], np.maximum(fresh, 0)]
        r, c = np.nonzero(new)
        node = fresh[r, c]
        seen[rows[r], node] = True
        d = np.full(fresh.shape, np.inf, np.float32)
        d[r, c] = np.maximum(n2[node] + q2[rows[r]] - 2 * np.einsum("ij,ij->i", x[node], q[rows[r]]), 0)
        all_d = np.concatenate([dist[rows], d], 1)
        keep = np.argsort(all_d, 1, kind="stable")[:, :ef]
        dist[rows] = np.take_along_axis(all_d, keep, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new, fresh, -1)], 1), keep, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~new], 1), keep, 1)
        open_ = ~done[rows] & np.isfinite(dist[rows])
        some = open_.any(1)
        rows, open_ = rows[some], open_[some]
        pick = open_ & (np.cumsum(open_, 1) <= WIDE)
        r, c = np.nonzero(pick)
        done[rows[r], c] = True
        at = np.cumsum(pick, 1)[r, c] - 1
        taken = np.full((len(rows), WIDE), -1, np.int32)
        taken[r, at] = ids[rows[r], c]
        fresh = np.where(taken[:, :, None] >= 0, near[np.maximum(taken, 0)], -1).reshape(len(rows), WIDE * near.shape[1])
    return ids, dist


def spread(x: np.ndarray, n2: np.ndarray, cand: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
    """Of candidates by ascending distance (-1: none), m of each row: first those nearer to the row's node than to one taken before, then the nearest others."""
    out = np.full((len(cand), m), -1, np.int32)
    for a in range(0, len(cand), BATCH):
        c, d = cand[a : a + BATCH], dist[a : a + BATCH]
        there = c >= 0
        v, s = x[np.maximum(c, 0)], n2[np.maximum(c, 0)]
        pair = s[:, :, None] + s[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        free, taken, count = there.copy(), np.zeros_like(there), np.zeros(len(c), np.int64)
        for i in range(c.shape[1]):
            take = free[:, i] & (count < m)
            taken[:, i] = take
            count += take
            free &= ~(take[:, None] & (pair[:, i] < d))
        first = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), 1, kind="stable")[:, :m]
        out[a : a + BATCH, : first.shape[1]] = np.take_along_axis(c, first, 1)
    return out


def _link_back(x: np.ndarray, n2: np.ndarray, near: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
    """Edges dst -> src beside those src -> dst; full lists are chosen again."""
    new = ~(near[dst] == src[:, None]).any(1)
    src, dst = src[new], dst[new]
    if not len(src):
        return
    m = near.shape[1]
    d = np.maximum(n2[src] + n2[dst] - 2 * np.einsum("ij,ij->i", x[src], x[dst]), 0)
    order = np.lexsort((src, d, dst))
    src, dst = src[order], dst[order]
    node, first, count = np.unique(dst, return_index=True, return_counts=True)
    rank = np.arange(len(dst)) - np.repeat(first, count)
    inside = rank < m
    come = np.full((len(node), m), -1, np.int32)
    come[np.repeat(np.arange(len(node)), count)[inside], rank[inside]] = src[inside]
    both = np.concatenate([near[node], come], 1)
    far = np.where(both >= 0, n2[np.maximum(both, 0)] + n2[node][:, None] - 2 * np.einsum("ijk,ik->ij", x[np.maximum(both, 0)], x[node]), np.inf)
    by = np.argsort(far, 1, kind="stable")
    both, far = np.take_along_axis(both, by, 1), np.take_along_axis(far, by, 1)
    full = (both >= 0).sum(1) > m
    near[node[~full]] = both[~full, :m]
    near[node[full]] = spread(x, n2, both[full], far[full], m)


def layer(x: np.ndarray, n2: np.ndarray, n: int, m: int, width: int, above: list[np.ndarray]) -> np.ndarray:
    """The graph over the first n nodes: n rows of neighbours. above: finished layers, the top one first."""
    near = np.full((n, width), -1, np.int32)
    a, b = 0, min(n, SEED_NODES)
    while a < n:
        own = _squares(x[a:b], n2[a:b], x[a:b], n2[a:b])
        np.fill_diagonal(own, np.inf)
        cand, dist = np.broadcast_to(np.arange(a, b, dtype=np.int32), own.shape), own
        if a:
            starts = descend(x, n2, above, x[a:b], n2[a:b])
            ids, d = beam(x, n2, near[:a], x[a:b], n2[a:b], np.where(starts < a, starts, 0), EF_BUILD)
            cand, dist = np.concatenate([cand, ids], 1), np.concatenate([own, d], 1)
        by = np.argsort(dist, 1, kind="stable")[:, :EF_BUILD]
        cand, dist = np.take_along_axis(cand, by, 1), np.take_along_axis(dist, by, 1)
        near[a:b, :m] = spread(x, n2, np.where(np.isfinite(dist), cand, -1), dist, m)
        r, c = np.nonzero(near[a:b] >= 0)
        _link_back(x, n2, near, (r + a).astype(np.int32), near[a + r, c])
        a, b = b, min(n, b + BATCH)
    return near


def descend(x: np.ndarray, n2: np.ndarray, layers: list[np.ndarray], q: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """Where to start below the given layers: the nearest nodes found in them."""
    at = np.zeros((len(q), 1), np.int32)
    for near in layers:
        at = np.maximum(beam(x, n2, near, q, q2, at, WIDE)[0], 0)
    return at


def graph(v: np.ndarray, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of nodes by falling level, and the layers' neighbours, the top layer first."""
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(len(v))) / np.log(M)).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    x, n2 = _scaled(v[order], *_frame(v))
    layers: list[np.ndarray] = []
    for k in range(int(level.max()), -1, -1):
        layers.append(layer(x, n2, int((level >= k).sum()), M, M if k else 2 * M, layers))
    return order, layers


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _build(t: pa.Table) -> pa.Table:
    """One shard's nodes (v, ids, at) to its index row."""
    t = t.sort_by("at")
    v, shard = _matrix(t["v"], len(t)), t["shard"][0].as_py()
    order, layers = graph(v, shard)
    ids = t["ids"].to_pylist()
    return pa.table({
        "dim": pa.array([v.shape[1]], pa.int32()), "shard": pa.array([shard], pa.int32()), "sizes": pa.array([[len(x) for x in layers]], pa.list_(pa.int32())),
        "neighbours": pa.array([[x.ravel() for x in layers]], pa.list_(pa.list_(pa.int32()))), "vectors": pa.array([v[order].ravel()], pa.list_(pa.float64())),
        "ids": pa.array([[ids[i] for i in order]], pa.list_(pa.list_(pa.int64()))),
    })


def _answers(k: int, ef: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(index) and len(asked):
            sizes = index["sizes"][0].as_py()
            v = index["vectors"].combine_chunks().flatten().to_numpy().reshape(sizes[-1], -1)
            flat = index["neighbours"].combine_chunks().flatten()
            layers = [flat[i].values.to_numpy().reshape(n, -1) for i, n in enumerate(sizes)]
            members = index["ids"][0].as_py()
            frame = _frame(v)
            x, n2 = _scaled(v, *frame)
            wanted = _matrix(asked["v"], len(asked))
            names = list(zip(asked["query_id"].to_pylist(), asked["qk"].to_pylist(), asked["copies"].to_pylist(), strict=True))
            for a in range(0, len(wanted), BATCH):
                w = wanted[a : a + BATCH]
                q, q2 = _scaled(w, *frame)
                ids, _ = beam(x, n2, layers[-1], q, q2, descend(x, n2, layers[:-1], q, q2), ef)
                ids = ids[:, : 2 * k + 2]
                with np.errstate(over="ignore"):
                    total = np.zeros(ids.shape)
                    for j in range(w.shape[1]):
                        total += (v[np.maximum(ids, 0), j] - w[:, j][:, None]) ** 2
                    total = np.sqrt(total)
                same = (v[np.maximum(ids, 0)] == w[:, None, :]).all(2)
                for i, (query_id, qk, copies) in enumerate(names[a : a + BATCH]):
                    found = []
                    for node, d, own in zip(ids[i].tolist(), total[i].tolist(), same[i].tolist(), strict=True):
                        if node >= 0:
                            of = list(members[node])
                            if own and query_id in of:
                                of.remove(query_id)
                            found += [(d, y is None, y or 0, y) for y in of[:k]]
                    out += [(query_id, qk, copies, y, d) for d, _, _, y in sorted(found)[:k]]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.float64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "qk", "copies", "vec_id", "score"), cols, kinds, strict=True)})

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part, in double precision."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def build(embeddings: DataFrame, k: int = K) -> DataFrame:
    """A row for each shard: sizes of its layers, flat neighbour arrays, vectors and ids; for searches of up to k neighbours. A stored table."""
    first = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"))
    few = usable(embeddings).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)  # also cut before the shuffle
    nodes = few.groupBy("v").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    nodes = stored(nodes.select("v", "ids", F.size("v").alias("dim"), F.xxhash64("v").alias("at")), "vectors")
    shards = max(1, -(-nodes.count() // SHARD))
    return stored(nodes.withColumn("shard", F.pmod("at", F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInArrow(_build, _INDEX), "hnsw")


def search(index: DataFrame, queries: DataFrame, k: int = K, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries (vec_id, embedding), which is itself left out where it is in the index."""
    asked = usable(queries.filter("vec_id IS NOT NULL")).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count(F.lit(1)).alias("copies"))
    asked = stored(asked.select("query_id", "v", "copies", F.size("v").alias("dim"), F.xxhash64("query_id", "v").alias("qk")), "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod("qk", F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_answers(k, max(ef, 2 * k + 2)), _FOUND)
    best = Window.partitionBy("query_id", "qk").orderBy("score", F.asc_nulls_last("vec_id"))
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def nearest(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The k nearest neighbours of each row whose vec_id is divisible by every, among all other rows."""
    return search(build(embeddings, k), embeddings.filter(F.col("vec_id") % every == 0), k)
