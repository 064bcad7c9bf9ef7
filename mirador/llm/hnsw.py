"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph per shard of rows, stored as
flat neighbour arrays, all shards searched for every query and their results merged.

Vectors get one more component that makes all norms of a shard equal, so the largest inner product is the nearest vector. Where
norms differ much that component makes small vectors look alike and graphs are harder to search, so each shard finds its own beam: it
grows until vectors of the shard find TARGET of their true neighbours. A shard that no narrow beam will do for is scanned.
Equal vectors of a shard are one node that carries all their ids. Nodes are numbered by falling level, so the nodes of
each level are a prefix. Searches and insertions run for many vectors in step.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirador.llm.common import discard, materialize, small_batches

#: Rows of a shard, on average; queries searched in one task, on average.
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
#: The share of true neighbours that PROBES vectors of a shard must find; beams grow to at most 1 / SCAN_FROM of a shard's nodes.
TARGET, PROBES, SCAN_FROM = 0.96, 96, 6
#: Links of a node above the ground level and on it; beam widths of insertion and search; nodes that the ground level begins
#: with, which are linked by comparing all of them.
LINKS, GROUND_LINKS, BUILD_BEAM, SEARCH_BEAM, EXACT = 16, 32, 64, 96, 512


def _pick(q: np.ndarray, cand: np.ndarray, sims: np.ndarray, vectors: np.ndarray, links: int) -> np.ndarray:
    """For each row of q up to `links` of its candidates (-1: none), best first, none nearer to one picked than to q."""
    order = np.argsort(-sims, axis=1)
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    valid = np.isfinite(sims)
    v = vectors[np.maximum(cand, 0)]
    between = np.einsum("bid,bjd->bij", v, v, optimize=True)
    kept = np.zeros(cand.shape, bool)
    for i in range(cand.shape[1]):
        blocked = (kept[:, :i] & (between[:, i, :i] > sims[:, i : i + 1])).any(1)
        kept[:, i] = valid[:, i] & ~blocked & (kept[:, :i].sum(1) < links)
    room = links - kept.sum(1)
    spare = valid & ~kept  # fill up with the nearest of the rest, which keeps dense regions connected
    kept |= spare & (np.cumsum(spare, 1) <= room[:, None])
    rank = np.where(kept, np.cumsum(kept, 1) - 1, links)
    out = np.full((len(q), links + 1), -1, np.int32)
    np.put_along_axis(out, rank, np.where(kept, cand, -1).astype(np.int32), 1)
    return out[:, :links]


def _exact_graph(vectors: np.ndarray, n: int, links: int) -> np.ndarray:
    out = np.full((n, links), -1, np.int32)
    k = min(3 * links, n - 1)
    if k < 1:
        return out
    for a in range(0, n, 256):
        q = vectors[a : min(a + 256, n)]
        s = q @ vectors[:n].T
        s[np.arange(len(q)), np.arange(a, a + len(q))] = -np.inf
        c = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[a : a + len(q)] = _pick(q, c, np.take_along_axis(s, c, 1), vectors, links)
    return out


def _beam(q: np.ndarray, entry: np.ndarray, graph: np.ndarray, vectors: np.ndarray, n: int, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The `width` best nodes found for each q from its entry nodes, best first (-1: fewer), and their similarities."""
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    ids = np.full((len(q), width), n, np.int64)
    sims = np.full((len(q), width), -np.inf, np.float32)
    k = entry.shape[1]
    ids[:, :k] = entry
    sims[:, :k] = np.einsum("bd,bkd->bk", q, vectors[entry])
    seen[rows, entry] = True
    done = ids == n
    while True:
        order = np.argsort(np.where(done, np.inf, -sims), axis=1)[:, :at_once]
        current = np.where(np.take_along_axis(done, order, 1), n, np.take_along_axis(ids, order, 1))
        live = np.flatnonzero((current < n).any(1))
        if not len(live):
            break
        np.put_along_axis(done, order, True, 1)
        found = []
        for e in range(current.shape[1]):
            c = current[live, e]
            nb = np.where((c < n)[:, None], graph[np.minimum(c, n - 1)], -1)
            nb = np.where((nb < 0) | (nb >= n), n, nb)
            nb = np.where(seen[live[:, None], nb], n, nb)
            seen[live[:, None], nb] = True
            found.append(nb)
        nb = np.concatenate(found, 1)
        fresh = nb < n
        s = np.full(nb.shape, -np.inf, np.float32)
        r, c = np.nonzero(fresh)
        s[r, c] = np.einsum("kd,kd->k", q[live[r]], vectors[nb[r, c]])
        all_ids, all_sims = np.concatenate((ids[live], nb), 1), np.concatenate((sims[live], s), 1)
        all_done = np.concatenate((done[live], ~fresh), 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


@dataclass
class Index:
    """original: one row per distinct vector; ids[begin[i]:begin[i+1]]: its vec_ids, rising; levels[0] is the ground; beam: the
    width of a search, 0 for a scan of all nodes."""

    original: np.ndarray
    ids: np.ndarray
    begin: np.ndarray
    lifted: np.ndarray
    levels: list[np.ndarray]
    beam: int = SEARCH_BEAM

    @classmethod
    def build(cls, vec_ids: np.ndarray, vectors: np.ndarray, k: int = 20, seed: int = 11) -> Index:
        order = np.argsort(vec_ids, kind="stable")
        vec_ids, vectors = vec_ids[order], np.ascontiguousarray(vectors[order])
        node_of: dict[bytes, int] = {}
        node = np.array([node_of.setdefault(v.tobytes(), len(node_of)) for v in vectors], np.int64)
        n = len(node_of)
        level = np.floor(-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(LINKS)).astype(np.int64)
        place = np.empty(n, np.int64)
        place[np.argsort(-level, kind="stable")] = np.arange(n)
        node = place[node]
        by = np.argsort(node, kind="stable")
        ids, begin = vec_ids[by], np.searchsorted(node[by], np.arange(n + 1))
        original = vectors[by][begin[:-1]] if n else vectors
        x = original.astype(np.float32)
        norm = (x * x).sum(1)
        lifted = np.concatenate((x, np.sqrt(np.maximum((norm.max() if n else 0) - norm, 0))[:, None]), 1)
        counts = [int((level >= k).sum()) for k in range(1, int(level.max(initial=0)) + 1)]
        index = cls(original, ids, begin, lifted, [np.full((n, GROUND_LINKS), -1, np.int32)] + [_exact_graph(lifted, c, LINKS) for c in counts])
        index._connect(max(min(n, EXACT), counts[0] if counts else 0))
        index._tune(k, seed)
        return index

    def _tune(self, k: int, seed: int) -> None:
        """Doubles the beam until a sample of nodes finds enough of its k nearest others, scores below the k-th not counted."""
        n = len(self.original)
        self.beam = max(SEARCH_BEAM, 2 * k)
        if n <= self.beam:
            self.beam = 0
        probes = np.sort(np.random.default_rng(seed + 1).choice(n, min(n, PROBES), replace=False)) if n else np.zeros(0, np.int64)
        queries = self.original[probes].astype(np.float64)
        scores = queries @ self.original.astype(np.float64).T
        scores[np.arange(len(probes)), probes] = -np.inf
        m = min(k, n - 1)
        if m < 1:
            return
        least = np.partition(scores, n - m, axis=1)[:, n - m]
        q = np.concatenate((queries.astype(np.float32), np.zeros((len(probes), 1), np.float32)), 1)
        while self.beam:
            nodes = _beam(q, self._entries(q), self.levels[0], self.lifted, n, min(self.beam, n))[0]
            found = np.where(nodes >= 0, np.take_along_axis(scores, np.maximum(nodes, 0), 1), -np.inf)
            if np.minimum((found >= least[:, None]).sum(1), m).mean() >= TARGET * m:
                return
            self.beam = 2 * self.beam if 2 * self.beam * SCAN_FROM <= n else 0

    def _connect(self, start: int) -> None:
        x, ground, n = self.lifted, self.levels[0], len(self.lifted)
        ground[:start] = _exact_graph(x, start, GROUND_LINKS)
        at = start
        while at < n:
            stop = min(n, at + max(64, min(512, at // 4)))
            q = x[at:stop]
            ids, sims = _beam(q, self._entries(q), ground, x, at, BUILD_BEAM)
            mates = q @ q.T
            mates[np.tril_indices(len(q))] = -np.inf  # a mate already counts for the later of the two
            m = min(8, len(q))
            near = np.argpartition(-mates, m - 1, axis=1)[:, :m]
            ids, sims = np.concatenate((ids, near + at), 1), np.concatenate((sims, np.take_along_axis(mates, near, 1)), 1)
            ground[at:stop, : GROUND_LINKS // 2] = _pick(q, ids, sims, x, GROUND_LINKS // 2)
            self._link_back(at, stop)
            at = stop

    def _link_back(self, at: int, stop: int) -> None:
        x, ground = self.lifted, self.levels[0]
        r, c = np.nonzero(ground[at:stop] >= 0)
        to, new = ground[at:stop][r, c].astype(np.int64), (r + at).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        for a in range(0, len(targets), 512):
            t, f, k = targets[a : a + 512], first[a : a + 512], count[a : a + 512]
            more = np.full((len(t), int(k.max())), -1, np.int64)
            col = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            more[np.repeat(np.arange(len(t)), k), col] = new[np.repeat(f, k) + col]
            cand = np.concatenate((ground[t].astype(np.int64), more), 1)
            sims = np.where(cand >= 0, np.einsum("bd,bkd->bk", x[t], x[np.maximum(cand, 0)]), -np.inf)
            sims[(cand == t[:, None])] = -np.inf
            if cand.shape[1] > 96:
                top = np.argpartition(-sims, 95, axis=1)[:, :96]
                cand, sims = np.take_along_axis(cand, top, 1), np.take_along_axis(sims, top, 1)
            ground[t] = _pick(x[t], cand, sims, x, GROUND_LINKS)

    def _entries(self, q: np.ndarray) -> np.ndarray:
        entry = np.zeros((len(q), 1), np.int64)
        for graph in self.levels[:0:-1]:
            if len(graph):
                entry = np.maximum(_beam(q, entry, graph, self.lifted, len(graph), 4)[0][:, :1], 0)
        return entry

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score) of up to k nearest for each query, its own id left out."""
        n = len(self.original)
        if not n or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q = np.concatenate((queries.astype(np.float32), np.zeros((len(queries), 1), np.float32)), 1)
        nodes = [np.arange(n)] * len(q) if not self.beam else _beam(q, self._entries(q), self.levels[0], self.lifted, n, max(self.beam, k + 1))[0]
        exact = self.original.astype(np.float64)
        rows, ids, scores = [], [], []
        for i, found in enumerate(nodes):
            found = found[found >= 0]
            if len(found) < min(k + 1, n):
                found = np.arange(n)
            s = exact[found] @ queries[i].astype(np.float64)
            cut = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else s.min()
            best = np.flatnonzero(s >= cut)
            v = [self.ids[self.begin[j] : min(self.begin[j] + k + 1, self.begin[j + 1])] for j in found[best]]
            who, what = np.concatenate(v), np.repeat(s[best], [len(x) for x in v])
            keep = who != own[i]
            who, what = who[keep], what[keep]
            top = np.lexsort((who, -what))[:k]
            rows.append(np.full(len(top), i))
            ids.append(who[top])
            scores.append(what[top])
        return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def _usable(vectors: DataFrame) -> DataFrame:
    sized = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    size = sized.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return sized.where((F.size("embedding") == (size["d"] if size else 0)) & finite & F.exists("embedding", lambda x: x != 0))


def _build(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index = Index.build(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_numpy()), k)
        return pd.DataFrame({"shard": pdf["shard"][:1].to_numpy(), "index": [pickle.dumps(index, 5)]})

    return run


def _search(k: int):
    """Rows sorted by shard, its index first and blocks of queries after it: one index and one block in memory at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = None
        for pdf in frames:
            for blob, ids, vectors in zip(pdf["index"], pdf["ids"], pdf["vectors"], strict=True):
                if blob is not None:
                    index = pickle.loads(blob)
                    continue
                own, q = np.asarray(ids, np.int64), np.stack([np.asarray(v) for v in vectors])
                rows, found, scores = index.search(q, own, k)
                yield pd.DataFrame({"query_id": own[rows], "vec_id": found, "score": scores})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest of vectors (vec_id, embedding), its own id left out.

    Nearness is the inner product in double precision; ties go to the smaller vec_id; all candidates where fewer than k.
    queries has the same columns. Rows without id, and vectors that are null, zero, of another length than most, or hold
    null or non-finite components, take no part. Repeated ids are candidates each; of queries with one id one is asked.
    Empty tables give an empty result.
    """
    small_batches(vectors.sparkSession)
    used = materialize(_usable(vectors), "vectors")
    shards = used.count() // shard_rows + 1
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards))
    index = materialize(used.withColumn("shard", shard).groupBy("shard").applyInPandas(_build(k), "shard long, index binary"), "index")
    asked = _usable(queries).dropDuplicates(["vec_id"])
    blocks = asked.count() // BLOCK_QUERIES + 1
    asked = asked.groupBy(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))
    asked = materialize(asked.select("block", F.col("q.vec_id").alias("ids"), F.col("q.embedding").alias("vectors")), "queries")
    # the stated query set against all shards: the blocks of queries go to each shard, whose index is moved once
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    sent = asked.withColumn("shard", every).select("shard", "block", F.lit(None).cast("binary").alias("index"), "ids", "vectors")
    held = index.select("shard", F.lit(-1).cast("long").alias("block"), "index", *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("ids", "vectors")])
    met = held.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "block")
    found = met.select("index", "ids", "vectors").mapInPandas(_search(k), "query_id long, vec_id long, score double")
    discard(used)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
