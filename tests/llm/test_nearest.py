"""Nearest neighbours against brute force, on vectors of unlike norms, over several shards, with ties."""

import numpy as np
import pytest

from mirador.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>"


def vectors(kind, n, d=64):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, d))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "log-normal":
        x *= rng.lognormal(0, 1, size=(n, 1))
    if kind == "clusters":
        x = rng.normal(size=(20, d))[rng.integers(0, 20, n)] + 0.1 * x
    return x.astype(np.float32)


def recall(spark, x, shard_rows):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    rows = hnsw.nearest(df, df.where("vec_id % 20 = 0"), 20, shard_rows).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, len(x), 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21)) and len({g[1] for g in got}) == 20 and q not in {g[1] for g in got}
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in got)
        assert [(-score, v) for _, v, score in got] == sorted((-score, v) for _, v, score in got)
        hits += sum(s[v] >= np.sort(s)[-20] for _, v, _ in got)
    return hits / (20 * len(range(0, len(x), 20)))


@pytest.mark.parametrize("kind", ["gaussian", "log-normal", "unit", "clusters"])
def test_recall_over_several_shards(spark, kind):
    assert recall(spark, vectors(kind, 8192), 2100) >= 0.93


def test_recall_in_one_large_shard(spark):
    assert recall(spark, vectors("gaussian", 8000), 8192) >= 0.93


def test_beams_grow_only_where_they_must():
    easy = hnsw.Index.build(np.arange(4000), vectors("clusters", 4000, 16))
    assert easy.beam == hnsw.SEARCH_BEAM
    hard = hnsw.Index.build(np.arange(4000), vectors("log-normal", 4000, 96))
    assert hard.beam == 0 or hard.beam >= hnsw.SEARCH_BEAM


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((np.repeat(rng.normal(size=(3, 8)), 40, axis=0), rng.normal(size=(600, 8)) * 0.1)).astype(np.float32)
    ids = rng.permutation(len(x)) * 10
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = hnsw.nearest(df, df.where("vec_id % 20 = 0"), 20, 150).collect()
    for q in range(0, 10 * len(x), 20):
        s = x.astype(np.float64) @ x[np.flatnonzero(ids == q)[0]].astype(np.float64)
        want = sorted((-a, int(i)) for a, i in zip(s, ids, strict=True) if i != q)[:20]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        if abs(s[np.flatnonzero(ids == q)[0]]) > 1:  # among the copies
            assert mine == [i for _, i in want]
