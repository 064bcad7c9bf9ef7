"""Candidates of the n-gram Jaccard join: none by shared passages alone, and none lost."""

import random

import numpy as np

from mirador.llm import jaccard_join


def test_passages_of_unlike_documents_make_no_candidates(spark, monkeypatch):
    """Each document shares a passage with the next one, too few times to be frequent: candidates must not become one group."""
    rng, words = random.Random(4), [f"w{k}" for k in range(20000)]
    passages = [[rng.choice(words) for _ in range(90)] for _ in range(301)]
    own = [[rng.choice(words) for _ in range(130)] for _ in range(300)]
    texts = [" ".join(passages[i] + own[i] + passages[i + 1]) for i in range(300)]
    texts += [t + " again" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes, real = [], jaccard_join.connected_components

    def counted(edges, *more):
        out = real(edges, *more)
        nodes.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "connected_components", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: i - 300 if i >= 300 else i for i in range(320)}
    assert nodes[0] == 40


def test_large_groups_with_one_signature_lose_no_link():
    """The pairs that a large group's links connect are those that meeting all with all connects."""
    rng = np.random.default_rng(2)
    for m in (65, 300):
        n = np.sort(rng.integers(60, 100, m)).astype(np.int64)
        centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        marks = centres[rng.integers(0, 4, m)]
        for _ in range(9):
            marks = marks ^ (np.uint64(1) << rng.integers(0, 64, m).astype(np.uint64))
        k = rng.permutation(m).astype(np.int64)
        links = jaccard_join._Links()
        jaccard_join._peeled(k, n, marks, np.ones(m, np.int64), 80, links)
        i, j = np.triu_indices(m, 1)
        near = (100 * n[i] >= 80 * n[j]) & jaccard_join.near_marks(n[i], n[j], marks[i], marks[j], 1, 80)
        want = jaccard_join.local_labels(k[i][near], k[j][near])
        linked = jaccard_join.local_labels(*links.least())
        assert dict(zip(*map(np.ndarray.tolist, want), strict=True)) == dict(zip(*map(np.ndarray.tolist, linked), strict=True))


def test_marks_of_similar_sets_are_near():
    rng, met = np.random.default_rng(1), 0
    for _ in range(600):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 2000)), dtype=np.uint64))
        if rng.integers(0, 3) == 0:  # hashes so uneven that windows are left without shingles
            base = np.unique(base >> rng.integers(0, 12, len(base)).astype(np.uint64))
        n = len(base)
        keep = rng.permutation(base)[int(rng.integers(0, n // 5 + 1)) :]
        other = np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(base, other))
        if 100 * both < 80 * (n + len(other) - both):
            continue
        met += 1
        heavy = np.packbits(rng.random(1 << jaccard_join.HEAVY_BITS) < 0.3 if met % 50 == 0 else np.zeros(1 << jaccard_join.HEAVY_BITS, bool), bitorder="little")
        (t, x, w), (u, y, v) = (jaccard_join.marked(s, 80, heavy) for s in (base, other))
        _, i, j = np.intersect1d(t, u, return_indices=True)
        w, v = jaccard_join.cuts_of(w[i]), jaccard_join.cuts_of(v[j])
        assert (w == v).all() and jaccard_join.near_marks(np.int64(n), np.int64(len(other)), x[i], y[j], w, 80).any()
    assert met > 150
