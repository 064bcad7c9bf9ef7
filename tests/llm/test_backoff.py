"""The language model against a model in dictionaries, and its automaton over chunks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from mirador.llm import backoff_lm as b

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP)), None]


class Plain:
    """Absolute discounting with backoff, by dictionaries: P(w|u) of a kept uw, else bow(u) * P(w|u without its first word)."""

    def __init__(self, texts, order, least, discount=0.5):
        said = [tokens(t) for t in texts]
        self.count = [Counter(tuple(t[i : i + n]) for t in said for i in range(len(t) - n + 1)) for n in range(1, order + 1)]
        self.total, self.types = sum(self.count[0].values()), len(self.count[0])
        self.order, self.discount = order, discount
        self.kept = [dict(self.count[0])] + [{g: c for g, c in k.items() if c >= least} for k in self.count[1:]]
        self.arcs = {}
        for k in self.kept[1:]:
            for g, c in k.items():
                self.arcs.setdefault(g[:-1], {})[g[-1]] = c
        self.memo = {}

    def context_total(self, u):
        return max(self.count[len(u) - 1][u], sum(self.arcs[u].values()))

    def bow(self, u):
        if u not in self.memo:
            mass = sum(c - self.discount for c in self.arcs[u].values()) / self.context_total(u)
            lower = sum(self.p(u[1:], w) for w in self.arcs[u])
            self.memo[u] = max(1 - mass, 1e-12) / max(1 - lower, 1e-12)
        return self.memo[u]

    def p(self, u, w):
        if not u:
            return (self.count[0].get((w,), 0) + 1) / (self.total + self.types + 1)
        if u not in self.arcs:
            return self.p(u[1:], w)
        if w in self.arcs[u]:
            return (self.arcs[u][w] - self.discount) / self.context_total(u)
        return self.bow(u) * self.p(u[1:], w)

    def score(self, text):
        t, out = tokens(text), 0.0
        for i, w in enumerate(t):
            u = tuple(t[max(0, i - self.order + 1) : i])
            while u and any((x,) not in self.count[0] for x in u):
                u = u[1:]
            out += math.log10(self.p(u, w))
        return out


def corpus(seed, n, letters="abcdefg"):
    rng = random.Random(seed)
    weights = [2.0 ** -i for i in range(len(letters))]
    return [(i, " ".join(rng.choices(letters, weights)[0] * rng.randint(1, 2) for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize(("order", "least", "chunk"), [(3, 3, 1 << 21), (3, 1, 200), (2, 2, 50), (4, 2, 1), (1, 1, 100)])
def test_against_dictionaries(spark, monkeypatch, order, least, chunk):
    monkeypatch.setattr(b, "CHUNK", chunk)
    rows = corpus(order, 150) + [(500, None), (501, ""), (502, "A  a\tB zz zz a"), (503, "unseen words a b only here"), (504, "a " * 3000)]
    train = [t for i, t in rows if i % 3 != 2 and i != 503]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, rows[1]]], "doc_id long, text string, n string").repartition(3)
    got = b.score_documents(df, df.where("doc_id % 3 != 2 and doc_id != 503").dropDuplicates(["doc_id"]), order, least).collect()
    plain = Plain(train, order, least)
    assert len(got) == len(rows) + 1
    texts = dict(rows)
    for r in got:
        assert abs(r.score - plain.score(texts[r.doc_id])) < 1e-7 * max(1, r.n_tokens), r.doc_id
        t = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum((w,) in plain.count[0] for w in t), plain.total)
        assert abs(r.base_score - sum(math.log10((plain.count[0].get((w,), 0) + 1) / (plain.total + plain.types + 1)) for w in t)) < 1e-9 * max(1, len(t))


def test_the_query_walks(spark, monkeypatch):
    """What the automaton's walk gives is the score: a walk that adds nothing leaves only the unknown words'."""
    df = spark.createDataFrame([(i, "a b a b c") for i in range(8)] + [(9, "a q")], "doc_id long, text string")
    train = df.where("doc_id < 8")
    real = {r.doc_id: r.score for r in b.score_documents(df, train).collect()}
    assert real[0] == pytest.approx(Plain(["a b a b c"] * 8, 3, 3).score("a b a b c"))
    # three failures at most lie between two tokens of a text in order 3: the unknown word falls back to the root
    assert real[9] == pytest.approx(Plain(["a b a b c"] * 8, 3, 3).score("a q"))


def test_bits_that_mark_everything_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(corpus(8, 60), "doc_id long, text string")
    want = {r.doc_id: r.score for r in b.score_documents(df, df, 3, 2).collect()}
    monkeypatch.setattr(b, "MARK_BITS", 15)
    got = {r.doc_id: r.score for r in b.score_documents(df, df, 3, 2).collect()}
    assert got == pytest.approx(want)


def test_a_batch_of_fewer_tokens_than_the_order(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for order in (3, 4, 5, 6):
        got = b.score_documents(df, df, order, 1).collect()
        assert [r.score for r in got] == pytest.approx([Plain(["a b"], order, 1).score("a b")])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 1000])
def test_places_of_hashes(n):
    rng = np.random.default_rng(n)
    known = np.unique(np.concatenate((rng.integers(0, 1 << 63, n, np.uint64) * b.U64(2), np.array([0, 5, (1 << 64) - 1][:n], np.uint64))))
    keys = np.concatenate((known, known + b.U64(1), rng.integers(0, 1 << 63, 100, np.uint64), np.array([0, 1, (1 << 64) - 2, (1 << 64) - 1], np.uint64)))
    at = {int(k): i for i, k in enumerate(known)}
    assert b.Places(known).find(keys).tolist() == [at.get(int(k), -1) for k in keys]


def test_distinct_hashes_and_buckets():
    keys = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    found, order, first = b._distinct(keys)
    want, times = np.unique(keys, return_counts=True)
    assert (found == want).all() and (keys[order[first]] == want).all() and (np.diff(first, append=len(keys)) == times).all()
    assert [len(x) for x in b._distinct(keys[:0])] == [0, 0, 0]
    for buckets in (7, (1 << 16) + 1):
        by, cut, names = b._by_bucket(want, buckets)
        assert [(k, x.tolist()) for k, x in zip(names.tolist(), np.split(want[by], cut), strict=True)] == [(k, [w for w in want.tolist() if w % buckets == k]) for k in sorted({w % buckets for w in want.tolist()})]
