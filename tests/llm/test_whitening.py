"""Whitening against numpy over whole tables."""

import math

import numpy as np
import pytest

from mirador.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, x string, id string"


def plain(rows, components=4):
    """(ids, n, deviations, whitened, explained) by eigh of the whole covariance."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in good)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v)) for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array(fit, float) - np.array(sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    far = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [i for i, _ in good], n, far, (np.array(x, float) - np.array(sums) / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def compare(spark, rows, components=4):
    got = w.whiten(spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA), components=components).collect()
    ids, n, far, white, explained = plain(rows, components)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k + 1) for i in ids for k in range(white.shape[1]))
    assert {r.n for r in got} == {n}
    assert sorted({(r.vec_id, r.deviation) for r in got}) == sorted(set(zip(ids, far, strict=True)))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for k in range(white.shape[1]):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        a, b = np.array([mine[i] for i in ids]), white[:, k]
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-8
        assert all(abs(r.explained - explained[k]) < 1e-9 for r in got if r.component == k + 1)


def test_against_numpy_with_bad_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=20) * np.linspace(1, 0.2, 20)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(2000, None), (2001, [float("nan")] * 20), (2002, [None] + [1.0] * 19), (2003, [float("inf")] + [0.0] * 19), (2004, [1.0, 2.0]), (2005, [])]
    rows += [rows[5]]
    compare(spark, rows)


def test_falling_spectrum_needs_no_full_dimension(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=64) * 4.0 * 0.5 ** np.arange(64)]) for i in range(500)]
    fit = w.quantize(spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA), "vec_id", "embedding").select("x").distinct()
    found = w.find_components(fit)
    assert not found.full and 1 < found.passes <= 6
    compare(spark, rows)
    flat = [(i, [float(c) for c in rng.normal(size=64)]) for i in range(500)]
    fit = w.quantize(spark.createDataFrame([(i, v, "", "") for i, v in flat], SCHEMA), "vec_id", "embedding").select("x").distinct()
    assert w.find_components(fit).full
    compare(spark, flat)


def test_hidden_direction_outside_the_first_block_is_found(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=40) + (40.0 * rng.normal() if i % 2 else 0.0) * np.eye(40)[37]]) for i in range(400)]
    compare(spark, rows)


def test_few_dimensions_and_no_variance(spark):
    compare(spark, [(i, [float(i % 7), float(i * i % 11)]) for i in range(50)])
    one = w.whiten(spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0, 5.0], "", "") for i in range(3)], SCHEMA)).collect()
    assert len(one) == 12 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.explained is None for r in one)
    line = w.whiten(spark.createDataFrame([(i, [float(i), 0.0, 0.0], "", "") for i in range(5)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-9


def test_empty_tables(spark):
    assert w.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert w.whiten(spark.createDataFrame([(1, None, "", "")], SCHEMA)).collect() == []


def test_deviations_are_exact_or_null():
    x = np.array([[2**40, -(2**40)], [3, 5]], np.int64)
    sums = [2**40 + 3, 5 - 2**40]
    want = [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert w._deviations(x, 2, sums) == [v if v < 2**63 else None for v in want] == [None, None]
    assert w._deviations(np.array([[2**31, 3]], np.int64), 1, [0, 0]) == [2**62 + 9]


def test_sums_are_exact(spark):
    df = spark.createDataFrame([([2**62, -1],), ([2**62, -1],), ([2**62 + 1, -(2**62)],), ([],)], "x array<bigint>").repartition(3)
    assert w._totals(df) == (4, [3 * 2**62 + 1, -2 - 2**62])


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query(spark, name):
    got = w.op11_embedding_whitening(spark, f"/root/testdata/{name}")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").collect()]
    ids, n, far, white, explained = plain(rows)
    found = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(found) == 4 * len(ids)
    assert all(found[i, 1].deviation == f and found[i, 1].n == n for i, f in zip(ids, far, strict=True))
    for k in range(4):
        a = np.array([found[i, k + 1].whitened for i in ids])
        assert np.abs(a * np.sign(a @ white[:, k]) - white[:, k]).max() < 1e-8
