"""Calibration as a table of steps, AURC by ranges, metrics over a stream, and blur, against plain Python."""

import math

import numpy as np
import pytest

from mirador.operators import calibration, images, metrics
from mirador.streaming import metrics as stream

SCHEMA = "decision string, ground_truth_should_abstain boolean, is_correct boolean, raw_confidence double"


def plain_steps(points):
    """(lo, hi, mean, n) by pooling over sorted float32 confidences."""
    by = {}
    for x, y in points:
        if x is not None and y is not None and not math.isnan(x):
            t, n = by.get(float(np.float32(x)), (0, 0))
            by[float(np.float32(x))] = (t + int(y), n + 1)
    out = []
    for x in sorted(by):
        out.append([x, x, *by[x]])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            b = out.pop()
            out[-1] = [out[-1][0], b[1], out[-1][2] + b[2], out[-1][3] + b[3]]
    return [(lo, hi, t / n, n) for lo, hi, t, n in out]


def plain_value(steps, x):
    if x is None or math.isnan(x):
        return x
    xs = [v for lo, hi, _, _ in steps for v in (lo, hi)]
    ys = [y for _, _, y, _ in steps for _ in range(2)]
    return float(np.interp(x, xs, ys))


def data(kind, n=2000):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, n) if kind != "few" else np.round(rng.uniform(0, 1, n), 1)
    if kind == "rising":
        return [(float(v), bool(v > 0.5)) for v in x]
    if kind == "falling":
        return [(float(v), bool(v < 0.5)) for v in x]
    if kind == "hot":
        x[: n // 3] = 0.25
    if kind == "outside":
        x = x * 4 - 2
    return [(float(v), bool(rng.uniform() < v)) for v in x]


@pytest.mark.parametrize("kind", ["noise", "few", "rising", "falling", "hot", "outside"])
@pytest.mark.parametrize(("ranges", "together"), [(128, 8), (16, 2), (1, 8)])
def test_steps_are_those_of_the_whole(spark, kind, ranges, together):
    rows = [*data(kind), (None, True), (0.5, None), (float("nan"), True)]
    df = spark.createDataFrame(rows, "raw_confidence double, is_correct boolean")
    model = calibration.isotonic_steps(metrics.confidence_targets(df), ranges, together)
    want = plain_steps(rows)
    got = sorted((r.lo, r.hi, r.y, r.n) for r in model.steps.collect())
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    probes = [None, float("nan"), -5.0, 5.0, 0.0, 1.0, 0.25, *np.random.default_rng(1).uniform(-2.2, 2.2, 60).tolist(), *[w[0] for w in want[:20]], *[w[1] for w in want[-20:]]]
    ask = spark.createDataFrame([(i, p) for i, p in enumerate(probes)], "i int, raw_confidence double")
    for most in (100_000, 0):
        said = {r.i: r.calibrated_confidence for r in calibration.apply_steps(ask, model, most=most).collect()}
        assert len(said) == len(probes)
        for i, p in enumerate(probes):
            v = plain_value(want, p)
            assert said[i] is None if v is None else math.isnan(said[i]) if math.isnan(v) else abs(said[i] - v) < 1e-9, (p, said[i], v)


def test_artifact_and_table_agree(spark):
    df = spark.createDataFrame(data("noise"), "raw_confidence double, is_correct boolean")
    artifact = metrics.fit_calibration(df)
    a = metrics.apply_calibration(df, artifact).select("raw_confidence", "calibrated_confidence").collect()
    b = calibration.apply_steps(df, calibration.isotonic_steps(metrics.confidence_targets(df))).select("raw_confidence", "calibrated_confidence").collect()
    assert np.allclose(sorted(x[1] for x in a), sorted(x[1] for x in b))
    row = artifact.first()
    assert row.num_samples == 2000 and row.x_thresholds == sorted(row.x_thresholds) and abs(row.mean_calibrated_confidence - np.mean([y for _, y in data("noise")])) < 1e-9


def test_nothing_to_calibrate_on(spark):
    with pytest.raises(ValueError, match="no confidence"):
        calibration.isotonic_steps(metrics.confidence_targets(spark.createDataFrame([(None, True)], "raw_confidence double, is_correct boolean")))


def test_fits_stay_on_the_executors(spark, monkeypatch):
    seen = []
    from pyspark.sql.classic.dataframe import DataFrame

    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    df = spark.createDataFrame(data("rising", 5000), "raw_confidence double, is_correct boolean")
    calibration.isotonic_steps(metrics.confidence_targets(df), 16)
    assert seen and max(map(len, seen)) <= 16


def plain_aurc(rows):
    by = {}
    for _, _, ok, c in rows:
        if c is not None:
            by.setdefault(float(np.float32(c)), []).append(not ok)
    total, n, bad = 0.0, 0, 0
    for c in sorted(by, key=lambda v: (not math.isnan(v), -v)):
        errors = sum(by[c])
        for i in range(1, len(by[c]) + 1):
            total += (bad + errors * i / len(by[c])) / (n + i)
        n, bad = n + len(by[c]), bad + errors
    return total / n if n else 0.0


@pytest.mark.parametrize("ranges", [128, 5, 1])
def test_aurc_by_ranges(spark, ranges):
    rng = np.random.default_rng(7)
    rows = [("answer", False, bool(rng.uniform() < 0.6), float(round(c, d))) for c in rng.uniform(-0.5, 1.5, 400) for d in (2, 9)] + [("answer", False, True, None), ("abstain", True, None, 0.5)]
    got = metrics.risk_coverage(spark.createDataFrame(rows, SCHEMA), ranges)
    assert abs(got.first().AURC - plain_aurc(rows)) < 1e-9
    assert metrics.risk_coverage(spark.createDataFrame([], SCHEMA)).first().AURC == 0.0


def test_aurc_needs_no_window_over_all(spark, monkeypatch):
    from mirador.sources import scratch

    plans = []
    write = scratch.Tables.write
    monkeypatch.setattr(scratch.Tables, "write", lambda self, df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df, *a, **k))
    metrics.risk_coverage(spark.createDataFrame([("answer", False, True, 0.5)], SCHEMA))
    windows = [line for p in plans for line in p.splitlines() if " Window " in f" {line} "]
    assert windows and not any("SinglePartition" in line for p in plans for line in p.splitlines() if "ENSURE" in line and "window" in line.lower())
    assert all("part#" in line.split("], [")[1] for line in windows)


def test_metrics_over_a_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(rng.choice(["answer", "abstain"]).item(), bool(rng.uniform() < 0.3), bool(rng.uniform() < 0.5), float(round(rng.uniform(-0.1, 1.2), 2))) for _ in range(300)] + [(None, None, None, None)]
    whole = spark.createDataFrame(rows, SCHEMA)
    (tmp_path / "in").mkdir()
    run = lambda: stream.metrics_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    for i in range(2):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], SCHEMA).toPandas().to_json(tmp_path / f"in/{i}.json", orient="records", lines=True)
    run()
    assert tuple(stream.latest_report(spark, str(tmp_path / "out")).first()) == pytest.approx(tuple(metrics.all_metrics(spark.createDataFrame(rows[:200], SCHEMA)).first()))
    spark.createDataFrame(rows[200:], SCHEMA).toPandas().to_json(tmp_path / "in/2.json", orient="records", lines=True)
    run()  # a later run goes on from the kept counts
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert tuple(stream.latest_report(spark, str(tmp_path / "out")).first()) == pytest.approx(tuple(metrics.all_metrics(whole).first()))


def test_blur_costs_the_same_at_any_radius():
    a = np.random.default_rng(0).integers(0, 256, (40, 30, 3)).astype(np.uint8)
    for radius in (0.5, 1.2, 2.4, 4.0, 11.0):
        half, share = images.box_of(radius)
        assert 0 <= share < 1
        assert abs(3 * (half * (half + 1) * (2 * half + 1) / 3 + 2 * share * (half + 1) ** 2) / (2 * half + 1 + 2 * share) - radius**2) < 1e-9
        assert images._blur(a, radius).shape == a.shape
    flat = np.full((5, 5, 3), 77, np.uint8)
    assert (images._blur(flat, 4.0) == 77).all()
