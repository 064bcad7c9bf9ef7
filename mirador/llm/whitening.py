"""Whitening of embeddings: principal components by a randomised range finder with power passes, and rows projected on them.

Rows whose vector is null or holds null or non-finite entries are dropped. Entries become whole numbers, floor(scale * c); shorter
vectors count as filled up with zeros, an empty one is all zeros. Components are fitted on the distinct vectors (the fit list), so
copies weigh nothing and a vector that a third of all rows share counts once. An empty table gives no rows. A component without
variance (fewer independent directions than components, one distinct vector) keeps its row with `whitened` null and, where there
is no variance at all, `explained` null; a table of fewer dimensions than components has fewer components. `deviation` is exact;
beyond the range of a long it is null. Repeated rows, null ids and tied components stay as they come; columns other than the id
and the vector are not read, whatever their names.

Every pass reads the whole fit list in Arrow batches, centres rows before it multiplies them, and adds up one small matrix (dimensions
by block width) a task, entry by entry, in Spark; the driver holds that matrix alone, whose size depends on the dimension only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import discard, materialize, releasing, small_batches

#: Eigenvectors are taken as found once the residual is below this share of the gap to the next value.
TOLERANCE = 2.0**-44


def _flat(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries as doubles (null is NaN), where each vector begins, and its length; a null vector is one NaN long."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    absent = pa.scalar([None], vectors.type)
    vectors = vectors.fill_null(absent) if vectors.null_count else vectors
    flat = vectors.flatten()
    entries = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
    return entries, np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes


def _quantized(scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            entries, begin, sizes = _flat(b.column(1))
            bad = np.zeros(len(entries) + 1, np.int64)
            np.cumsum(~np.isfinite(entries), out=bad[1:])
            good = bad[begin + sizes] == bad[begin]
            limit = float(np.iinfo(np.int64).max - 1024)
            whole = np.clip(np.floor(np.where(np.isfinite(entries), entries, 0.0) * scale), -limit, limit).astype(np.int64)
            x = pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(entries)])).astype(np.int32)), pa.array(whole))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), x.filter(keep)], names=["id", "x"])

    return releasing(run)


def quantize(df: DataFrame, id_column: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(id, x): the rows that take part, their entries times `scale` and rounded down, as longs."""
    small_batches(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_quantized(scale), f"id {kind}, x array<bigint>")


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def _added(fit: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """The sum over all rows of fit of the matrices that `part` makes of blocks of rows."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            total += part(_matrix(b.column(0), dims))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "value"])

    out = np.zeros(shape[0] * shape[1])
    for r in fit.select("x").mapInArrow(releasing(run), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(shape)


class Components:
    """n vectors with sums S; unit vectors (columns) by falling eigenvalue; trace of the covariance; identity_error; and how the
    components were found: passes made and whether the block grew to the full dimension."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float, passes: int, full: bool):
        self.n, self.sums, self.vectors, self.values, self.trace, self.passes, self.full = n, sums, vectors, values, trace, passes, full
        self.mean = np.array([s / n for s in sums])
        self.identity_error: float | None = None

    def sound(self) -> np.ndarray:
        """Which components have a variance that is more than rounding."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        scale = np.where(self.sound(), 1 / np.sqrt(np.where(self.sound(), self.values, 1.0)), np.nan)
        return ((x - self.mean) @ self.vectors) * scale


def _totals(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and exact sums by dimension: tasks add high and low halves of longs apart, for up to 2**31 rows each."""

    def run(batches):
        total, n = np.zeros((0, 2), np.int64), 0
        for b in batches:
            dims = max(len(total), int(np.diff(b.column(0).offsets.to_numpy()).max(initial=0)))
            x = _matrix(b.column(0), dims)
            n += len(x)
            total = np.vstack((total, np.zeros((dims - len(total), 2), np.int64))) + np.stack(((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)), axis=1)
        high, low = np.concatenate(([n], total[:, 0])), np.concatenate(([0], total[:, 1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)) - 1), pa.array(high), pa.array(low)], names=["at", "high", "low"])

    whole = [F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in ("high", "low")]
    got = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in fit.select("x").mapInArrow(releasing(run), "at long, high long, low long").groupBy("at").agg(*whole).collect()}
    return got.get(-1, 0) >> 32, [got[i] for i in range(len(got) - 1)]


def find_components(fit: DataFrame, components: int = 4, oversample: int = 8, passes: int = 6, seed: int = 7) -> Components | None:
    """Components of the rows x of fit; None of an empty table.

    A random block of components + oversample columns is multiplied by the covariance and made orthonormal, pass by pass; Rayleigh-Ritz
    in the block gives eigenvectors, and its residuals, set against the gaps between values, say whether they are exact to double
    precision. If they are not after `passes` passes, or their fall so far says they will not be, the block becomes the whole
    space: one pass more, after which Rayleigh-Ritz is exact."""
    n, sums = _totals(fit)
    if not n or not sums:
        return None
    dims = len(sums)
    mean = np.array([s / n for s in sums])
    width, q = min(dims, components + oversample), None
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, width)))[0] if width < dims else np.eye(dims)
    made, last, take = 0, np.inf, min(components, dims)
    while True:

        def part(x: np.ndarray, q=q) -> np.ndarray:
            c = x - mean
            return np.vstack((c.T @ (c @ q), np.full((1, q.shape[1]), (c * c).sum())))

        got = _added(fit, (dims + 1, q.shape[1]), part, dims) / n
        product, trace = got[:-1], float(got[-1, 0])
        made += 1
        inner = q.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found = Components(n, sums, (q @ turn)[:, :take], np.maximum(values[:take], 0.0), trace, made, q.shape[1] == dims)
        if found.full:
            return found
        residual = np.linalg.norm(product @ turn - (q @ turn) * values, axis=0)
        apart = np.abs(values[:, None] - values[None, :]) + np.where(np.eye(width, dtype=bool), np.inf, 0.0)
        worst = float(np.max(residual[:take] / np.maximum(apart[:take].min(axis=1), np.finfo(float).tiny)))
        if worst <= TOLERANCE:
            return found
        fall = min(worst / last, 1.0)
        hopeless = made >= 2 and worst * fall ** (passes - made) > TOLERANCE
        q = np.eye(dims) if made >= passes or hopeless else np.linalg.qr(product)[0]
        last = worst


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 4, scale: float = 256.0, oversample: int = 8, passes: int = 6) -> DataFrame:
    """For each remaining row and component: the id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark, kind = df.sparkSession, df.schema[id_column].dataType.simpleString()
    rows = quantize(df, id_column, vector, scale)
    fit = materialize(rows.select("x").distinct(), "fit-list")
    schema = f"{id_column} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    try:
        model = find_components(fit, components, oversample, passes)
        if model is None:
            return spark.createDataFrame([], schema)
        dims, take = len(model.sums), model.vectors.shape[1]

        def spread(x: np.ndarray) -> np.ndarray:
            z = np.nan_to_num(model.project(x))
            return np.vstack((z.T @ z, z.sum(axis=0)))

        got = _added(fit, (take + 1, take), spread, dims) / model.n
        off = np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(take))[np.ix_(model.sound(), model.sound())]
        model.identity_error = float(off.max()) if off.size else None
    finally:
        discard(fit)
    return rows.mapInArrow(_projected(model, id_column), schema)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * x - S)^2; null beyond a long."""
    rough = ((x.astype(np.float64) * n - np.array(sums, np.float64)) ** 2).sum(axis=1)
    if (rough < 2.0**60).all() and max(map(abs, sums)) < 2**62 and (np.abs(x.astype(np.float64)) * n < 2.0**62).all():
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def _projected(model: Components, id_column: str):
    take, explained = model.vectors.shape[1], [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), len(model.sums))
            white, far, rows = model.project(x), _deviations(x, model.n, model.sums), len(x)
            at = np.repeat(np.arange(rows), take)
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, take + 1, dtype=np.int32), rows)), pa.array(np.full(rows * take, model.n)),
                    pa.array(far, pa.int64()).take(pa.array(at)), pa.array(flat, mask=np.isnan(flat)), pa.array(explained * rows, pa.float64()),
                    pa.array([model.identity_error] * (rows * take), pa.float64()),
                ],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return releasing(run)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
