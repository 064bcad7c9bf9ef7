"""Degradations of RGB images (height x width x 3, uint8) in numpy, run as an Arrow UDF over image structs."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By operator, its strength at low, medium and high severity.
STRENGTH = {
    "gaussian_blur": (1.2, 2.4, 4.0), "speckle_noise": (0.05, 0.12, 0.2), "resolution_drop": (0.8, 0.55, 0.35), "contrast_brightness_shift": (0.12, 0.22, 0.34),
    "random_crop": (0.92, 0.8, 0.65), "local_occlusion": (0.12, 0.22, 0.35), "center_mask": (0.18, 0.3, 0.42), "border_truncate": (0.08, 0.15, 0.22),
}


#: Off the true Gaussian by so much at most, in shares of the full range.
BLUR_TOLERANCE = 0.03


def strength(kind: str, severity: str) -> float:
    return STRENGTH[kind][{"low": 0, "high": 2}.get(severity, 1)]


def _resize(a: np.ndarray, h: int, w: int, cubic: bool) -> np.ndarray:
    """Separable resampling with an antialiased triangle or cubic (a = -0.5) kernel."""
    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        wide = max(scale, 1.0)
        d = np.abs((np.arange(n)[None, :] + 0.5 - (np.arange(m)[:, None] + 0.5) * scale) / wide)
        k = np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0)) if cubic else np.maximum(1 - d, 0)
        return k / k.sum(1, keepdims=True)

    out = np.einsum("ab,bcd->acd", weights(a.shape[0], h), a.astype(np.float64))
    out = np.einsum("ab,cbd->cad", weights(a.shape[1], w), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def box_of(radius: float, passes: int = 3) -> tuple[int, float]:
    """The extended box (half width, share of the two pixels beyond it) whose repetition has the variance radius ** 2: a box of
    2 h + 1 ones with e at both ends has the variance (h (h + 1) (2 h + 1) / 3 + 2 e (h + 1) ** 2) / (2 h + 1 + 2 e)."""
    variance = radius * radius / passes
    half = int((math.sqrt(12 * variance + 1) - 1) / 2)
    return half, (2 * half + 1) * (variance - half * (half + 1) / 3) / (2 * ((half + 1) ** 2 - variance))


def _blur(a: np.ndarray, radius: float, passes: int = 3) -> np.ndarray:
    """A Gaussian blur by repeated extended boxes: running sums, whose cost a pixel does not grow with the radius. Edge pixels are
    repeated outwards. Off the true Gaussian by less than BLUR_TOLERANCE of 255."""
    half, share = box_of(radius, passes)
    out, weight = a.astype(np.float64), 2 * half + 1 + 2 * share
    for axis in (0, 1):
        lines = np.moveaxis(out, axis, 0)
        edge = passes * (half + 1)
        lines = np.concatenate((np.repeat(lines[:1], edge, axis=0), lines, np.repeat(lines[-1:], edge, axis=0)))
        for _ in range(passes):  # each takes half + 1 off both ends
            n = len(lines) - 2 * half - 2
            sums = np.concatenate((np.zeros_like(lines[:1]), np.cumsum(lines, axis=0)))
            whole = sums[2 * half + 2 : 2 * half + 2 + n] - sums[1 : 1 + n]
            lines = (whole + share * (lines[:n] + lines[2 * half + 2 :])) / weight
        out = np.moveaxis(lines, 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def degrade(image: np.ndarray, kind: str, severity: str, rng: np.random.Generator) -> np.ndarray:
    """One degradation; the size stays. An unknown kind is an error, an unknown severity counts as medium."""
    if kind not in STRENGTH:
        raise ValueError(f"unknown degradation {kind}")
    h, w = image.shape[:2]
    s, out = strength(kind, severity), image.copy()
    if kind == "gaussian_blur":
        return _blur(image, s)
    if kind == "speckle_noise":
        x = image / 255.0
        return (np.clip(x + x * rng.normal(0, s, image.shape), 0, 1) * 255).astype(np.uint8)
    if kind == "resolution_drop":
        return _resize(_resize(image, max(1, int(h * s)), max(1, int(w * s)), False), h, w, True)
    if kind == "contrast_brightness_shift":
        contrast, bright = rng.uniform(1 - s, 1 + s, 2)
        mean = np.rint((image @ np.array([0.299, 0.587, 0.114])).mean())
        shifted = np.clip(mean + (image.astype(np.float64) - mean) * contrast, 0, 255).astype(np.uint8)
        return np.clip(shifted * bright, 0, 255).astype(np.uint8)
    if kind == "random_crop":
        ch, cw = max(1, int(h * s)), max(1, int(w * s))
        top, left = int(rng.integers(0, h - ch + 1)), int(rng.integers(0, w - cw + 1))
        return _resize(image[top : top + ch, left : left + cw], h, w, True)
    if kind == "local_occlusion":
        bh, bw = max(1, int(h * s)), max(1, int(w * s))
        top, left = int(rng.integers(0, h - bh + 1)), int(rng.integers(0, w - bw + 1))
        out[top : top + bh, left : left + bw] = 0
        return out
    if kind == "center_mask":
        bh, bw = int(h * s), int(w * s)
        top, left = (h - bh) // 2, (w - bw) // 2
        out[top : top + bh, left : left + bw] = 0
        return out
    cut = image[int(h * s) :, int(w * s) :]  # border_truncate: left and top
    scale = min(h / cut.shape[0], w / cut.shape[1])
    nh, nw = max(1, min(h, round(cut.shape[0] * scale))), max(1, min(w, round(cut.shape[1] * scale)))
    out[:] = 0
    out[(h - nh) // 2 : (h - nh) // 2 + nh, (w - nw) // 2 : (w - nw) // 2 + nw] = _resize(cut, nh, nw, True)
    return out


def degrade_column(data: Column, height: Column, width: Column, kind: Column, severity: Column, key: Column) -> Column:
    """Degraded bytes of images of three bytes a pixel (as read_images gives them); `key` seeds the draws. Null where the bytes
    are null or not height x width x 3 of them."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, h: pd.Series, w: pd.Series, k: pd.Series, s: pd.Series, seed: pd.Series) -> pd.Series:
        out = []
        for a, b, c, e, f, g in zip(d, h, w, k, s, seed, strict=True):
            whole = a is not None and b > 0 and c > 0 and len(a) == b * c * 3
            rng = np.random.default_rng(zlib.crc32(str(g).encode()))
            out.append(degrade(np.frombuffer(a, np.uint8).reshape(int(b), int(c), 3), e, f, rng).tobytes() if whole else None)
        return pd.Series(out, dtype=object)

    return run(data, height, width, kind, severity, key)


def to_rgb(data: Column, channels: Column) -> Column:
    """RGB bytes of the image source's: grey is repeated, of blue, green, red (and alpha) the order is turned."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else turned(a, int(c)) for a, c in zip(d, n, strict=True)], dtype=object)

    return run(data, channels)


def turned(data: bytes, channels: int) -> bytes:
    pixels = np.frombuffer(data, np.uint8).reshape(-1, channels)
    return (np.repeat(pixels, 3, axis=1) if channels == 1 else np.ascontiguousarray(pixels[:, 2::-1])).tobytes()


def png(data: bytes, height: int, width: int) -> bytes:
    """A PNG file of RGB bytes."""
    lines = np.frombuffer(data, np.uint8).reshape(height, width * 3)
    raw = np.concatenate((np.zeros((height, 1), np.uint8), lines), axis=1).tobytes()  # a filter byte, none, before each line

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def save_images(images: DataFrame, root: str) -> DataFrame:
    """Writes each row's (file_name, data, height, width) below root as a PNG file and gives its path in image_path, null where
    data is null. The files are written by the tasks that hold the rows, again should a task be run again; root must be
    on a file system that every executor and pyarrow reach. Further columns are kept, data is not."""
    out = images.drop("data").withColumn("image_path", F.lit(None).cast("string")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        for pdf in frames:
            paths = []
            for name, data, h, w in zip(pdf["file_name"], pdf["data"], pdf["height"], pdf["width"], strict=True):
                path = None if data is None else f"{base}/{name}"
                if path:
                    with store.open_output_stream(path) as f:
                        f.write(png(data, int(h), int(w)))
                paths.append(path)
            yield pdf.drop(columns="data").assign(image_path=paths)

    return images.mapInPandas(run, out)


def center_mask_array(values: Column, side: Column, ratio: float) -> Column:
    """The centre mask on a square single-channel image held as a row-major array, without Python."""
    box = F.floor(side * F.lit(ratio)).cast("int")
    begin = F.floor((side - box) / 2).cast("int")
    inside = lambda i: (i >= begin) & (i < begin + box)
    return F.transform(values, lambda v, i: F.when(inside(F.floor(i / side)) & inside(i % side), F.lit(0.0)).otherwise(v.cast("double")))
