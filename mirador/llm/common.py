"""Shared helpers: folders all executors see, partition counts, and text hashing over Arrow buffers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


class _Written(threading.local):
    """Folders written so far by the operators of this thread."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a temporary one in local mode, as in tests; on a cluster
    that is an error, as a machine's own folder is no shared one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[(\d+|\*)(, *\d+)?\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="mirador-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], ignore_errors=True)
    return "file://" + _LOCAL_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/mirador-{name}-{uuid.uuid4().hex}"
    _WRITTEN.paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.mirador_path = path
    return out


def written() -> int:
    """How many folders this thread wrote so far; what discard_since(spark, n) may delete are those after the first n."""
    return len(_WRITTEN.paths)


def discard_since(spark: SparkSession, n: int, *keep: DataFrame) -> None:
    """Deletes all folders written since written() was n, but for those of the materialized frames of keep."""
    kept = [df.mirador_path for df in keep]
    for path in _WRITTEN.paths[n:]:
        if path not in kept:
            _delete(spark, path)
    _WRITTEN.paths[n:] = kept
    spark._jvm.System.gc()


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, whose written folders are deleted if it fails."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        begun = written()
        try:
            return query(spark, sf_dir)
        except BaseException:
            discard_since(spark, begun)
            raise

    return run


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that no later plan reads. The driver's JVM then collects garbage, as Spark
    deletes shuffle files of finished plans only after that."""
    for df in frames:
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles() if "/mirador-" in x}:
            _delete(df.sparkSession, path)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def told(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table, marked to be broadcast if its rows, counted, are `most` at most; about 40 bytes each."""
    return F.broadcast(df) if df.count() <= most else df


def planned_bytes(df: DataFrame) -> int:
    """Spark's own size estimate (file sizes for scans), without running anything; the bytes of text, counted, where it has
    none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 58:
        size = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return size


def n_buckets(df: DataFrame, each: int = 16 << 20, spread: bool = True) -> int:
    """Hash buckets so that each holds what about `each` input bytes yield; where spread, at least the shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if spread else 1
    return int(max(least, planned_bytes(df) // each + 1))


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Bounds the Arrow batches that Python workers get, by rows and bytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def release() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task, next to other workers and a JVM."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with memory released at the end of each task."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- hashing of words in Arrow string buffers

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
#: One odd multiplier for each place in an n-gram.
PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], U64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE_WORD = np.ones(256, bool)
_SPACE_WORD[[32, *range(9, 14)]] = False
_ALNUM_WORD = np.zeros(256, bool)
_ALNUM_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
WORD_BYTES = {"space": _SPACE_WORD, "alnum": _ALNUM_WORD}
#: The same as tables for bytes.translate, which is faster than an index.
_TO_LOWER = _LOWER.tobytes()
_TO_WORD = {k: v[_LOWER].tobytes() for k, v in WORD_BYTES.items()}


def powers(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            x = np.full(n, base, U64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of all texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def doc_chunks(offsets: np.ndarray, most: int = 1 << 19):
    """Ranges of documents of up to `most` bytes together; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hash_words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of documents i to j-1, A-Z lower-cased, and each word's document (counted from i)."""
    lo, hi = int(offsets[i]), int(offsets[j])
    given = data[lo:hi].tobytes()
    if not given:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    b = np.frombuffer(given.translate(_TO_LOWER), np.uint8)
    word = np.frombuffer(given.translate(_TO_WORD[kind]), bool)
    cut = np.zeros(len(b) + 1, bool)
    cut[offsets[i:j] - lo] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | cut[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, U64)
    np.cumsum((b.astype(U64) + U64(1)) * up[: len(b)], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
    return h, np.repeat(np.arange(j - i), np.diff(np.searchsorted(s, offsets[i : j + 1] - lo)))


def shingle_sets(texts: pa.Array, size: int = 5, kind: str = "space"):
    """For each text its sorted distinct 63-bit shingle hashes; fewer words than `size` make one shingle."""
    data, offsets = text_buffer(texts)
    for i, j in doc_chunks(offsets):
        h, doc = hash_words(data, offsets, i, j, kind)
        ends = np.searchsorted(doc, np.arange(j - i), "right")
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        n = len(h) - size + 1
        grams = np.zeros(0, U64)
        if n > 0:
            grams = h[:n] * PLACE[0]
            for k in range(1, size):
                grams = grams + h[k : k + n] * PLACE[k]
            grams = mix(grams) >> U64(1)
        for k in range(j - i):
            a, z = int(begins[k]), int(ends[k])
            if z - a >= size:
                yield np.unique(grams[a : z - size + 1])
            elif z > a:
                yield mix(np.array([(h[a:z] * PLACE[: z - a]).sum(dtype=U64) + U64(z - a)], U64)) >> U64(1)
            else:
                yield np.zeros(0, U64)


def hashes(col: str = "text"):
    """The native 64-bit hash of a text, null being empty."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and, for each, the least node of its component; a and b are the ends of edges."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != label[label]).any():
            label = label[label]
        keep = label[x] != label[y]
        x, y = x[keep], y[keep]
    return nodes, nodes[label]
