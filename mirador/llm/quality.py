"""Quality classifier: supervised subword embeddings. Hashed word and character n-gram vectors are averaged per document and
put through a softmax layer; both are learned together by stochastic gradient descent in numpy.

Scoring uses that the layer is linear: each feature's vector is multiplied by the output weights once, so a document's
logit is the mean of one number per feature."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import U64, doc_chunks, hash_words, hashes, mix, small_batches, text_buffer

#: Hash buckets of words and of character n-grams together, the vectors' length, and n-gram lengths in bytes.
BUCKETS, DIMENSION, LENGTHS = 1 << 17, 12, (3, 4)
#: The classifier is fitted on so many labelled texts (those of smallest hash).
FIT_ROWS = 8000


def features(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of documents i to j-1 and each one's document, counted from i. Words: runs without white space, A-Z
    lower-cased. N-grams: of the bytes as they stand, so case and signs count; none crosses two documents."""
    words, doc = hash_words(data, offsets, i, j, "space")
    out, owner = [(mix(words + U64(1)) & U64(BUCKETS - 1)).astype(np.int32)], [doc.astype(np.int32)]
    lo, hi = int(offsets[i]), int(offsets[j])
    b = data[lo:hi].astype(U64)
    own = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(offsets[i : j + 1]))
    for n in LENGTHS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, U64)
        for k in range(n):
            h = (h << U64(8)) | b[k : k + m]
        same = own[:m] == own[n - 1 :]
        out.append((mix(h[same]) & U64(BUCKETS - 1)).astype(np.int32))
        owner.append(own[:m][same])
    return np.concatenate(out), np.concatenate(owner)


@dataclass
class QualityModel:
    """table: per feature, what it adds to the logit of label 1 over label 0."""

    table: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_buffer(texts)
        out = np.zeros(len(texts))
        for i, j in doc_chunks(offsets, 1 << 19):
            f, doc = features(data, offsets, i, j)
            n = np.bincount(doc, minlength=j - i)
            out[i:j] = np.bincount(doc, weights=self.table[f], minlength=j - i) / np.maximum(n, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -35, 35)))


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 4.0, seed: int = 3) -> QualityModel:
    """Stochastic gradient descent, one document a step, the rate falling to 0. counts: for each document its distinct
    features and how often each occurs."""
    if not len(counts) or labels.min() == labels.max():
        p = float(labels[0]) if len(labels) else 0.5
        return QualityModel(np.zeros(BUCKETS, np.float32), float(np.log((p + 0.01) / (1.01 - p))))
    rows = [(f, (c / np.float32(max(c.sum(), 1))).astype(np.float32, copy=False)) for f, c in counts]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    order, step, steps = np.arange(len(rows)), 0, epochs * len(rows)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            lr = rate * (1 - step / steps)
            step += 1
            f, c = rows[i]
            h = c @ vectors[f] if len(f) else np.zeros(DIMENSION, np.float32)
            z = out @ h + bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[labels[i]] -= 1
            back = g @ out
            out -= lr * 0.25 * np.outer(g, h)
            bias -= lr * 0.02 * g
            if len(f):
                vectors[f] -= np.float32(lr * 4) * c[:, None] * back
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def training_fold(col: str = "doc_id"):
    """Rows to learn from: crc32 of the doc_id as text, mod 5, is not 0."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint32)


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the distinct features, as differences, and their counts; packed, as they all go to the driver."""
    for batch in batches:
        data, offsets = text_buffer(batch["text"])
        for i in range(len(offsets) - 1):
            f, c = np.unique(features(data, offsets, i, i + 1)[0], return_counts=True)
            blobs = [pa.array([_packed(x)], pa.binary()) for x in (np.diff(f, prepend=0), c)]
            yield pa.RecordBatch.from_arrays([*(batch[k][i : i + 1] for k in ("doc_id", "th", "quality")), *blobs], ["doc_id", "th", "quality", "f", "c"])


def train_quality_model(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on docs (doc_id, text) with labels (doc_id, quality): FIT_ROWS of the labelled documents of the training
    fold. A doc_id with both labels is left out; of texts that share a doc_id that of the smallest hash is learned."""
    usable = labels.where(training_fold() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    small_batches(docs.sparkSession)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("doc_id", hashes().alias("th"), F.col("quality").cast("long").alias("quality"), "text")
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("th", "quality", "text")).alias("x")).select("doc_id", "x.*")  # one text for each doc_id
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(_sample_counts, f"doc_id {kind}, th long, quality long, f binary, c binary").toPandas().sort_values(["doc_id", "th"], kind="stable")
    counts = [(np.cumsum(_unpacked(f)).astype(np.int32), _unpacked(c).astype(np.float32)) for f, c in zip(found["f"], found["c"], strict=True)]
    return fit(counts, found["quality"].to_numpy(np.int64))


def score_quality(docs: DataFrame, model: QualityModel, least: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs (doc_id, text): the probability of label 1 of each whole text.

    Null and empty texts have no features and get the bias alone. Rows are independent; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shared.value.scores(batch["text"]), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by a model of the labelled ones of the training fold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, train_quality_model(docs, labels))
    return scored.select("doc_id", (~training_fold()).alias("held_out"), "score", "predicted")
