"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with L1 and L2 penalties, its probabilities calibrated by one temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import U64, mix, small_batches

#: Hashed n-gram features, and the n-gram lengths in characters.
FEATURES = 1 << 16
LENGTHS = (1, 2, 3)
#: The classifier is fitted on about so many labelled texts, drawn by hash, and on about LANG_ROWS or all of each language.
FIT_ROWS, LANG_ROWS = 6000, 50
UNDETERMINED = "und"
_MULT = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of the texts, a matrix of len(LENGTHS) rows, and each text's number of characters.

    Texts are lower-cased; white space is one kind of character, and every text has one before and after it, so every
    text has n-grams of all lengths and none crosses two texts: those that would are counted as the border character's.
    """
    parts = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    code = np.where((code <= 32) | (code == 160), U64(32), code)
    sizes = np.array([len(p) for p in parts], np.int64)
    h = code * _MULT[0]
    rows = [h]
    for k in range(1, max(LENGTHS)):
        nxt = np.roll(code, -k) * _MULT[k]
        h = (h ^ (h >> U64(29))) * _MULT[1] + nxt
        rows.append(h)
    ends = np.cumsum(sizes)
    out = np.stack([(mix(r + U64(n)) & U64(FEATURES - 1)).astype(np.int32) for n, r in enumerate(rows, 1)])
    for n in range(1, len(LENGTHS)):
        for back in range(1, n + 1):
            at = ends - back
            out[n, at] = out[0, at]
    return out, sizes


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _chunks(texts: list[str], most: int = 1 << 18):
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= most):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


@dataclass
class LanguageModel:
    """weights: FEATURES x classes, idf folded in. A text's logits are the mean weight of its n-grams plus the bias."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.classes)))
        for i, j in _chunks(texts):
            grams, sizes = ngrams(texts[i:j])
            value = self.weights[grams[0]]
            for row in grams[1:]:
                value += self.weights[row]
            begins = np.cumsum(sizes) - sizes
            out[i:j] = np.add.reduceat(value, begins, axis=0, dtype=np.float64) / sizes[:, None]
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        clear = [has_letter(t) for t in texts]
        label, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        at = [k for k, ok in enumerate(clear) if ok]
        if at and self.classes:
            p = softmax(self.logits([texts[k] for k in at]) / self.temperature)
            best = p.argmax(1)
            score[at] = p.max(1)
            for k, b in zip(at, best.tolist(), strict=True):
                label[k] = self.classes[b]
        return label, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(counts: list[tuple[np.ndarray, np.ndarray, int]], labels: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3, batch: int = 16, scale: float = 30.0, seed: int = 7) -> LanguageModel:
    """FTRL-proximal over mini-batches; every fifth text is held back to set the temperature. counts: for each text its
    distinct features, how often each comes, and its number of characters."""
    classes = sorted(set(labels))
    if not classes:
        return LanguageModel([], np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    y = np.array([classes.index(x) for x in labels])
    rows = [(f, c / size * idf[f] * scale) for f, c, size in counts]
    n, k = FEATURES + 1, len(classes)
    z, g2, w = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    order = np.random.default_rng(seed)
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    for _ in range(epochs):
        order.shuffle(train)
        for b in range(0, len(train), batch):
            part = train[b : b + batch]
            f = np.concatenate([np.append(rows[i][0], FEATURES) for i in part])
            x = np.concatenate([np.append(rows[i][1], 1.0) for i in part])
            size = np.array([len(rows[i][0]) + 1 for i in part])
            begin = np.cumsum(size) - size
            p = softmax(np.add.reduceat(w[f] * x[:, None], begin, axis=0))
            p[np.arange(len(part)), y[part]] -= 1.0
            used, inverse = np.unique(f, return_inverse=True)
            g = np.zeros((len(used), k))
            np.add.at(g, inverse, np.repeat(p, size, axis=0) * x[:, None] / len(part))
            sigma = (np.sqrt(g2[used] + g * g) - np.sqrt(g2[used])) / alpha
            z[used] += g - sigma * w[used]
            g2[used] += g * g
            zu = z[used]
            w[used] = np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((beta + np.sqrt(g2[used])) / alpha + l2))
    model = LanguageModel(classes, (w[:FEATURES] * (idf * scale)[:, None]).astype(np.float32), w[FEATURES])
    check = np.flatnonzero(held) if held.any() else train
    logits, truth = np.stack([counts[i][1] @ model.weights[counts[i][0]] / counts[i][2] for i in check]) + model.bias, y[check]
    grid = np.geomspace(0.05, 20, 61)
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), truth] + 1e-12).mean()))
    return model


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, n = np.zeros(FEATURES + 1, np.int64), 0
    for batch in batches:
        texts = [x or "" for x in batch["text"].to_pylist()]
        for i, j in _chunks(texts):
            grams, sizes = ngrams(texts[i:j])
            ends = np.cumsum(sizes)
            for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                seen = np.zeros(FEATURES, bool)
                seen[grams[:, a:z]] = True
                count[:FEATURES] += seen
                n += 1
    count[FEATURES] = n
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], ["f", "n"])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with a letter the distinct features, their counts and the number of characters."""
    for batch in batches:
        for k, t in enumerate(batch["text"].to_pylist()):
            if has_letter(t):
                grams, sizes = ngrams([t])
                f, c = np.unique(grams, return_counts=True)
                blobs = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (f, c)]
                yield pa.RecordBatch.from_arrays([batch["h"][k : k + 1], batch["lang"][k : k + 1], *blobs, pa.array(sizes[:1])], ["h", "lang", "f", "c", "size"])


def train_language_model(docs: DataFrame) -> LanguageModel:
    """Fits on docs (doc_id, text, lang): inverse document frequencies over all rows with a lang, weights on
    whole texts of about FIT_ROWS of them, with at least about LANG_ROWS of each language that has so many."""
    small_batches(docs.sparkSession)
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = labelled.select("text").mapInArrow(_document_counts, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # FEATURES + 1 rows at most
    df = np.zeros(FEATURES + 1)
    df[counts["f"].to_numpy(np.int64)] = counts["n"].to_numpy()
    idf = np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1
    hashed = labelled.withColumn("h", F.xxhash64("doc_id", "text"))
    many = labelled.groupBy("lang").agg(F.count("*").alias("n")).toPandas()  # a row per language
    rate = [max(FIT_ROWS / many["n"].sum(), LANG_ROWS / n) for n in many["n"]]
    cut = [(1 << 63) - 1 if r >= 1 else int(r * (1 << 64)) - (1 << 63) for r in rate]
    cuts = docs.sparkSession.createDataFrame(list(zip(many["lang"].tolist(), cut, strict=True)), "lang string, cut long")
    chosen = hashed.join(F.broadcast(cuts), "lang").where("h <= cut").select("h", "text", "lang")
    sample = chosen.mapInArrow(_sample_counts, "h long, lang string, f binary, c binary, size long").dropDuplicates(["h", "lang"]).toPandas().sort_values(["h", "lang"], kind="stable")
    counts = [(np.frombuffer(f, np.int32), np.frombuffer(c, np.int32), n) for f, c, n in zip(sample["f"], sample["c"], sample["size"], strict=True)]
    return fit(counts, sample["lang"].tolist(), idf)


def _predicted(spark: SparkSession, model: LanguageModel) -> Column:
    """A struct (lang_pred, lang_score) for the column text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, lang_score: double>")
    def predict(text: pd.Series) -> pd.DataFrame:
        label, score = shared.value.predict([x if isinstance(x, str) else None for x in text])
        return pd.DataFrame({"lang_pred": label, "lang_score": score})

    return predict("text")


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and lang_score (columns of these names are replaced): the label of each whole text.

    Null texts and texts without a letter are `und` with score 0. Rows are independent; an empty table stays empty.
    """
    base = docs.drop("lang_pred", "lang_score")
    return base.withColumn("_mirador_lang", _predicted(docs.sparkSession, model)).select(*base.columns, "_mirador_lang.lang_pred", "_mirador_lang.lang_score")


def training_fold(docs: DataFrame):
    """Rows to learn from: crc32 of the doc_id as text, mod 4, is not 2."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 4 != 2


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs, all columns as they are, without those that have no letter or whose language is less certain than `least`; where
    no row has a lang to learn from, none is certain."""
    model = train_language_model(docs.where(training_fold(docs)))
    found = docs.withColumn("_mirador_lang", _predicted(docs.sparkSession, model))
    return found.where((F.col("_mirador_lang.lang_pred") != UNDETERMINED) & (F.col("_mirador_lang.lang_score") >= least)).select(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the training fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, train_language_model(docs.where(training_fold(docs))))
    return found.select("doc_id", (~training_fold(docs)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
