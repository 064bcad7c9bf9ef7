"""Packing by power-of-two decomposition: a document's ids are split into pieces whose lengths are the binary digits of
their number (the largest length repeated as often as it fits). Every piece is a sequence of its own, bucketed with the
others of its length, so no sequence crosses documents and none needs padding."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import doc_chunks, small_batches, text_buffer

MAX_LENGTH = 2048
END_ID = 1
#: Words, and runs that words are made of, that a worker remembers.
WORDS, RUNS = 800_000, 800_000
_SPACES = bytes([32, *range(9, 14)])
_CODERS: dict[str, "WordCoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters followed by signs: the tokenizer cuts between the two, and its lower-casing is str.lower() for these letters.
_SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([!-&(-/:-@\[-`{-~]*)")


class WordCoder:
    """Ids of texts by way of their distinct words and of the runs these are made of.

    The tokenizer drops white space and never joins across it, and it lower-cases, so a word of letters and then signs is
    two runs, shared by all words that have them. Each such run is one piece to the tokenizer, whose last id ends a word, so
    many are encoded as one text. Any other word is one run, encoded alone. Each run is encoded once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.word: dict[bytes, int] = {}
        self.runs_of = np.zeros((0, 2), np.int64)
        self.run: dict[str, int] = {"": 0}
        self.flat, self.at, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self.word]
        if len(self.run) + 2 * len(fresh) > RUNS:
            self.clear()
            fresh = list(words)
        elif len(self.word) + len(fresh) > WORDS:
            self.word, self.runs_of = {}, np.zeros((0, 2), np.int64)
            fresh = list(words)
        if not fresh:
            return
        run, before, pairs = self.run, len(self.run), []
        for w in fresh:
            text = w.decode("utf-8", "replace")
            m = _SIMPLE.fullmatch(text)
            if m:
                pairs.append(run.setdefault(m[1].lower(), len(run)))
                pairs.append(run.setdefault(m[2], len(run)))
            else:
                pairs.append(run.setdefault("\0" + text, len(run)))
                pairs.append(0)
        self.word.update(zip(fresh, range(len(self.word), len(self.word) + len(fresh)), strict=True))
        self.runs_of = np.concatenate((self.runs_of, np.array(pairs, np.int64).reshape(-1, 2)))
        new = list(islice(run, before, None))
        flats, sizes = [self.flat], [self.size]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            whole = [i for i, x in enumerate(part) if x[0] == "\0"]
            size = np.zeros(len(part), np.int64)
            plain = self.ids(" ".join(x for x in part if x[0] != "\0"))
            last = np.flatnonzero(self.ends[plain])
            alone = np.ones(len(part), bool)
            alone[whole] = False
            size[alone] = np.diff(last, prepend=-1)
            others = [self.ids(part[i][1:]) for i in whole]
            size[whole] = [len(x) for x in others]
            flat, begin = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
            flat[np.repeat(alone, size)] = plain
            for i, x in zip(whole, others, strict=True):
                flat[begin[i] : begin[i] + len(x)] = x
            flats.append(flat)
            sizes.append(size)
        self.flat, self.size = np.concatenate(flats), np.concatenate(sizes)
        self.at = np.cumsum(self.size) - self.size

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and the number of ids of each text."""
        split = [x.translate(_TO_SPACE).split() for x in texts]
        words = [w for x in split for w in x]
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        self.learn(set(words))
        pairs = self.runs_of[np.fromiter(map(self.word.__getitem__, words), np.int64, len(words))]
        of_word = self.size[pairs].sum(1)
        k = pairs.ravel()
        k = k[self.size[k] > 0]
        size = self.size[k]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[k] - ends + size, size)]
        total = np.concatenate(([0], np.cumsum(of_word)))[np.cumsum([len(x) for x in split])]
        return ids, np.diff(total, prepend=0)


_TO_SPACE = bytes(32 if i in _SPACES else i for i in range(256))


def pieces(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Lengths, largest first: `most` as often as it fits, then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(path: str, most: int):
    plans: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def plan(n: int):
        if n not in plans:
            if len(plans) > 50_000:
                plans.clear()
            length = np.array(pieces(n, most), np.int64)
            plans[n] = (np.cumsum(length) - length, length)
        return plans[n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CODERS:
            _CODERS[path] = WordCoder(path)
        coder = _CODERS[path]
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            view = memoryview(data)
            for i, j in doc_chunks(offsets, 4 << 20):
                texts = [bytes(view[offsets[k] : offsets[k + 1]]) for k in range(i, j)]
                ids, counts = coder.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(END_ID))
                counts = counts + 1
                begins = np.cumsum(counts) - counts
                cuts = [plan(int(n)) for n in counts]
                row = np.repeat(np.arange(i, j), [len(x[0]) for x in cuts])
                start, length = np.concatenate([x[0] for x in cuts]), np.concatenate([x[1] for x in cuts])
                buffer = memoryview(ids.astype("<u4").tobytes())
                first = (begins[row - i] + start) * 4
                crc = [zlib.crc32(buffer[a : a + 4 * n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[row - i])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack_documents(docs: DataFrame, path: str | None = None, most: int = MAX_LENGTH) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    path names a tokenizer file whose white space separates words and is dropped, as word_bpe_49k.json does (the default);
    every executor must be able to read it. An end id closes each document, so a null or empty text is one piece of
    length 1. `most` must be a power of two. bucket is log2 of the length. Each piece is a sequence of its own, offset 0;
    sequence_id is unique. Repeated rows are packed each; a null doc_id is carried; an empty table gives no pieces.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(_pack(path or tokenizer_path(), most), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return cut.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def write_sequences(pieces: DataFrame, path: str) -> None:
    """Writes the pieces of pack_documents as Parquet, those of each length in a folder of their own (bucket=...), so that a
    reader of one takes sequences of one length alone."""
    pieces.write.partitionBy("bucket").parquet(path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2,048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
