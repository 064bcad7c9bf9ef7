"""WARC archives with a shared Zstandard dictionary.

A dictionary is built from a bounded sample of the records; each archive file begins with it, in a skippable frame, and
every record follows as a Zstandard frame of its own. The files are written by Spark's text writer: a frame is a "line",
and the line separator is an empty skippable frame, which decoders pass over. So any file system Spark knows will do, and
the committer drops the output of failed or repeated tasks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import materialize, new_path, small_batches, told

#: Frame magics: of data, of the dictionary's skippable frame, and an empty skippable frame.
DATA, DICTIONARY, EMPTY = b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18", "P*M\x18\x00\x00\x00\x00"
#: Frames in one file, its dictionary among them; files are read whole, so they should stay far below 2 GB.
FRAMES_PER_FILE = 10_000
#: The dictionary's size, the records it is built from, and how much of each.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 65536, 400, 8192
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_LINE = {i: f"%{i:02X}" for i in range(32)} | {127: "%7F"}


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head alone, whose Content-Length still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate(_LINE)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), the payload checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest != base32_sha1(payload)):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: None if x in (None, "<urn:x-page:null>") else int(x[12:-1])
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, kind, number(fields.get("WARC-Refers-To"))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few or too equal samples are used as they stand, and none give none."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _frames(data: memoryview):
    """(magic, start of the frame, its end) of the frames in data, found from their headers alone."""
    at = 0
    while at < len(data):
        magic, begin = bytes(data[at : at + 4]), at
        if magic != DATA:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            flags = data[at + 4]
            single, content = flags >> 5 & 1, flags >> 6
            at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0) if content == 0 else 1 << content)
            last = False
            while not last:
                block = int.from_bytes(data[at : at + 3], "little")
                last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
                at += 3 + (1 if kind == 1 else size)
            at += 4 * (flags >> 2 & 1)
        yield magic, begin, at


def _write(dictionary: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
        lead, count = DICTIONARY + struct.pack("<I", len(dictionary)) + dictionary, 0
        for batch in batches:
            out, size = [], 0
            rows = zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to", "revisit")), strict=True)
            for page_id, url, payload, sha1, refers_to, revisit in rows:
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                if count % FRAMES_PER_FILE == 0:  # the writer begins a file here
                    out.append(lead)
                    count += 1
                out.append(packer.compress(record(page_id, url, payload, digest, refers_to, revisit, date)))
                count += 1
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return run


def _read(frames: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for content in pdf["content"]:
            data, out, unpacker = memoryview(content), [], None
            for magic, begin, end in _frames(data):
                if magic == DICTIONARY:
                    own = bytes(data[begin + 8 : end])
                    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own) if own else None)
                elif magic == DATA:
                    out.append(parse_record(unpacker.decompress(data[begin:end])))
                if len(out) == 5000:
                    yield pd.DataFrame(out, columns=_COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})
                    out = []
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Archives all pages (page_id, url, html) under path, a file for every FRAMES_PER_FILE frames of a task, each with the
    dictionary first: see the module's text. Returns path.

    Null html is an empty payload. Of pages with equal payloads of at least least_bytes bytes, that with the smallest
    page_id is a response (each of them, should rows repeat it), the others are revisits of it; a null page_id counts as
    the largest. Control characters in a url are written as %XX; a null url has no target. An empty table gives
    archives without records.
    """
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload")).select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    twice = base.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = materialize(twice.select(F.col("sha1").alias("s"), F.col("size").alias("z"), "first"), "copies")
    twice = told(twice)
    hashed = pages.select(F.xxhash64("page_id", "url").alias("h"), F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("x"))
    cut = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_RECORDS).agg(F.max("h")).first()[0]
    some = hashed.where(F.col("h") <= cut) if cut is not None else hashed.limit(0)
    sample = some.groupBy("h").agg(F.min("x").alias("x")).toPandas().sort_values("h")  # at most SAMPLE_RECORDS rows
    dictionary = build_dictionary([record(0, "http://example.com/", x.encode(), "A" * 32, None, False, date) for x in sample["x"]])
    revisit = F.col("s").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = base.join(twice, (base.sha1 == twice.s) & (base["size"] == twice.z), "left").select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    frames = rows.mapInArrow(_write(dictionary, date), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY).option("compression", "none").option("maxRecordsPerFile", FRAMES_PER_FILE).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages and reads the archives back."""
    return read_archives(spark, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc")))
