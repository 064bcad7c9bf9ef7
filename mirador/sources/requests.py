"""Requests to a model: chat messages that carry their images' bytes, and a key that tells equal requests."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from mirador.sources.model import Policy

#: Media types by the first bytes of a file, in hex.
MEDIA_TYPES = {"89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "52494646": "image/webp", "424D": "image/bmp"}


def media_type(content: Column) -> Column:
    """By the first bytes; application/octet-stream for other ones."""
    head, out = F.hex(F.substring(content, 1, 4)), F.lit("application/octet-stream")
    for start, name in MEDIA_TYPES.items():
        out = F.when(head.startswith(start), name).otherwise(out)
    return out


def data_address(content: Column) -> Column:
    """The bytes themselves as an address: data:<type>;base64,..."""
    return F.concat(F.lit("data:"), media_type(content), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def local_path(address: Column) -> Column:
    """The path that an image's address means: a file URI decoded, a path as it is; null for data and http addresses."""
    plain = F.url_decode(F.regexp_replace(F.regexp_replace(address, "^file:/+", "/"), r"\+", "%2B"))
    return F.when(F.lower(address).rlike("^(data|https?):"), F.lit(None)).when(address.startswith("file:"), plain).otherwise(address)


def _paths(messages: Column) -> Column:
    part = lambda m: F.transform(m["content"], lambda p: local_path(p["image_url"]["url"]))
    return F.array_distinct(F.filter(F.flatten(F.transform(messages, part)), lambda x: x.isNotNull()))


def attach_images(rows: DataFrame, files: DataFrame, messages: str = "messages") -> DataFrame:
    """rows whose messages' local image addresses are replaced by the bytes of files (path, content), and `missing_images`, the
    paths that no file has; such an address becomes null.

    Each image that is asked for is encoded once, in the JVM. Requests are matched to their images by a hash of their messages, so
    nothing hangs on how often or in which order rows are read, and equal requests share the work. Null messages stay null."""
    key = F.sha2(F.to_json(messages), 256)
    asked = rows.select(key.alias("_key"), F.explode(_paths(F.col(messages))).alias("_path")).distinct()
    path = F.when(F.col("path").startswith("file:"), local_path(F.col("path"))).otherwise(F.col("path"))
    wanted = files.select(path.alias("_path"), "content").join(asked.select("_path").distinct(), "_path", "left_semi")
    encoded = wanted.groupBy("_path").agg(F.max("content").alias("content")).select("_path", data_address(F.col("content")).alias("address"))
    found = asked.join(encoded, "_path").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_path", "address"))).alias("_images"))
    met = rows.withColumn("_key", key).join(found, "_key", "left").withColumn("_images", F.coalesce("_images", F.create_map().cast("map<string,string>")))

    def filled(p: Column) -> Column:
        at = local_path(p["image_url"]["url"])
        link = F.struct(F.try_element_at("_images", at).alias("url"))
        return F.when(at.isNull(), p).otherwise(p.withField("image_url", F.when(link["url"].isNotNull(), link)))

    lost = F.filter(_paths(F.col(messages)), lambda x: ~F.map_contains_key(F.col("_images"), x))
    whole = F.transform(messages, lambda m: m.withField("content", F.transform(m["content"], filled)))
    return met.withColumns({"missing_images": F.coalesce(lost, F.array().cast("array<string>")), messages: whole}).drop("_key", "_images")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")


def request_key(messages_json: Column, policy: Policy, model: str) -> Column:
    """A hash of what an answer hangs on: the model, the temperature, the number of tokens, and the messages with their images."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(policy.temperature)), F.lit(str(policy.max_tokens)), messages_json), 256)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Within it, Python workers get batches of so many rows and bytes at most; the session's settings return afterwards."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
