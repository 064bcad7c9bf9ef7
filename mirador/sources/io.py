"""Files in and out, through Spark's file systems."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mirador.operators.images import to_rgb
from mirador.operators.prepare import unwrap

#: Where annotations and images are looked for, in this order.
ANNOTATION_NAMES = ["VQA_RAD Dataset Public.json", "VQA_RAD Dataset Public.jsonl", "dataset.json", "dataset.jsonl"]
IMAGE_DIRS = ["images", "VQA_RAD Image Folder", "VQA_RAD Image Folder/images", ""]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of what lies right in a folder, sorted; none where there is no folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in store.listStatus(p)) if store.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def resolve_paths(spark: SparkSession, root: str | None = None, annotations: str | None = None, images: str | None = None) -> tuple[str, str]:
    """(annotations, images): explicit paths as given, else the first candidate below root that exists."""
    def first(names: list[str], what: str) -> str:
        for name in names if root else []:
            if exists(spark, path := f"{root}/{name}".rstrip("/")):
                return path
        raise FileNotFoundError(f"no {what} below {root}")

    return annotations or first(ANNOTATION_NAMES, "annotations"), images or first(IMAGE_DIRS, "images")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON document: a list, or an object with one under data, else under records; anything else is an error. A
    .jsonl file is read by lines."""
    if path.endswith(".jsonl"):
        return unwrap(spark.read.option("mode", "FAILFAST").json(path))
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1)).first()
    wrong = ValueError(f"{path} is neither a list nor an object with a list under data or records")
    if not first or first[0] not in "[{":
        raise wrong
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if first[0] == "{" and not any(n in df.columns and df.schema[n].dataType.typeName() == "array" for n in ("data", "records")):
        raise wrong
    return unwrap(df, listed=first[0] == "[")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Lines of JSON; blank lines are passed over, a bad one fails."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One small document, indented, unescaped."""
    text = json.dumps(value, ensure_ascii=False, indent=2)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def append_errors(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written first where it is absent."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_existing(spark: SparkSession, *paths: str) -> str:
    return next((p for p in paths[:-1] if p and exists(spark, p)), paths[-1])


def image_listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, data of images; data has three bytes a pixel, in RGB order. Files that are no image are left out."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return found.select("origin", "height", "width", to_rgb(F.col("data"), F.col("nChannels")).alias("data"))


def read_config(path: str) -> dict:
    """A YAML file's settings; needs the optional yaml package."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def split_writer(index: DataFrame, path: str) -> None:
    """Index rows by split, each split also where it is empty after reading by partition."""
    index.withColumn("part", F.col("split")).write.mode("overwrite").partitionBy("part").option("ignoreNullFields", "false").json(path)
