"""Dataset preparation: raw annotations to an index with splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.functions.rows import number_rows, smallest
from mirador.functions.text import basename, normalize_split, pick_first, sample_id, stem, strip, suffix

#: Names under which raw annotations carry each field.
FIELD_ALIASES = {
    "question": ["question", "query", "sentence"], "answer": ["answer", "label", "response"], "split": ["split", "partition", "subset"],
    "image": ["image_name", "image_path", "image", "image_id", "image_filename"], "id": ["sample_id", "qid", "question_id"],
    "answer_type": ["answer_type", "question_type"], "phrase_type": ["phrase_type"],
}
KEY_TYPE = "array<struct<key:string,r:int>>"
OWN_POS = "_own_pos"
INDEX_COLUMNS = ["sample_id", "image_path", "question", "answer", "split", "answer_type", "phrase_type"]


def unwrap(df: DataFrame, listed: bool = False) -> DataFrame:
    """One row per record with its raw position `pos`, whether the file is a list or holds one under data or records. A field of
    that name that the records have themselves becomes OWN_POS. listed says that df's rows are the records."""
    for name in () if listed else ("data", "records"):
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            fields = df.schema[name].dataType.elementType.names
            return df.select(F.posexplode(name).alias("pos", "r")).select("pos", *[F.col(f"r.`{c}`").alias(OWN_POS if c == "pos" else c) for c in fields])
    return number_rows(df.withColumnRenamed("pos", OWN_POS), "pos")


def normalize_rows(raw: DataFrame) -> DataFrame:
    """The fixed fields of raw rows (pos and any aliases); rows without question or image are dropped."""
    q, a = strip(F.coalesce(pick_first(raw, FIELD_ALIASES["question"], ""), F.lit(""))), strip(F.coalesce(pick_first(raw, FIELD_ALIASES["answer"], ""), F.lit("")))
    image = pick_first(raw, FIELD_ALIASES["image"])
    meta = F.to_json(F.struct(*[F.col(f"`{c}`").alias("pos" if c == OWN_POS else c) for c in raw.columns if c != "pos"]))
    out = raw.select("pos", q.alias("question"), a.alias("answer"), image.alias("image_path"), pick_first(raw, FIELD_ALIASES["split"]).alias("raw_split"), pick_first(raw, FIELD_ALIASES["id"]).alias("given_id"), pick_first(raw, FIELD_ALIASES["answer_type"]).alias("answer_type"), pick_first(raw, FIELD_ALIASES["phrase_type"]).alias("phrase_type"), meta.alias("raw_metadata"))
    out = out.where((F.col("question") != "") & F.col("image_path").isNotNull())
    return out.withColumn("sample_id", F.coalesce("given_id", sample_id(F.col("question"), F.col("answer"), F.col("image_path"), F.col("pos")))).withColumn("split", normalize_split(F.col("raw_split"))).drop("given_id", "raw_split")


def direct_paths(value: Column, root: str) -> Column:
    """The paths that an image's value may mean, in turn: an absolute one itself; else the value and its base name below root, and
    the same below root/images."""
    v = strip(value)
    below = F.array(*[F.concat(F.lit(p), x) for p in (f"{root}/", f"{root}/images/") for x in (v, basename(v))])
    return F.when(v.startswith("/"), F.array(v)).otherwise(below)


def resolve_images(rows: DataFrame, listing: DataFrame, root: str, by_name: bool = True) -> DataFrame:
    """image_path made the path of an existing file of listing (path); null where there is none.

    Tried in turn: direct_paths() and, if by_name, any file of that name below root, and for a name without suffix any file below
    root with that stem; of several the first by path. Files of listing elsewhere are found by their whole path alone. rows
    need a `pos` of their own each.
    """
    path, base = F.col("path"), basename(F.col("path"))
    parts = F.split(base, "[.]")
    stems = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.lit("stem:"), F.array_join(F.slice(parts, 1, i), ".")))
    key = lambda k, r: F.struct(k.alias("key"), F.lit(r).alias("r"))
    named = F.concat(F.array(key(base, 1)), F.transform(F.when(base.contains("."), stems).otherwise(F.array().cast("array<string>")), lambda x: key(x, 2)))
    named = F.concat(F.array(key(path, 0)), F.when(path.startswith(f"{root.rstrip('/')}/") & F.lit(by_name), named).otherwise(F.array().cast(KEY_TYPE)))
    keys = listing.select(F.regexp_replace("path", "^file:/+", "/").alias("path")).select("path", F.explode(named).alias("k")).groupBy("k.key").agg(F.min(F.struct("k.r", "path")).alias("hit"))
    v = strip(F.col("image_path"))
    name = F.when(suffix(v) != "", basename(v)).otherwise(F.concat(F.lit("stem:"), basename(v)))
    asked = rows.select("pos", F.posexplode(F.concat(direct_paths(v, root), F.array(name))).alias("rank", "key"))
    found = asked.join(keys, "key").groupBy("pos").agg(F.min_by("hit.path", F.struct("rank", "hit")).alias("found"))
    return rows.join(found, "pos", "left").withColumn("image_path", F.col("found")).drop("found")


def assign_splits(rows: DataFrame, seed: int = 42, val_ratio: float = 0.1, test_ratio: float = 0.2) -> DataFrame:
    """Explicit splits if every row has one; else a seeded shuffle: test max(1, round(0.2 n)), val by ratio of the rest.

    Sizes round half to even. The order of the shuffle is that of (md5 of seed, id and pos; pos); the two places where it is
    cut are found from counts by hash prefix, so no row moves and no task holds all rows.
    """
    total, known = rows.agg(F.count("*"), F.count("split")).first()
    if total == known:
        return rows
    n_test = max(1, round(total * test_ratio))
    n_val = round((total - n_test) * max(val_ratio, 0.0))
    digest, pos = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id"), F.col("pos").cast("string"))), F.col("pos")
    split = F.when(smallest(rows, digest, pos, n_test), "test").when(smallest(rows, digest, pos, n_test + n_val), "val")
    return rows.withColumn("split", split.otherwise("train"))


def index_records(rows: DataFrame) -> DataFrame:
    return rows.select(*INDEX_COLUMNS)


def limit_rows(rows: DataFrame, n: int | None, zero_is_all: bool = False) -> DataFrame:
    """The first n rows by pos; None means all, and 0 too where zero_is_all."""
    return rows if n is None or zero_is_all and not n else rows.orderBy("pos").limit(n)


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def hold_out(rows: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Adds held_out: true for ceil(ratio * n) of the n rows, the first by (md5 of seed, id and pos; pos), if ratio > 0 and
    n > 20; else for none."""
    n = rows.count() if ratio > 0 else 0
    if n <= 20:
        return rows.withColumn("held_out", F.lit(False))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("sft"), F.col("sample_id"), F.col("pos").cast("string")))
    return rows.withColumn("held_out", smallest(rows, digest, F.col("pos"), math.ceil(ratio * n)))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df
