"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Split labels by the split they stand for.
SPLIT_ALIASES = {"train": ("train", "training"), "val": ("val", "valid", "validation", "dev"), "test": ("test", "testing")}


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def pick_first(df: DataFrame, names: list[str], default: str | None = None) -> Column:
    """The first of the named columns that is neither null nor empty; absent columns are passed over."""
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default).cast("string")


def normalize_split(c: Column) -> Column:
    """train, val or test for a known label, else null."""
    label, out = F.lower(strip(c.cast("string"))), F.lit(None).cast("string")
    for split, names in SPLIT_ALIASES.items():
        out = F.when(label.isin(*names), split).otherwise(out)
    return out


def normalize_answer(c: Column) -> Column:
    """Lower-cased, trimmed, inner white space collapsed; null is empty."""
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/*$", 1)


def suffix(c: Column) -> Column:
    """The last dot and what follows, unless the name begins with it."""
    return F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]+$", "")


def sample_id(question: Column, answer: Column, path: Column, index: Column) -> Column:
    """The derived id of a sample: from its position in the raw file, file name, question and answer."""
    return F.concat(F.lit("vqarad_"), F.substring(F.md5(F.concat_ws("|", index.cast("string"), basename(path), question, answer)), 1, 12))


def file_uri(path: Column) -> Column:
    """file:// URI of an absolute path, percent-encoded but for its slashes."""
    return F.concat(F.lit("file://"), F.regexp_replace(F.regexp_replace(F.url_encode(path), "%2F", "/"), r"\+", "%20"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts alone, so that reruns and repartitioning change nothing."""
    return bits(*parts) / F.lit(4294967296.0)


def bits(*parts: Column) -> Column:
    """A 32-bit number that depends on its parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
