"""Numbers and ranks over whole tables without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """df with its rows numbered from 0 in the order in which its source gives them, as column `name`.

    Spark's ids rise within and across partitions; one count per partition turns them into numbers without gaps. df is read twice
    and must come in the same order and partitions both times: give a scan of files, not what a shuffle dealt out."""
    tagged = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = sorted(tagged.groupBy(part.alias("part")).count().collect())  # a row per partition
    begin, rows = 0, []
    for r in counts:
        rows.append((r["part"], begin))
        begin += r["count"]
    starts = df.sparkSession.createDataFrame(rows or [(0, 0)], "_part long, _begin long")
    met = tagged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return met.withColumn(name, F.col("_begin") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_begin", "_id")


def smallest(df: DataFrame, digest: Column, tie: Column, n: int) -> Column:
    """A condition that holds for the n rows of df with the smallest (digest, tie); digest is lower-case hex, tie unique.

    Rows are counted by the first four digits; only those of one such prefix are sorted, to find where the n-th lies."""
    if n <= 0:
        return F.lit(False)
    prefix = F.substring(digest, 1, 4)
    counts = sorted(df.groupBy(prefix.alias("p")).count().collect())  # 65,536 rows at most
    left = n
    for r in counts:
        if left <= r["count"]:
            last = df.where(prefix == r["p"]).select(F.struct(digest.alias("h"), tie.alias("t")).alias("k")).orderBy("k").limit(left).agg(F.max("k").alias("k")).first()["k"]
            return (digest < last["h"]) | ((digest == last["h"]) & (tie <= last["t"]))
        left -= r["count"]
    return F.lit(True)
