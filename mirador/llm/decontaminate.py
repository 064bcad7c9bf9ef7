"""Benchmark decontamination with native functions alone.

Windows of test words become a hash set; every window of every document is hashed from its word hashes and probed
against the broadcast set inside one generated-code stage; a hit is verified word by word before it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import ascii_lower, materialize, told

#: Benchmark windows up to this many are broadcast (about 150 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Documents with hits are broadcast up to so many, each hit that is cut counting as one more; beyond they are shuffled.
BROADCAST_DOCUMENTS = 1_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(col: Column) -> Column:
    """Lower-cased words of a text: digits, letters and all beyond ASCII; null has none."""
    parts = F.split(ascii_lower(F.coalesce(col, F.lit(""))), _SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(k, window, items): each distinct window of the items, its words joined by a space, and the items that have it."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(n))
    each = words.select("item", "w", k.alias("k")).select("item", "k", F.explode(F.expr("transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))")).alias("window"))
    return each.groupBy("k", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, hits, contaminated, items_sha256, th) for every row of docs (doc_id, text).

    A window is `n` consecutive words of an item, or all words of a shorter one. hits: (start, stop) word positions of the
    windows found, from 0; n_hit: words inside any. Null and empty texts have no words and no hits, and an empty
    benchmark hits nothing. Repeated rows are returned each; null doc_ids are carried. An item whose id is null counts as
    no item, but its words still hit. th is a hash of the text.
    """
    windows = benchmark_windows(benchmark, n)
    sizes = {r["k"]: r["n"] for r in windows.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most n rows
    windows = windows.select(F.xxhash64(F.transform(F.split("window", " "), lambda w: F.xxhash64(w))).alias("wh"), F.col("k").alias("wk"), "window", "items")
    few = sum(sizes.values()) <= BROADCAST_WINDOWS
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words_of(F.col("text")).alias("w"))
    hashed = base.select("doc_id", "th", "w", F.size("w").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    # explode_outer: explode would have its array computed once more in a filter before it; and h is named more than
    # once, which keeps Catalyst from moving its computation into the lambda over positions
    probes = [F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("p")))]
    for k in sorted(sizes):
        window = ", ".join(["x", *(f"get(h, i + {j})" for j in range(1, k))])  # several times as fast as the hash of a slice
        each = F.expr(f"transform(slice(h, 1, size(h) - {k - 1}), (x, i) -> struct(i + 1 AS at, {k} AS k, xxhash64({window}) AS p))")
        probes.append(F.when(F.size("h") >= k, each).otherwise(F.array().cast("array<struct<at:int,k:int,p:bigint>>")))
    probed = hashed.select("doc_id", "th", "w", "n_words", F.concat(*probes).alias("all")).select("doc_id", "th", "w", "n_words", F.explode_outer("all").alias("x")).select("doc_id", "th", "w", "n_words", "x.at", "x.k", "x.p")
    alike = (F.col("p") == F.col("wh")) & (F.col("k") == F.col("wk"))
    real = F.col("window") == F.array_join(F.expr("slice(w, at, k)"), " ")
    hit = F.struct((F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.col("k")).alias("stop"))
    if few:
        met = probed.join(F.broadcast(windows), alike, "left").where((F.col("at") == 0) | real)
        rows = met.select("doc_id", "th", "n_words", F.when(F.col("at") > 0, hit).alias("hit"), "items", (F.col("at") == 0).cast("int").alias("row"))
    else:  # probes are shuffled without their words; what they hit meets the words of its document once more
        hits = probed.where("at > 0").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "at", "k", "p").join(windows, alike).drop("p", "wh", "wk").distinct()
        met = base.join(hits, base.doc_id.eqNullSafe(F.col("d")) & (base.th == F.col("t"))).where(real)
        one = hashed.select("doc_id", "th", "n_words", F.lit(None).cast("struct<start: int, stop: int>").alias("hit"), F.lit(None).cast("array<string>").alias("items"), F.lit(1).alias("row"))
        rows = one.union(met.select("doc_id", "th", F.size("w").alias("n_words"), hit.alias("hit"), "items", F.lit(0).alias("row")))
    found = rows.groupBy("doc_id", "th", "n_words").agg(F.sum("row").alias("copies"), F.sort_array(F.collect_set("hit")).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["to"]))).alias("n"), F.greatest(a["to"], x["stop"]).alias("to")),
        lambda a: a["n"],
    )
    return (
        found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "items", "hits", "th")
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document") -> DataFrame:
    """docs without contamination: mode "document" drops every document with a hit; "span" cuts the words hit from it
    (the words are then lower-cased and joined by a space, as they were compared). Other documents stay as they are."""
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    found = contamination(docs, benchmark, n).where("contaminated").select(F.col("doc_id").alias("_mirador_id"), F.col("th").alias("_mirador_th"), F.col("hits").alias("_mirador_hits")).dropDuplicates(["_mirador_id", "_mirador_th"])
    found = materialize(found if mode == "span" else found.drop("_mirador_hits"), "contaminated")
    size = found.agg(F.coalesce(F.sum(F.size("_mirador_hits")), F.lit(0))).first()[0] if mode == "span" else 0
    found = told(found, BROADCAST_DOCUMENTS - size)
    same = docs.doc_id.eqNullSafe(F.col("_mirador_id")) & (F.xxhash64(F.coalesce(docs.text, F.lit(""))) == F.col("_mirador_th"))
    if mode == "document":
        return docs.join(found, same, "left_anti")
    w = words_of(F.col("text"))
    kept = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda x: ~F.exists("_mirador_hits", lambda s: (x["i"] >= s["start"]) & (x["i"] < s["stop"])))
    text = F.when(F.col("_mirador_hits").isNull(), F.col("text")).otherwise(F.array_join(kept["x"], " "))
    return docs.join(found, same, "left").withColumn("text", text).select(*docs.columns)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks all documents against all benchmark items by windows of ten words."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
       FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rn, k, i, array_to_string(w[i : i + k - 1], ' ') AS t
       FROM (SELECT rn, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
h AS (SELECT dw.rn, dw.i, dw.k, bw.item FROM dw JOIN bw USING (k, t)),
p AS (SELECT rn, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT rn, unnest(generate_series(i, i + k - 1)) AS pos FROM h) GROUP BY rn),
it AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM h) GROUP BY rn)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rn) LEFT JOIN it USING (rn)
"""
