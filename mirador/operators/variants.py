"""Counterfactual variants: fan-out, weighted draws, and mismatch joins. All draws are hashes of seed, id and variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions.text import bits, stem, suffix, uniform
from mirador.operators.images import degrade_column, save_images
from mirador.sources.scratch import Tables

#: Fixed values.
DEGRADATIONS = ["gaussian_blur", "speckle_noise", "resolution_drop", "contrast_brightness_shift", "random_crop", "local_occlusion", "center_mask", "border_truncate"]
MISMATCHES = ["question_replacement", "image_replacement", "cross_sample_mismatch"]
STRESS_TYPES = ["random_crop", "local_occlusion", "center_mask", "border_truncate", "question_replacement", "cross_sample_mismatch"]
SEVERITIES = ["low", "medium", "high"]


def severity_slots(weights: dict[str, float] | None) -> list[str]:
    """Each label as often as its weight in hundredths, at least once; no weights: each once."""
    if not weights:
        return list(SEVERITIES)
    return [k for k, w in weights.items() for _ in range(max(1, int(100 * w)))]


def choose(values: list[str], *key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(bits(*key), F.lit(len(values))) + 1).cast("int"))


def base_variant(df: DataFrame) -> DataFrame:
    return df.withColumns({"is_counterfactual": F.lit(False), "degradation_type": F.lit("none"), "severity": F.lit("none"), "source_sample_id": F.lit(None).cast("string"), "variant_idx": F.lit(0)})


def fan_out(index: DataFrame, per_sample: int = 4, mismatch_probability: float = 0.25, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Every sample and per_sample variants of it, each with type and severity drawn; mismatch types are severity high."""
    rows = index.withColumn("variant_idx", F.explode(F.sequence(F.lit(0), F.lit(per_sample))))
    key = [F.lit(seed), F.col("sample_id"), F.col("variant_idx")]
    slots = severity_slots(weights)
    is_mismatch = uniform(*key, F.lit("gate")) < mismatch_probability
    kind = F.when(is_mismatch, choose(MISMATCHES, *key, F.lit("mismatch"))).otherwise(choose(DEGRADATIONS, *key, F.lit("type")))
    severity = F.when(is_mismatch, "high").otherwise(choose(slots, *key, F.lit("severity")))
    original = F.col("variant_idx") == 0
    return rows.select(*index.columns, "variant_idx", (~original).alias("is_counterfactual"), F.when(original, "none").otherwise(kind).alias("degradation_type"), F.when(original, "none").otherwise(severity).alias("severity"), F.when(~original, F.col("sample_id")).alias("source_sample_id"))


def stress_variants(index: DataFrame, seed: int = 42) -> DataFrame:
    """One high-severity variant of every row."""
    return index.select(*index.columns, F.lit(1).alias("variant_idx"), F.lit(True).alias("is_counterfactual"), choose(STRESS_TYPES, F.lit(seed), F.col("sample_id"), F.lit("stress")).alias("degradation_type"), F.lit("high").alias("severity"), F.col("sample_id").alias("source_sample_id"))


def ranked_pool(pool: DataFrame) -> DataFrame:
    """Distinct samples numbered from 0 in the order of (md5 of the id, id), without a window over all of them: numbers within
    4,096 ranges of the md5, and what comes before each range. Of rows with one id the least question and image count."""
    digest = F.md5("sample_id")
    ids = pool.groupBy("sample_id").agg(F.min(F.struct("question", "image_path")).alias("x")).select("sample_id", "x.*", F.substring(digest, 1, 3).alias("_part"))
    begin, starts = 0, []
    for r in sorted(ids.groupBy("_part").count().collect()):  # 4,096 rows at most
        starts.append((r["_part"], begin))
        begin += r["count"]
    starts = pool.sparkSession.createDataFrame(starts, "_part string, _begin long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(digest, "sample_id")) - 1
    return ids.withColumn("_nth", nth).join(F.broadcast(starts), "_part").select("sample_id", "question", "image_path", (F.col("_begin") + F.col("_nth")).alias("rank"))


def mismatch(variants: DataFrame, pool: DataFrame, seed: int = 42) -> DataFrame:
    """variants with the question, the image, or both taken from other samples, as degradation_type says.

    Partners are uniform over the other samples: the sample's number plus 1 + hash mod (n - 1), mod n; for both parts the
    second offset skips the first. Fails fast where the pool has too few samples. The answer and the id stay.
    """
    with Tables(pool.sparkSession) as tables:
        ranks = tables.write(ranked_pool(pool), "pool", keep=True)  # it is read four times
    n = ranks.count()
    rows = variants.where(F.col("degradation_type").isin(*MISMATCHES))
    if n < 3 and not rows.isEmpty() and (n < 2 or not rows.where(F.col("degradation_type") == MISMATCHES[2]).isEmpty()):
        raise ValueError("the pool has too few distinct samples")
    me = ranks.select("sample_id", F.col("rank").alias("_r"))
    key = [F.lit(seed), F.col("sample_id"), F.col("variant_idx")]
    first = F.pmod(bits(*key, F.lit("one")), F.lit(max(n - 1, 1))) + 1
    second = F.pmod(bits(*key, F.lit("two")), F.lit(max(n - 2, 1))) + 1
    rows = rows.join(me, "sample_id").withColumn("_o", first).withColumn("_p", F.when(second >= F.col("_o"), second + 1).otherwise(second))
    rows = rows.withColumns({"_a": F.pmod(F.col("_r") + F.col("_o"), F.lit(max(n, 1))), "_b": F.pmod(F.col("_r") + F.col("_p"), F.lit(max(n, 1)))})
    one = ranks.select(F.col("rank").alias("_a"), F.col("question").alias("_q"), F.col("image_path").alias("_i"), F.col("sample_id").alias("partner_id"))
    two = ranks.select(F.col("rank").alias("_b"), F.col("image_path").alias("_j"))
    kind = F.col("degradation_type")
    out = rows.join(one, "_a").join(two, "_b", "left")
    question = F.when(kind.isin(MISMATCHES[0], MISMATCHES[2]), F.col("_q")).otherwise(F.col("question"))
    image = F.when(kind == MISMATCHES[1], F.col("_i")).when(kind == MISMATCHES[2], F.col("_j")).otherwise(F.col("image_path"))
    return out.withColumns({"question": question, "image_path": image}).select(*variants.columns, "partner_id")


def degraded_names(variants: DataFrame) -> DataFrame:
    """Ids and file names of degraded variants, with the variant's number so that none collide."""
    kind, sev = F.col("degradation_type"), F.col("severity")
    ext = F.when(suffix(F.col("image_path")) == "", ".png").otherwise(suffix(F.col("image_path")))
    return variants.withColumns({"sample_id": F.concat_ws("__", "source_sample_id", F.concat_ws("_", kind, sev)), "file_name": F.concat(F.concat_ws("_", F.coalesce("source_sample_id", stem(F.col("image_path"))), kind, sev, F.col("variant_idx").cast("string")), ext)})


def augmented(variants: DataFrame, pool: DataFrame, images: DataFrame, root: str, seed: int = 42) -> DataFrame:
    """All variants with their question and image: originals as they are, mismatches by mismatch(), and of the others a
    degraded copy of the image, written below root as PNG, with the id that names it. images: image_path, height, width
    and data (RGB). Variants whose image is not among images get a null path."""
    kind = F.col("degradation_type")
    plain = variants.where(~kind.isin(*MISMATCHES, *DEGRADATIONS))
    swapped = mismatch(variants, pool, seed).select(*variants.columns)
    known = images.select(F.col("image_path").alias("_path"), "height", "width", "data")
    met = degraded_names(variants.where(kind.isin(*DEGRADATIONS))).join(known, F.col("image_path") == F.col("_path"), "left").drop("_path", "image_path")
    key = F.concat_ws("|", F.lit(seed), "source_sample_id", F.col("variant_idx").cast("string"))
    made = met.withColumn("data", degrade_column(F.col("data"), F.col("height"), F.col("width"), kind, F.col("severity"), key))
    named = made.withColumn("file_name", F.concat(stem(F.col("file_name")), F.lit(".png")))
    return plain.unionByName(swapped).unionByName(save_images(named, root).select(*variants.columns))


def teacher_records(variants: DataFrame, output: Column, *more: Column) -> DataFrame:
    return variants.select("sample_id", "image_path", "question", F.col("answer").alias("reference_answer"), "split", F.coalesce("is_counterfactual", F.lit(False)).alias("is_counterfactual"), F.coalesce("degradation_type", F.lit("none")).alias("degradation_type"), F.coalesce("severity", F.lit("none")).alias("severity"), F.coalesce("source_sample_id", "sample_id").alias("source_sample_id"), output.alias("teacher_output"), *more)
