"""Tables of the domain derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("sample_id"), (F.least(F.floor("value"), F.lit(100)) / F.lit(100.0)).cast("double").alias("raw_confidence"),
        F.when(F.col("event_type").isin("error", "signup"), "abstain").otherwise("answer").alias("decision"), (F.col("user_id") % 3 == 0).alias("ground_truth_should_abstain"),
        F.when(k % 2 == 0, " Yes ").otherwise("no").alias("answer"), F.when(k % 3 == 0, "YES").otherwise("No").alias("reference_answer"),
    )
    from mirador.operators.metrics import attach_correctness

    return attach_correctness(rows)


PREDICTIONS = """fx AS (SELECT 'ev_' || event_id AS sample_id, CAST(least(floor(value), 100) / 100.0 AS DOUBLE) AS raw_confidence,
  CASE WHEN event_type IN ('error', 'signup') THEN 'abstain' ELSE 'answer' END AS decision, user_id % 3 = 0 AS ground_truth_should_abstain,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN ' Yes ' ELSE 'no' END AS answer,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0 THEN 'YES' ELSE 'No' END AS reference_answer FROM events),
p AS (SELECT *, CASE WHEN decision = 'abstain' THEN ground_truth_should_abstain ELSE trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(reference_answer), '\\s+', ' ', 'g')) END AS is_correct FROM fx)"""


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = c.where("role = 'user'").join(a, ["conv_id", "turn"])
    pos = F.col("conv_id") * 1000 + F.col("turn")
    five = F.col("conv_id") % 5
    return both.select(
        pos.alias("pos"), F.col("text").alias("question"), "answer", F.concat(F.lit("img_"), (F.col("conv_id") % 50).cast("string"), F.lit(".png")).alias("image_name"),
        F.when(five == 0, "TEST").when(five == 1, " dev ").otherwise("Training").alias("split_full"), F.when(five == 4, F.lit(None)).when(five == 0, "test").otherwise("train").alias("split_partial"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("q"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))).alias("qid"),
    )


QA = """q AS (SELECT u.conv_id * 1000 + u.turn AS pos, u.text AS question, a.text AS answer, 'img_' || (u.conv_id % 50) || '.png' AS image_name,
  CASE u.conv_id % 5 WHEN 0 THEN 'TEST' WHEN 1 THEN ' dev ' ELSE 'Training' END AS split_full, CASE u.conv_id % 5 WHEN 4 THEN NULL WHEN 0 THEN 'test' ELSE 'train' END AS split_partial,
  CASE WHEN u.conv_id % 2 = 0 THEN 'q' || u.conv_id || '_' || u.turn END AS qid
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
ix AS (SELECT coalesce(qid, 'vqarad_' || substr(md5(concat_ws('|', pos, image_name, trim(question), trim(answer))), 1, 12)) AS sample_id, image_name AS image_path, trim(question) AS question, trim(answer) AS answer,
  CASE lower(trim(split_full)) WHEN 'test' THEN 'test' WHEN 'dev' THEN 'val' WHEN 'training' THEN 'train' END AS split, pos FROM q WHERE trim(question) <> '')"""


def outputs(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    d = F.col("doc_id") + shift
    decision = F.when(F.col("quality") == 1, "answer").otherwise("abstain")
    kind = F.when((F.col("quality") == 1) & (d % 19 == 0), "region_missing").when((d % 7 == 0) | (F.col("quality") == 1), "none")
    kind = kind.when(d % 4 == 0, "visual_insufficiency").when(d % 4 == 1, "region_missing").when(d % 4 == 2, "question_mismatch").otherwise("high_risk_uncertainty")
    risk = F.when(F.col("toxic") == 1, "high").when(d % 2 == 0, "medium").otherwise("low")
    said = F.when(d % 5 == 0, "The view is INSUFFICIENT here.").when(d % 11 == 0, " ").otherwise("The finding is plain.")
    answer = F.when(d % 3 == 0, "Yes").when(d % 13 == 0, "").otherwise("lesion")
    body = F.concat(F.lit('{"explanation": "'), said, F.lit('", "raw_confidence": '), (d % 120).cast("string"), F.lit('e-2, "decision": "'), decision, F.lit('", "abstain_type": "'), kind, F.lit('"'), F.when(d % 17 == 0, "").otherwise(F.concat(F.lit(', "risk_level": "'), risk, F.lit('"'))), F.lit(', "answer": "'), answer, F.lit('"'), F.when(d % 9 == 0, "").otherwise("}"))
    text = F.when(d % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(d % 4 == 2, F.concat(F.lit("Here: "), body, F.lit(" Done."))).otherwise(body)
    return table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id", text.alias("raw_text"))


def outputs_sql(name: str, shift: int = 0) -> str:
    d = f"(doc_id + {shift})"
    return f"""{name} AS (SELECT doc_id, {d} AS d, CASE WHEN quality = 1 THEN 'answer' ELSE 'abstain' END AS decision,
  CASE WHEN quality = 1 AND {d} % 19 = 0 THEN 'region_missing' WHEN {d} % 7 = 0 OR quality = 1 THEN 'none' WHEN {d} % 4 = 0 THEN 'visual_insufficiency' WHEN {d} % 4 = 1 THEN 'region_missing' WHEN {d} % 4 = 2 THEN 'question_mismatch' ELSE 'high_risk_uncertainty' END AS abstain_type,
  CASE WHEN toxic = 1 THEN 'high' WHEN {d} % 2 = 0 THEN 'medium' ELSE 'low' END AS risk_level, {d} % 5 = 0 AS hint, {d} % 5 <> 0 AND {d} % 11 = 0 AS blank,
  CASE WHEN {d} % 3 = 0 THEN 'Yes' WHEN {d} % 13 = 0 THEN '' ELSE 'lesion' END AS answer, ({d} % 120) / 100.0 AS raw_confidence,
  CASE WHEN {d} % 9 = 0 THEN 'unparsed' WHEN {d} % 17 = 0 THEN 'missing' ELSE 'full' END AS form FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"""
