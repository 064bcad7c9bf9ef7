"""Records of predictions, as validation, evaluation and inference write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.functions.text import normalize_answer
from mirador.operators.outputs import output_fields


def correctness(prediction: str, reference: Column, should_abstain: Column) -> Column:
    """For an abstention whether to abstain was right, else whether the normalised answers are equal."""
    same = normalize_answer(F.col(f"{prediction}.answer")) == normalize_answer(reference)
    return F.when(F.col(f"{prediction}.decision").eqNullSafe("abstain"), should_abstain).otherwise(same)


def prediction_records(df: DataFrame, should_abstain: Column, prediction: str = "prediction") -> DataFrame:
    """sample_id, question, image_path, reference_answer, ground_truth_should_abstain, prediction, is_correct of rows with an
    index record's columns and a struct of a parsed output. A null answer is the empty reference."""
    reference = F.coalesce("answer", F.lit(""))
    flag = F.coalesce(should_abstain.cast("boolean"), F.lit(False))
    return df.select(
        "sample_id", "question", "image_path", reference.alias("reference_answer"), flag.alias("ground_truth_should_abstain"),
        output_fields(prediction).alias("prediction"), correctness(prediction, reference, flag).alias("is_correct"),
    )


def inference_records(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.select("sample_id", "image_path", "question", output_fields(prediction).alias("prediction"))


def inference_items(spark: SparkSession, input_jsonl: str | None = None, image_path: str | None = None, question: str | None = None) -> DataFrame:
    """What to predict: the rows of a JSON Lines file, else one image and question, whose sample_id is null; without either an
    error."""
    if input_jsonl:
        return spark.read.schema("sample_id string, image_path string, question string").option("mode", "FAILFAST").json(input_jsonl)
    if not (image_path and question):
        raise ValueError("give a JSON Lines file, or an image and a question")
    return spark.createDataFrame([(None, image_path, question)], "sample_id string, image_path string, question string")
