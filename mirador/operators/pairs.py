"""Preference pairs from teacher and student outputs, and the loss of a pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirador.operators.outputs import output_fields


def teacher_allows(teacher: str) -> Column:
    """The teacher's half of should_keep_pair, known before the student is asked: it abstained or saw high risk."""
    return F.col(f"{teacher}.decision").eqNullSafe("abstain") | F.col(f"{teacher}.risk_level").eqNullSafe("high")


def should_keep_pair(teacher: str, student: str) -> Column:
    """The student answered where the teacher abstained or saw high risk."""
    return F.col(f"{student}.decision").eqNullSafe("answer") & teacher_allows(teacher)


def pair_outputs(teachers: DataFrame, students: DataFrame) -> DataFrame:
    """Teacher and student rows of one variant; sample_id alone is not unique."""
    return teachers.join(students, ["sample_id", "variant_idx"])


def mine_pairs(both: DataFrame, teacher: str = "teacher_output", student: str = "student_output", rejected: str = "student_text") -> DataFrame:
    """The kept pairs: chosen is the teacher's output as JSON text (its own keys in their order, values normalised, nothing else),
    rejected the student's text as it came; both outputs with their six fields and what else they held."""
    kept = both.where(should_keep_pair(teacher, student))
    return kept.select("sample_id", "image_path", "question", F.col(f"{teacher}.normalized").alias("chosen"), F.col(rejected).alias("rejected"), output_fields(teacher).alias(teacher), output_fields(student).alias(student))


def loss_steps(losses: DataFrame, accumulate: int) -> DataFrame:
    """(step, n, loss): what each optimiser step of a pass adds to the running loss, of losses (n, counted from 1, and loss).
    Each pair counts loss / accumulate; a step ends after `accumulate` pairs, the last where the pairs end, divided by
    `accumulate` all the same."""
    step = F.ceil(F.col("n") / accumulate).cast("int")
    return losses.groupBy(step.alias("step")).agg(F.count("*").alias("n"), (F.sum("loss") / accumulate).alias("loss"))


def running_loss(steps: DataFrame) -> DataFrame:
    """One row: the number of steps of a pass and its running loss."""
    return steps.agg(F.count("*").alias("steps"), F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"))
