"""The report's metrics over a stream of prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.operators.metrics import metric_counts, report_of

PREDICTION_SCHEMA = "decision string, ground_truth_should_abstain boolean, is_correct boolean, raw_confidence double"


def metrics_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = PREDICTION_SCHEMA, files_per_batch: int = 1, form: str = "json", bins: int = 10):
    """Starts a query over new files of source, then stops. The state is a row of counts and sums for each confidence bin, kept
    across micro-batches and runs in checkpoint; after each micro-batch the report of all rows so far is written to
    target/batch=<n>, again to the same place should the batch be run again."""
    rows: DataFrame = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(source)

    def emit(counts: DataFrame, n: int) -> None:
        report_of(counts).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return metric_counts(rows, bins=bins).writeStream.outputMode("complete").foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_report(spark: SparkSession, target: str) -> DataFrame:
    """The report after the last micro-batch; without any, no rows."""
    all_of = spark.read.parquet(target)
    last = all_of.agg(F.max("batch").alias("batch"))
    return all_of.join(F.broadcast(last), "batch").drop("batch")
