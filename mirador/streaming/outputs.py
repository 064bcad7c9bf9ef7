"""The validator over a stream of output files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mirador.operators.outputs import parse_and_validate


def validate_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "sample_id string, raw_text string"):
    """Starts a query that parses and validates new JSON files of source and appends the rows to target, then stops."""
    rows: DataFrame = spark.readStream.schema(schema).json(source)
    out = parse_and_validate(rows, "raw_text").select("sample_id", "raw_text", "output_status", "output_errors", "output.decision", "output.raw_confidence")
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
