"""The corpus pipeline: documents in, packed sequences out. Each stage's result is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mirador.llm.common import discard, discard_since, materialize, written
from mirador.llm.decontaminate import decontaminate
from mirador.llm.jaccard_join import keep_one
from mirador.llm.language_id import accepted
from mirador.llm.line_dedup import without_repeats
from mirador.llm.packing import pack_documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is certain."""
    return accepted(docs)


def dedup_document_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line; documents left without any line that is not blank go."""
    return without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near duplicates."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten words in a row of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_document_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages need trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for name, stage in STAGES[:-1]:
        begun = written()
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard_since(spark, begun, docs)  # what the stage wrote besides, and what it read
        discard(*before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
