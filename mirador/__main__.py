"""Command line: python -m mirador prepare | variants | teach | batches | pairs | calibrate | evaluate | infer | validate, each over files; see --help."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.functions.rows import number_rows
from mirador.functions.text import file_uri
from mirador.operators import batches, metrics, outputs, pairs, prepare, prompts, records, variants
from mirador.sources import calls, io
from mirador.sources.model import Policy, http_backend
from mirador.sources.probe import resolve_by_probing
from mirador.sources.requests import attach_images, image_files, local_path
from mirador.sources.scratch import Tables


def _flat(df: DataFrame) -> DataFrame:
    """Prediction records with the fields of their struct beside the others, as the metrics want them."""
    inner = [c for c in ("decision", "raw_confidence", "calibrated_confidence") if "prediction" in df.columns and c in df.schema["prediction"].dataType.names]
    return df.select("*", *[F.col(f"prediction.{c}").alias(c) for c in inner]) if inner else df


def run_prepare(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    annotations, folder = io.resolve_paths(spark, a.dataset_root, a.annotations_file, a.images_dir)
    rows = prepare.normalize_rows(io.read_json(spark, annotations)).drop("raw_metadata")
    rows = resolve_by_probing(rows, folder)
    rows = prepare.require_rows(prepare.limit_rows(rows, a.limit), "samples")
    index = prepare.assign_splits(rows, a.seed, config.get("dataset", {}).get("val_ratio", a.val_ratio))
    io.split_writer(prepare.index_records(index), a.output)
    return {r["split"]: r["n"] for r in prepare.split_counts(index).collect()}


def run_variants(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    c = config.get("augmentation", {})
    index = io.read_jsonl(spark, a.input_jsonl)
    index = index if a.limit is None else index.limit(a.limit)
    made = variants.fan_out(index, int(c.get("per_sample_variants", 4)), float(c.get("mismatch_probability", 0.25)), c.get("severity_weights"), a.seed)
    io.write_jsonl(made, a.output)
    return {"variants": spark.read.json(a.output).count()}


def _policy(a: argparse.Namespace, config: dict) -> Policy:
    c = config.get("teacher", {})
    return Policy(float(c.get("temperature", 0.2)), int(c.get("max_tokens", 800)), int(c.get("max_retries", 3)), a.backoff)


def _said(rows: DataFrame, messages, images: DataFrame, url: str, model: str, a: argparse.Namespace, policy: Policy, into: str) -> DataFrame:
    """rows with what a service says to their messages: `into`_text, and parsed and validated `into`. Requests whose picture is
    not there, and those without a valid output, have none."""
    ready = attach_images(rows.withColumn("messages", messages), images)
    ready = ready.withColumn("messages_json", F.when(F.size("missing_images") == 0, F.to_json("messages"))).drop("messages", "missing_images")
    got = calls.ask(ready, a.store, http_backend(url, model, a.key_variable), policy, model, valid=True, error_log=a.error_log)
    got = got.withColumnRenamed("response_text", f"{into}_text").drop("messages_json", "request_key", "attempts")
    return outputs.parse_and_validate(got, f"{into}_text", into)


def run_teach(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    """Training records: all variants of index rows, with their degraded images or swapped parts, and the teacher's outputs."""
    c = config.get("augmentation", {})
    index = io.read_jsonl(spark, a.input_jsonl, "sample_id string, image_path string, question string, answer string, split string")
    index = index if a.limit is None else index.limit(a.limit)
    made = variants.fan_out(index, int(c.get("per_sample_variants", 4)), float(c.get("mismatch_probability", 0.25)), c.get("severity_weights"), a.seed)
    known = io.read_images(spark, a.images_dir).select(local_path(F.col("origin")).alias("image_path"), "height", "width", "data")
    root = f"{a.output}-images"
    with Tables(spark) as tables:
        rows = tables.write(variants.augmented(made, index, known, root, a.seed), "variants")
        images = image_files(spark, a.images_dir)
        images = images.unionByName(image_files(spark, root)) if io.exists(spark, root) else images
        asked = prompts.teacher_messages(F.col("question"), file_uri(F.col("image_path")), F.col("is_counterfactual"), F.col("degradation_type"), F.col("severity"))
        said = _said(rows.where("image_path is not null"), asked, images, a.teacher_url, a.teacher_model, a, _policy(a, config), "teacher_output")
        good, rest = outputs.write_quarantined(said, f"{a.output}-parsed", "teacher_output")
        told = variants.teacher_records(good, outputs.output_fields("teacher_output"), F.col("teacher_output.normalized").alias("teacher_text"))
        io.write_jsonl(told, a.output)
        report = {"records": good.count(), "rejected": rest.count() + rows.where("image_path is null").count()}
    io.remove(spark, f"{a.output}-parsed")
    return report


def run_batches(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    """Training batches of teacher records, as Parquet; the hold-out's in a folder of its own."""
    c = config.get("training", {})
    rows = number_rows(io.read_jsonl(spark, a.input_jsonl, "sample_id string, image_path string, question string, teacher_text string"), "pos")
    held = prepare.hold_out(rows, float(config.get("data", {}).get("eval_ratio", a.eval_ratio)), a.seed)
    said = held.withColumn("messages", prompts.training_messages(F.col("question"), file_uri(F.col("image_path")), F.col("teacher_text")))
    key = F.concat_ws("_", "sample_id", F.col("pos").cast("string"))
    with Tables(spark) as tables:
        tokens = tables.write(batches.sft_tokens(said.select(key.alias("key"), "held_out", "messages"), a.tokenizer, int(c.get("max_seq_length", a.max_length))), "tokens")
        for name, flag in (("train", False), ("eval", True)):
            size = int(c.get(f"per_device_{name}_batch_size", a.batch_size))
            batches.length_batches(tokens.where(F.col("held_out") == flag), "key", size, a.pad_id).write.mode("overwrite").parquet(f"{a.output}/{name}")
    return {name: spark.read.parquet(f"{a.output}/{name}").count() for name in ("train", "eval")}


def run_pairs(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    """Stress rows, or one stress variant of each index row; the teacher's output, and only where that may make a pair the student's."""
    rows = io.read_jsonl(spark, a.input_jsonl)
    rows = rows if "degradation_type" in rows.columns else variants.stress_variants(rows, a.seed)
    rows = rows.select("sample_id", (F.col("variant_idx") if "variant_idx" in rows.columns else F.lit(1)).alias("variant_idx"), "image_path", "question", *[F.col(c) for c in ("is_counterfactual", "degradation_type", "severity")])
    rows = rows if a.limit is None else rows.limit(a.limit)
    images, policy, url = image_files(spark, a.images_dir), _policy(a, config), file_uri(F.col("image_path"))
    asked = prompts.teacher_messages(F.col("question"), url, F.col("is_counterfactual"), F.col("degradation_type"), F.col("severity"))
    taught = _said(rows, asked, images, a.teacher_url, a.teacher_model, a, policy, "teacher_output")
    taught = taught.where((F.col("teacher_output_status") == "ok") & pairs.teacher_allows("teacher_output")).drop("teacher_output_errors", "teacher_output_status", "teacher_output_text")
    both = _said(taught, prompts.inference_messages(F.col("question"), url), images, a.student_url, a.student_model, a, policy, "student_output").where("student_output_status = 'ok'")
    made = pairs.mine_pairs(both, rejected="student_output_text")
    io.write_jsonl(prepare.require_rows(made, "pairs") if a.required else made, a.output)
    return {"pairs": spark.read.schema("sample_id string").json(a.output).count()}


def run_infer(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    """Predictions for the rows of a file, or for one image and question; rows without a valid output go to <output>-rejected."""
    items = records.inference_items(spark, a.input_jsonl, a.image_path, a.question)
    items = items if a.limit is None else items.limit(a.limit)
    images = image_files(spark, a.images_dir or a.image_path.rsplit("/", 1)[0])
    said = _said(items, prompts.inference_messages(F.col("question"), file_uri(F.col("image_path"))), images, a.student_url, a.student_model, a, _policy(a, config), "prediction")
    good, rest = outputs.write_quarantined(said, f"{a.output}-parsed", "prediction")
    found = records.inference_records(good)
    if a.apply_calibration:
        model = spark.read.option("multiLine", True).json(a.apply_calibration) if io.exists(spark, a.apply_calibration) else None
        flat = metrics.apply_calibration(found.withColumn("raw_confidence", F.col("prediction.raw_confidence")), model)
        found = flat.withColumn("prediction", F.col("prediction").withField("calibrated_confidence", F.col("calibrated_confidence"))).drop("raw_confidence", "calibrated_confidence")
    io.write_jsonl(found, a.output)
    io.write_jsonl(rest.select("sample_id", "image_path", "question", "prediction_text", "prediction_errors"), f"{a.output}-rejected")
    io.remove(spark, f"{a.output}-parsed")
    return {"predictions": spark.read.schema("question string").json(a.output).count(), "rejected": spark.read.schema("question string").json(f"{a.output}-rejected").count()}


def run_calibrate(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    model = metrics.fit_calibration(_flat(io.read_jsonl(spark, a.input_jsonl)))
    report = model.first().asDict()
    io.write_json(spark, report, a.output)
    return report


def run_evaluate(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    rows = _flat(io.read_jsonl(spark, a.input_jsonl))
    if a.apply_calibration:
        model = spark.read.option("multiLine", True).json(a.apply_calibration) if io.exists(spark, a.apply_calibration) else None
        rows = metrics.apply_calibration(rows, model)
    report = metrics.all_metrics(rows).first().asDict()
    if a.output:
        io.write_json(spark, report, a.output)
    return report


def run_validate(spark: SparkSession, a: argparse.Namespace, config: dict) -> dict:
    found = outputs.parse_and_validate(io.read_jsonl(spark, a.input_jsonl), a.column)
    io.write_jsonl(found, a.output)
    return {r["output_status"]: r["n"] for r in spark.read.json(a.output).groupBy("output_status").agg(F.count("*").alias("n")).collect()}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mirador", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    runs = {"prepare": run_prepare, "variants": run_variants, "teach": run_teach, "batches": run_batches, "pairs": run_pairs, "calibrate": run_calibrate, "evaluate": run_evaluate, "infer": run_infer, "validate": run_validate}
    for name, run in runs.items():
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--config", help="a YAML file of settings")
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--limit", type=int, help="only so many rows, the first")
        p.add_argument("--output", required=name != "evaluate")
        if name == "prepare":
            p.add_argument("--dataset-root")
            p.add_argument("--annotations-file")
            p.add_argument("--images-dir")
            p.add_argument("--val-ratio", type=float, default=0.1)
        else:
            p.add_argument("--input-jsonl", required=name != "infer")
        if name in ("teach", "pairs", "infer"):
            p.add_argument("--images-dir", required=name != "infer", help="the folder below which the rows' images are")
            p.add_argument("--store", required=True, help="the folder of answers; what it holds is not asked again")
            p.add_argument("--error-log", help="a folder to which failed attempts are appended")
            p.add_argument("--key-variable", help="the environment variable with the service's key")
            p.add_argument("--backoff", type=float, default=2.0)
        if name in ("pairs", "infer"):
            p.add_argument("--student-url", required=True)
            p.add_argument("--student-model", default="student")
        if name in ("teach", "pairs"):
            p.add_argument("--teacher-url", required=True)
            p.add_argument("--teacher-model", default="teacher")
        if name == "batches":
            p.add_argument("--tokenizer", required=True, help="a tokenizer's JSON file, at that path on every executor")
            p.add_argument("--pad-id", type=int, required=True)
            p.add_argument("--max-length", type=int, default=1536)
            p.add_argument("--batch-size", type=int, default=1)
            p.add_argument("--eval-ratio", type=float, default=0.05)
        if name == "pairs":
            p.add_argument("--required", action="store_true", help="no pair at all is an error")
        if name == "infer":
            p.add_argument("--image-path")
            p.add_argument("--question")
        if name in ("evaluate", "infer"):
            p.add_argument("--apply-calibration", help="a calibration report; passed over where it does not exist")
        if name == "validate":
            p.add_argument("--column", default="raw_text")
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs a command and prints its report as JSON."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("mirador").getOrCreate()
    report = a.run(spark, a, io.read_config(a.config) if a.config else {})
    print(json.dumps(report, ensure_ascii=False, indent=2))
    return report


if __name__ == "__main__":
    main()
