"""Queries over the derived tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.functions import arrays, text
from mirador.operators import batches, calibration, images, metrics, outputs, pairs, prepare, prompts, records, variants
from mirador.plans import fixtures as fx
from mirador.sources import calls
from mirador.sources.model import Policy
from mirador.sources.requests import attach_images
from mirador.sources.scratch import new_folder
from mirador.streaming.metrics import PREDICTION_SCHEMA, latest_report, metrics_stream

QUERIES, ORACLE_SQL = {}, {}
P, Q = fx.PREDICTIONS, fx.QA


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.qa(spark, sf_dir).withColumnsRenamed({"split_full": "split", "qid": "sample_id"}).drop("split_partial")
    return prepare.normalize_rows(raw).drop("raw_metadata")


_RATES = {
    "accuracy_at_answer": "count_if(decision = 'answer' AND is_correct)::DOUBLE / nullif(count_if(decision = 'answer'), 0)",
    "attack_success_rate": "count_if(ground_truth_should_abstain AND decision = 'answer')::DOUBLE / nullif(count_if(ground_truth_should_abstain), 0)",
    "false_definite_rate": "count_if(decision = 'answer' AND NOT is_correct)::DOUBLE / nullif(count_if(decision = 'answer'), 0)",
    "coverage": "count_if(decision = 'answer')::DOUBLE / nullif(count(*), 0)",
    "abstention_success_rate": "count_if(ground_truth_should_abstain AND decision = 'abstain')::DOUBLE / nullif(count_if(ground_truth_should_abstain), 0)",
    "false_refusal_rate": "count_if(NOT ground_truth_should_abstain AND decision = 'abstain')::DOUBLE / nullif(count_if(NOT ground_truth_should_abstain), 0)",
    "selective_risk": "count_if(decision = 'answer' AND raw_confidence >= 0.5 AND NOT is_correct)::DOUBLE / nullif(count_if(decision = 'answer' AND raw_confidence >= 0.5), 0)",
}
_ECE = "SELECT round(coalesce(sum(abs(conf - acc) * n) / sum(n), 0), 9) FROM (SELECT len(list_filter([0.0, 0.1, 0.2, 3 * 0.1::DOUBLE, 0.4, 0.5, 6 * 0.1::DOUBLE, 7 * 0.1::DOUBLE, 0.8, 0.9]::DOUBLE[], lambda e: e <= c)) AS b, avg(c) AS conf, avg(ok) AS acc, count(*) AS n FROM (SELECT raw_confidence::FLOAT::DOUBLE AS c, is_correct::INT::DOUBLE AS ok FROM p) GROUP BY 1)"


@query(f"WITH {P} SELECT " + ", ".join(f"round(coalesce({v}, 0), 9) AS {k}" for k, v in _RATES.items()) + " FROM p")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rates of the metrics layer, those of the report and those only declared, in one pass."""
    m = metrics
    made = [m.accuracy_at_answer(), m.attack_success_rate(), m.false_definite_rate(), m.coverage(), m.abstention_success_rate(), m.false_refusal_rate(), m.selective_risk(0.5)]
    return fx.predictions(spark, sf_dir).agg(*[F.round(c, 9).alias(k) for c, k in zip(made, _RATES, strict=True)])


@query(f'WITH {P} SELECT round({_RATES["accuracy_at_answer"]}, 9) AS "Accuracy@Answer", round({_RATES["attack_success_rate"]}, 9) AS "ASR", round({_RATES["false_definite_rate"]}, 9) AS "FDR", ({_ECE}) AS "ECE", round({_RATES["coverage"]}, 9) AS "Coverage" FROM p')
def metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five metrics of the report."""
    found = metrics.all_metrics(fx.predictions(spark, sf_dir))
    return found.select(*[F.round(F.col(f"`{c}`"), 9).alias(c) for c in found.columns])


@query(ORACLE_SQL["metrics_all"])
def metrics_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five metrics over a stream: predictions in three files, a micro-batch each, the report after the last."""
    rows = fx.predictions(spark, sf_dir).selectExpr(*[f"{x.split()[0]}" for x in PREDICTION_SCHEMA.split(", ")])
    folder = new_folder(spark, "stream")
    rows.repartition(3, F.xxhash64("raw_confidence", "decision", "is_correct")).write.parquet(f"{folder}/in")
    metrics_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", form="parquet").awaitTermination()
    found = latest_report(spark, f"{folder}/out")
    return found.select(*[F.round(F.col(f"`{c}`"), 9).alias(c) for c in found.columns])


@query(f"WITH {P} SELECT CAST(b AS INT) AS bin, count(*) AS n, round(avg(c), 9) AS confidence, round(avg(ok), 9) AS accuracy FROM (SELECT c, ok, len(list_filter([0.0, 0.1, 0.2, 3 * 0.1::DOUBLE, 0.4, 0.5, 6 * 0.1::DOUBLE, 7 * 0.1::DOUBLE, 0.8, 0.9]::DOUBLE[], lambda e: e < c)) - 1 AS b FROM (SELECT raw_confidence::FLOAT::DOUBLE AS c, is_correct::INT::DOUBLE AS ok FROM p) WHERE c > 0 AND c <= 1) GROUP BY 1")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability_bins(fx.predictions(spark, sf_dir)).select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {P} SELECT count_if(decision = 'answer')::BIGINT AS answer, count_if(decision = 'abstain')::BIGINT AS abstain FROM p")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.decision_counts(fx.predictions(spark, sf_dir))


@query(f"WITH {P}, g AS (SELECT raw_confidence::FLOAT AS c, count(*) AS n, count_if(NOT is_correct) AS bad FROM p GROUP BY 1), w AS (SELECT n, bad, coalesce(sum(n) OVER s, 0) AS n0, coalesce(sum(bad) OVER s, 0) AS b0 FROM g WINDOW s AS (ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT n, bad, n0, b0, unnest(generate_series(1, n)) AS i FROM w) SELECT round(avg((b0 + bad * i / n::DOUBLE) / (n0 + i)), 9) AS \"AURC\" FROM i")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_coverage(fx.predictions(spark, sf_dir)).select(F.round("AURC", 9).alias("AURC"))


_BINNED = "len(list_filter([0.0, 0.1, 0.2, 3 * 0.1::DOUBLE, 0.4, 0.5, 6 * 0.1::DOUBLE, 7 * 0.1::DOUBLE, 0.8, 0.9]::DOUBLE[], lambda e: e <= c))"


@query(f"""WITH {P}, e AS (SELECT reference_answer AS r, {_BINNED} AS b, avg(c) AS conf, avg(ok) AS acc, count(*) AS n
  FROM (SELECT reference_answer, raw_confidence::FLOAT::DOUBLE AS c, is_correct::INT::DOUBLE AS ok FROM p) GROUP BY 1, 2),
w AS (SELECT r, sum(abs(conf - acc) * n) / sum(n) AS ece FROM e GROUP BY r)
SELECT reference_answer, round(coalesce({_RATES["accuracy_at_answer"]}, 0), 9) AS "Accuracy@Answer", round(coalesce({_RATES["attack_success_rate"]}, 0), 9) AS "ASR",
  round(coalesce({_RATES["false_definite_rate"]}, 0), 9) AS "FDR", round(any_value(w.ece), 9) AS "ECE", round({_RATES["coverage"]}, 9) AS "Coverage"
FROM p JOIN w ON w.r = p.reference_answer GROUP BY reference_answer""")
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five metrics for each group of predictions."""
    found = metrics.all_metrics(fx.predictions(spark, sf_dir), "reference_answer")
    return found.select("reference_answer", *[F.round(F.col(f"`{c}`"), 9).alias(c) for c in found.columns[1:]])


@query(f"""WITH {P} SELECT sample_id, trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')) AS answer, is_correct FROM p""")
def answers_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.predictions(spark, sf_dir).select("sample_id", text.normalize_answer(F.col("answer")).alias("answer"), "is_correct")


#: Isotonic regression in closed form: the largest over starts of the least over ends of the mean between them.
_ISO = """g AS (SELECT raw_confidence::FLOAT::DOUBLE AS x, avg(is_correct::INT) AS y, count(*) AS w FROM p WHERE raw_confidence IS NOT NULL AND is_correct IS NOT NULL GROUP BY 1),
h AS (SELECT x, w, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS sw, sum(w * y) OVER (ORDER BY x) AS sy FROM g),
m AS (SELECT a.i AS a, b.i AS b, (b.sy - coalesce(z.sy, 0)) / (b.sw - coalesce(z.sw, 0)) AS mean FROM h a JOIN h b ON a.i <= b.i LEFT JOIN h z ON z.i = a.i - 1),
l AS (SELECT h.i, m.a, min(m.mean) AS low FROM h JOIN m ON m.a <= h.i AND m.b >= h.i GROUP BY 1, 2),
iso AS (SELECT h.i, any_value(h.x) AS x, any_value(h.w) AS w, max(l.low) AS y FROM h JOIN l USING (i) GROUP BY h.i)"""


@query(f"""WITH {P}, {_ISO}, t AS (SELECT x, y, coalesce(abs(y - lag(y) OVER (ORDER BY x)) > 1e-9, true) OR coalesce(abs(y - lead(y) OVER (ORDER BY x)) > 1e-9, true) AS kept FROM iso)
SELECT 'isotonic_regression' AS method, (SELECT string_agg(CAST(CAST(round(x * 100) AS INT) AS VARCHAR), ',' ORDER BY x) FROM t WHERE kept) AS x_hundredths,
  (SELECT string_agg(CAST(CAST(round(y * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY x) FROM t WHERE kept) AS y_millionths,
  CAST(sum(w) AS INT) AS num_samples, round(sum(x * w) / sum(w), 7) AS mean_raw_confidence, round(sum(y * w) / sum(w), 7) AS mean_calibrated_confidence FROM iso""")
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic calibration and its summary; thresholds as texts of whole hundredths and millionths."""
    model = metrics.fit_calibration(fx.predictions(spark, sf_dir))
    whole = lambda c, n: F.array_join(F.transform(c, lambda v: F.round(v * n).cast("long").cast("string")), ",")
    return model.select("method", whole("x_thresholds", 100).alias("x_hundredths"), whole("y_thresholds", 1000000).alias("y_millionths"), "num_samples", F.round("mean_raw_confidence", 7).alias("mean_raw_confidence"), F.round("mean_calibrated_confidence", 7).alias("mean_calibrated_confidence"))


@query(f"WITH {P}, {_ISO} SELECT sample_id, raw_confidence, round(iso.y, 4) AS calibrated_confidence FROM p JOIN iso ON iso.x = p.raw_confidence::FLOAT::DOUBLE")
def calibration_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.predictions(spark, sf_dir)
    return calibration.apply_steps(rows, calibration.isotonic_steps(metrics.confidence_targets(rows))).select("sample_id", "raw_confidence", F.round("calibrated_confidence", 4).alias("calibrated_confidence"))


@query(f"""WITH {P}, {_ISO}, q AS (SELECT iso.y::FLOAT::DOUBLE AS c, is_correct::INT::DOUBLE AS ok FROM p JOIN iso ON iso.x = p.raw_confidence::FLOAT::DOUBLE)
SELECT round(sum(abs(conf - acc) * n) / sum(n), 4) AS "ECE" FROM (SELECT {_BINNED} AS b, avg(c) AS conf, avg(ok) AS acc, count(*) AS n FROM q GROUP BY 1)""")
def ece_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error after calibration on the same rows."""
    rows = fx.predictions(spark, sf_dir)
    found = metrics.expected_calibration_error(calibration.apply_steps(rows, calibration.isotonic_steps(metrics.confidence_targets(rows))))
    return found.select(F.round("ECE", 4).alias("ECE"))


@query(f"WITH {Q} SELECT sample_id, image_path, question, answer, split, CAST(NULL AS VARCHAR) AS answer_type, CAST(NULL AS VARCHAR) AS phrase_type FROM ix")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.index_records(index(spark, sf_dir))


@query(f"WITH {Q} SELECT split, count(*) AS n FROM ix GROUP BY split")
def split_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.split_counts(prepare.assign_splits(index(spark, sf_dir)))


@query(f"""WITH {Q}, n AS (SELECT count(*) AS n, greatest(1, round_even(count(*) * 0.2, 0))::BIGINT AS t FROM ix), s AS (SELECT t, round_even((n - t) * 0.1, 0)::BIGINT AS v FROM n),
r AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat_ws('|', 42, sample_id, pos)), pos) AS k FROM ix)
SELECT sample_id, CASE WHEN k <= t THEN 'test' WHEN k <= t + v THEN 'val' ELSE 'train' END AS split FROM r, s""")
def split_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index(spark, sf_dir).withColumn("split", F.when(F.col("pos") > 0, F.col("split")))
    return prepare.assign_splits(rows).select("sample_id", "split")


@query(f"WITH {Q} SELECT sample_id, question FROM ix ORDER BY pos LIMIT 50")
def prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the index, which is the feature."""
    return prepare.limit_rows(index(spark, sf_dir), 50).select("sample_id", "question")


@query(f"""WITH {Q}, n AS (SELECT ceil(count(*) * 0.05)::BIGINT AS k, count(*) AS n FROM ix), r AS (SELECT sample_id, row_number() OVER (ORDER BY md5(concat_ws('|', 42, 'sft', sample_id, pos)), pos) AS i FROM ix)
SELECT sample_id, n > 20 AND i <= k AS held_out FROM r, n""")
def sft_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.hold_out(index(spark, sf_dir), 0.05).select("sample_id", "held_out")


@query(f"WITH {Q} SELECT sample_id, false AS is_counterfactual, 'none' AS degradation_type, 'none' AS severity, CAST(NULL AS VARCHAR) AS source_sample_id FROM ix")
def base_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.base_variant(index(spark, sf_dir)).select("sample_id", "is_counterfactual", "degradation_type", "severity", "source_sample_id")


@query("""WITH f AS (SELECT i, unnest(CASE i % 6 WHEN 0 THEN ['/r/img_' || i || '.png'] WHEN 1 THEN ['/r/images/img_' || i || '.png'] WHEN 2 THEN ['/r/b/c/img_' || i || '.png', '/r/a/img_' || i || '.png']
  WHEN 3 THEN ['/r/images/img_' || i || '.png', '/r/img_' || i || '.png'] WHEN 4 THEN ['/r/z/img_' || i || '.jpg'] ELSE ['/r/other_' || i || '.png'] END) AS path FROM (SELECT unnest(range(0, 50)) AS i)),
a AS (SELECT e.event_id, e.user_id % 50 AS i, CASE WHEN e.event_id % 3 = 2 THEN '' ELSE '.png' END AS ext FROM events e)
SELECT event_id, CASE WHEN i % 6 = 5 OR (i % 6 = 4 AND ext = '.png') THEN NULL WHEN i % 6 = 4 THEN '/r/z/img_' || i || '.jpg' WHEN i % 6 = 2 THEN '/r/a/img_' || i || '.png'
  WHEN i % 6 = 1 THEN '/r/images/img_' || i || '.png' WHEN i % 6 = 3 AND ext = '' THEN '/r/images/img_' || i || '.png' ELSE '/r/img_' || i || '.png' END AS image_path FROM a""")
def images_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image names of events against a made-up listing of files: below the root, below images, elsewhere, twice, or absent; a third
    of the names have a folder that is not there, a third no suffix."""
    i = F.col("id")
    name = lambda p, e: F.concat(F.lit(p), i.cast("string"), F.lit(e))
    paths = F.when(i % 6 == 0, F.array(name("/r/img_", ".png"))).when(i % 6 == 1, F.array(name("/r/images/img_", ".png")))
    paths = paths.when(i % 6 == 2, F.array(name("/r/b/c/img_", ".png"), name("/r/a/img_", ".png"))).when(i % 6 == 3, F.array(name("/r/images/img_", ".png"), name("/r/img_", ".png")))
    listing = spark.range(50).select(F.explode(paths.when(i % 6 == 4, F.array(name("/r/z/img_", ".jpg"))).otherwise(F.array(name("/r/other_", ".png")))).alias("path"))
    k = F.concat(F.lit("img_"), (F.col("user_id") % 50).cast("string"))
    asked = F.when(F.col("event_id") % 3 == 0, F.concat(k, F.lit(".png"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("gone/"), k, F.lit(".png"))).otherwise(k)
    rows = fx.table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("pos"), asked.alias("image_path"))
    return prepare.resolve_images(rows, listing, "/r").select("event_id", "image_path")


@query("""WITH a AS (SELECT event_id, event_id % 700 AS i, event_id % 3 = 2 AS bare FROM events)
SELECT event_id, CASE WHEN vec_id IS NULL THEN NULL WHEN i % 2 = 1 THEN '/r/deep/' || i || '.png' WHEN bare THEN NULL ELSE '/o/' || i || '.png' END AS image_path FROM a LEFT JOIN embeddings ON vec_id = i""")
def images_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute paths, which may lie outside the root: even vectors' files are where they are looked for, those of odd ones only below
    the root, found by name; a third of the paths have no suffix, and the stem is only looked for below the root."""
    name = lambda c: F.concat(c.cast("string"), F.lit(".png"))
    listing = fx.table(spark, sf_dir, "embeddings").select(F.concat(F.when(F.col("vec_id") % 2 == 0, "file:/o/").otherwise("file:/r/deep/"), name(F.col("vec_id"))).alias("path"))
    i = F.col("event_id") % 700
    asked = F.concat(F.lit("/o/"), F.when(F.col("event_id") % 3 == 2, i.cast("string")).otherwise(name(i)))
    rows = fx.table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("pos"), asked.alias("image_path"))
    return prepare.resolve_images(rows, listing, "/r").select("event_id", "image_path")


def _u(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def _pick(values: list[str], *parts: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{_u(*parts)} % {len(values)} + 1]"


#: Fixed values, written once more for the SQL.
_MISMATCHES = ["question_replacement", "image_replacement", "cross_sample_mismatch"]
_DEGRADATIONS = ["gaussian_blur", "speckle_noise", "resolution_drop", "contrast_brightness_shift", "random_crop", "local_occlusion", "center_mask", "border_truncate"]
_SLOTS = ["low"] * 25 + ["medium"] * 50 + ["high"] * 25
_K = ("42", "sample_id", "variant_idx")
_FAN = f"""v0 AS (SELECT *, unnest(generate_series(0, 4)) AS variant_idx FROM ix), v1 AS (SELECT *, {_u(*_K, "'gate'")} / 4294967296.0 < 0.25 AS mm FROM v0),
v AS (SELECT sample_id, question, image_path, variant_idx, variant_idx > 0 AS is_counterfactual, CASE WHEN variant_idx = 0 THEN 'none' WHEN mm THEN {_pick(_MISMATCHES, *_K, "'mismatch'")} ELSE {_pick(_DEGRADATIONS, *_K, "'type'")} END AS degradation_type,
CASE WHEN variant_idx = 0 THEN 'none' WHEN mm THEN 'high' ELSE {_pick(_SLOTS, *_K, "'severity'")} END AS severity FROM v1)"""


def _fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.fan_out(index(spark, sf_dir), weights={"low": 0.25, "medium": 0.5, "high": 0.25})


@query(f"WITH {Q}, {_FAN} SELECT sample_id, CAST(variant_idx AS INT) AS variant_idx, is_counterfactual, degradation_type, severity FROM v")
def variants_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fan(spark, sf_dir).select("sample_id", "variant_idx", "is_counterfactual", "degradation_type", "severity")


@query(f"WITH {Q} SELECT sample_id, {_pick(["random_crop", "local_occlusion", "center_mask", "border_truncate", "question_replacement", "cross_sample_mismatch"], '42', 'sample_id', "'stress'")} AS degradation_type, 'high' AS severity FROM ix")
def variants_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.stress_variants(index(spark, sf_dir)).select("sample_id", "degradation_type", "severity")


_N = "(SELECT count(*) FROM r)"
_MIXED = f"""r AS (SELECT sample_id, question, image_path, row_number() OVER (ORDER BY md5(sample_id), sample_id) - 1 AS rank FROM ix),
o AS (SELECT v.*, r.rank, {_u(*_K, "'one'")} % ({_N} - 1) + 1 AS o, {_u(*_K, "'two'")} % ({_N} - 2) + 1 AS p0 FROM v JOIN r USING (sample_id)
  WHERE degradation_type IN ('question_replacement', 'image_replacement', 'cross_sample_mismatch')),
mx AS (SELECT o.sample_id, o.variant_idx, o.degradation_type, CASE WHEN o.degradation_type = 'image_replacement' THEN o.question ELSE a.question END AS question,
  CASE o.degradation_type WHEN 'image_replacement' THEN a.image_path WHEN 'cross_sample_mismatch' THEN b.image_path ELSE o.image_path END AS image_path, a.sample_id AS partner_id
  FROM o JOIN r a ON a.rank = (o.rank + o.o) % {_N} JOIN r b ON b.rank = (o.rank + CASE WHEN o.p0 >= o.o THEN o.p0 + 1 ELSE o.p0 END) % {_N})"""


@query(f"WITH {Q}, {_FAN}, {_MIXED} SELECT sample_id, CAST(variant_idx AS INT) AS variant_idx, degradation_type, question, image_path, partner_id FROM mx")
def variants_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatch joins: question, image or both from other samples."""
    rows = index(spark, sf_dir)
    return variants.mismatch(_fan(spark, sf_dir), rows).select("sample_id", "variant_idx", "degradation_type", "question", "image_path", "partner_id")


@query(f"WITH {Q}, {_FAN} SELECT sample_id || '__' || degradation_type || '_' || severity AS sample_id, sample_id || '_' || degradation_type || '_' || severity || '_' || variant_idx || '.png' AS file_name FROM v WHERE variant_idx > 0")
def variants_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.degraded_names(_fan(spark, sf_dir).where("variant_idx > 0")).select("sample_id", "file_name")


_O = fx.outputs_sql("o")
#: By rule, in order, its condition and message, for outputs that have all fields.
_RULES = [
    ("blank", "explanation is empty or no text"), ("raw_confidence > 1", "raw_confidence lies outside 0 to 1"), ("answer = ''", "answer is empty or no text"),
    ("decision = 'answer' AND abstain_type <> 'none'", "it answers, yet gives a reason to abstain"), ("decision = 'abstain' AND abstain_type = 'none'", "it abstains without a reason"),
    ("decision = 'answer' AND hint", "it answers on evidence that it calls insufficient"), ("decision = 'abstain' AND answer = 'Yes'", "it abstains, yet its answer is definite"),
]
_MESSAGES = f"""CASE form WHEN 'unparsed' THEN 'the JSON object does not end' WHEN 'missing' THEN 'fields missing: risk_level'
  ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{m}' END" for c, m in _RULES)}], lambda x: x IS NOT NULL), '; ') END"""
_OK = f"(form = 'full' AND {_MESSAGES} = '')"
_CONFLICT = "(form = 'full' AND (" + " OR ".join(f"({c})" for c, _ in _RULES[3:]) + "))"


def _parsed(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return outputs.parse_and_validate(fx.outputs(spark, sf_dir, shift), "raw_text")


@query(f"WITH {_O} SELECT doc_id, CASE WHEN form = 'unparsed' THEN 'unparsed' WHEN {_OK} THEN 'ok' ELSE 'invalid' END AS status, {_MESSAGES} AS errors, CASE WHEN form <> 'unparsed' THEN decision END AS decision, CASE WHEN form <> 'unparsed' THEN abstain_type END AS abstain_type, CASE WHEN form <> 'unparsed' THEN answer END AS answer, CASE WHEN form <> 'unparsed' THEN round(raw_confidence, 4)::DOUBLE END AS raw_confidence FROM o")
def outputs_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed outputs, and what is wrong with each, in the rules' order."""
    out = F.col("output")
    return _parsed(spark, sf_dir).select("doc_id", F.col("output_status").alias("status"), F.array_join("output_errors", "; ").alias("errors"), out.decision.alias("decision"), out.abstain_type.alias("abstain_type"), out.answer.alias("answer"), F.round(out.raw_confidence, 4).alias("raw_confidence"))


@query(f"WITH {_O} SELECT CASE WHEN {_OK} THEN 'kept' ELSE 'quarantined' END AS place, count(*) AS n FROM o GROUP BY 1")
def outputs_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).groupBy(outputs.place().alias("place")).agg(F.count("*").alias("n"))


@query(f"""WITH {_O} SELECT doc_id, CASE WHEN (doc_id % 4) < 3 AND {_OK} THEN doc_id % 4 + 1 ELSE 3 END::INT AS rounds, (doc_id % 4) < 3 AND {_OK} AS valid,
  CASE WHEN (doc_id % 4) < 3 AND {_OK} THEN decision END AS decision FROM o""")
def calls_with_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of up to four rounds, of which the first doc_id % 4 hold no JSON: the first valid output of three rounds."""
    rows = fx.outputs(spark, sf_dir).withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(4))))
    said = F.when(F.col("turn") > F.col("doc_id") % 4, F.col("raw_text")).otherwise("none")
    got = calls.first_valid(rows.withColumn("said", said), "doc_id", "said")
    return got.select("doc_id", "rounds", "valid", F.col("output.decision").alias("decision"))


@query(f"WITH {_O} SELECT round(avg({_OK}::INT), 9) AS json_validity, round(avg({_CONFLICT}::INT), 9) AS consistency_error FROM o")
def output_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON validity and consistency error."""
    rules = list(outputs.rule_errors("output").values())[outputs.CONFLICTS]
    conflict = F.coalesce(rules[0] | rules[1] | rules[2] | rules[3], F.lit(False)) & (F.size(F.coalesce("output.missing", F.array().cast("array<string>"))) == 0) & (F.col("output_status") != "unparsed")
    return _parsed(spark, sf_dir).agg(F.round(F.avg((F.col("output_status") == "ok").cast("int")), 9).alias("json_validity"), F.round(F.avg(conflict.cast("int")), 9).alias("consistency_error"))


_S = fx.outputs_sql("s", 1)
_KEPT = "o.form <> 'unparsed' AND s.form <> 'unparsed' AND s.decision = 'answer' AND (o.decision = 'abstain' OR (o.form <> 'missing' AND o.risk_level = 'high'))"


#: The teacher's output as text, as it is trained on.
_CHOSEN = """'{"explanation": "' || CASE WHEN o.hint THEN 'The view is INSUFFICIENT here.' WHEN o.blank THEN '' ELSE 'The finding is plain.' END || '", "raw_confidence": ' || CAST(CAST(o.raw_confidence AS DOUBLE) AS VARCHAR)
  || ', "decision": "' || o.decision || '", "abstain_type": "' || o.abstain_type || '"' || CASE WHEN o.form = 'missing' THEN '' ELSE ', "risk_level": "' || o.risk_level || '"' END || ', "answer": "' || o.answer || '"}'"""


@query(f"""WITH {_O}, {_S} SELECT 's' || o.doc_id AS sample_id, {_CHOSEN} AS chosen, o.decision AS chosen_decision, CASE WHEN o.form <> 'missing' THEN o.risk_level END AS chosen_risk, o.answer AS chosen_answer,
  s.decision AS student_decision, (o.doc_id + 1) % 4 AS shape FROM o JOIN s USING (doc_id) WHERE {_KEPT}""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of teacher and student outputs of the same variant, as records with JSON text; shape is that of the student's text."""
    key = [F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("sample_id"), F.lit(1).alias("variant_idx")]
    image = [F.lit("i.png").alias("image_path"), F.lit("q?").alias("question")]
    t = _parsed(spark, sf_dir).select(*key, *image, F.col("output").alias("teacher_output"))
    s = _parsed(spark, sf_dir, 1).select(*key, F.col("output").alias("student_output"), F.col("raw_text").alias("student_text"))
    got = pairs.mine_pairs(pairs.pair_outputs(t, s))
    part = lambda k: F.get_json_object("chosen", f"$.{k}")
    shape = F.when(F.col("rejected").startswith("```"), 1).when(F.col("rejected").startswith("Here: "), 2)
    shape = shape.otherwise((F.substring("sample_id", 2, 20).cast("long") + 1) % 4)
    return got.select("sample_id", "chosen", part("decision").alias("chosen_decision"), part("risk_level").alias("chosen_risk"), part("answer").alias("chosen_answer"), F.col("student_output.decision").alias("student_decision"), shape.cast("long").alias("shape"))


@query(f"""WITH {Q}, {_O}, a AS (SELECT ix.*, o.decision, o.answer AS said, o.form, ix.pos % 3 = 0 AS flag FROM ix JOIN o ON o.doc_id = ix.pos % 997 WHERE o.form <> 'unparsed')
SELECT sample_id, question, image_path, answer AS reference_answer, flag AS ground_truth_should_abstain, decision,
  CASE WHEN decision = 'abstain' THEN flag ELSE lower(trim(said)) = trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')) END AS is_correct FROM a""")
def prediction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of predictions: outputs as the predictions of index rows."""
    got = records.prediction_records(_predicted(spark, sf_dir), F.col("pos") % 3 == 0)
    return got.select("sample_id", "question", "image_path", "reference_answer", "ground_truth_should_abstain", F.col("prediction.decision").alias("decision"), "is_correct")


@query(f"WITH {Q}, {_O} SELECT ix.sample_id, ix.image_path, ix.question, o.decision, o.answer FROM ix JOIN o ON o.doc_id = ix.pos % 997 WHERE o.form <> 'unparsed'")
def inference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.inference_records(_predicted(spark, sf_dir)).select("sample_id", "image_path", "question", "prediction.decision", "prediction.answer")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir).where("output_status <> 'unparsed'").select(F.col("doc_id").alias("_d"), F.col("output").alias("prediction"))
    return index(spark, sf_dir).join(parsed, F.col("pos") % 997 == F.col("_d"))


def _flat(messages: Column) -> Column:
    """A line for each part of each message: role, kind, text or address."""
    part = lambda role: lambda p: F.concat_ws("|", role, p["type"], F.coalesce(p["text"], p["image_url"]["url"]))
    return F.array_join(F.flatten(F.transform(messages, lambda m: F.transform(m["content"], part(m["role"])))), "\n")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_URL = "'file:///data/' || image_path"
_SYSTEM = _quoted(f"system|text|{prompts.SYSTEM}\n")
_GUIDANCE = f"""CASE WHEN degradation_type IN ('question_replacement', 'image_replacement', 'cross_sample_mismatch') THEN {_quoted(prompts.GUIDANCE["mismatch"])}
  WHEN degradation_type IN ('random_crop', 'local_occlusion', 'center_mask', 'border_truncate') THEN {_quoted(prompts.GUIDANCE["region"])}
  WHEN is_counterfactual THEN {_quoted(prompts.GUIDANCE["degraded"])} ELSE {_quoted(prompts.GUIDANCE["normal"])} END"""
_CONTEXT = "CASE WHEN is_counterfactual THEN 'Counterfactual sample, type ' || degradation_type || ', severity ' || severity || '.' ELSE 'Original sample.' END"


@query(f"""WITH {Q}, {_FAN} SELECT sample_id, CAST(variant_idx AS INT) AS variant_idx, {_SYSTEM} || 'user|text|' || {_CONTEXT} || chr(10) || {_GUIDANCE} || chr(10)
  || {_quoted(f"Reply in this form: {prompts.SCHEMA}")} || chr(10) || 'Question: ' || question || chr(10) || 'user|image_url|' || {_URL} AS messages FROM v""")
def teacher_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teacher's messages, all parts of them, as text."""
    url = text.file_uri(F.concat(F.lit("/data/"), F.col("image_path")))
    m = prompts.teacher_messages(F.col("question"), url, F.col("is_counterfactual"), F.col("degradation_type"), F.col("severity"))
    return _fan(spark, sf_dir).select("sample_id", "variant_idx", _flat(m).alias("messages"))


@query(f"""WITH {Q} SELECT sample_id, {_SYSTEM} || 'user|image_url|' || {_URL} || chr(10) || 'user|text|Check the evidence before you reply.' || chr(10) || 'Question: ' || question AS asked,
  {_SYSTEM} || 'user|image_url|' || {_URL} || chr(10) || 'user|text|Question: ' || question || chr(10) || 'assistant|text|' || answer AS taught FROM ix""")
def student_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of inference and of training, as text."""
    url = text.file_uri(F.concat(F.lit("/data/"), F.col("image_path")))
    asked, taught = prompts.inference_messages(F.col("question"), url), prompts.training_messages(F.col("question"), url, F.col("answer"))
    return index(spark, sf_dir).select("sample_id", _flat(asked).alias("asked"), _flat(taught).alias("taught"))


@query(f"""WITH {Q}, t AS (SELECT sample_id, answer, {_quoted(prompts.SYSTEM)} || chr(10) || 'Check the evidence before you reply.' || chr(10) || 'Question: ' || question || chr(10) AS prompt FROM ix)
SELECT sample_id, prompt || answer AS text, CAST(length(prompt) AS INT) AS prompt_chars FROM t""")
def preference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("sample_id", prompts.preference_text(F.col("question"), F.col("answer")).alias("t")).select("sample_id", "t.text", "t.prompt_chars")


@query(f"""WITH {Q}, {_FAN} SELECT v.sample_id, ix.answer AS reference_answer, ix.split, is_counterfactual, degradation_type, severity, v.sample_id AS source_sample_id, 'out' AS teacher_output FROM v JOIN ix USING (sample_id)""")
def teacher_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = variants.teacher_records(_fan(spark, sf_dir), F.lit("out"))
    return got.drop("image_path", "question")


@query("""SELECT vec_id, array_to_string(list_transform(embedding, lambda v, i: CAST(CASE WHEN (i - 1) // 8 IN (3, 4) AND (i - 1) % 8 IN (3, 4) THEN 0 ELSE round(v::DOUBLE * 100000) END AS INT)), ',') AS pixels FROM embeddings""")
def center_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels, in hundred-thousandths, of 8 x 8 images under the centre mask."""
    masked = images.center_mask_array(F.col("embedding"), F.lit(8), images.strength("center_mask", "medium"))
    whole = F.transform(masked, lambda v: F.round(v * 100000).cast("int").cast("string"))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(whole, ",").alias("pixels"))


@query("""SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CAST(round((v::DOUBLE - ln(list_sum(list_transform(embedding, lambda w: exp(w::DOUBLE))))) * 100000) AS INT)), ',') AS logprobs FROM embeddings""")
def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components' log-probabilities, in hundred-thousandths."""
    whole = F.transform(arrays.log_softmax(F.col("embedding")), lambda v: F.round(v * 100000).cast("int").cast("string"))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(whole, ",").alias("logprobs"))


@query("""WITH x AS (SELECT vec_id, unnest(range(0, 16)) AS i, embedding AS e FROM embeddings), z AS (SELECT vec_id, i, 0.1 * ((e[4 * i + 1]::DOUBLE - e[4 * i + 2]::DOUBLE) - (e[4 * i + 3]::DOUBLE - e[4 * i + 4]::DOUBLE)) AS x FROM x)
SELECT vec_id, round(avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))), 7) AS loss FROM z GROUP BY vec_id""")
def preference_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean loss of the sixteen pairs that the components of a vector give."""
    return _losses(spark, sf_dir).groupBy("vec_id").agg(F.round(F.avg("loss"), 7).alias("loss"))


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    parts = [F.get("embedding", F.col("i") * 4 + k).cast("double") for k in range(4)]
    return e.select("vec_id", "i", arrays.preference_loss(*parts, 0.1).alias("loss"))


_PAIRS = """x AS (SELECT vec_id, unnest(range(0, 16)) AS i, embedding AS e FROM embeddings), z AS (SELECT vec_id * 16 + i + 1 AS n, 0.1 * ((e[4 * i + 1]::DOUBLE - e[4 * i + 2]::DOUBLE) - (e[4 * i + 3]::DOUBLE - e[4 * i + 4]::DOUBLE)) AS x FROM x),
s AS (SELECT CAST(ceil(n / 7.0) AS INT) AS step, count(*) AS n, sum(greatest(-x, 0) + ln(1 + exp(-abs(x)))) / 7 AS loss FROM z GROUP BY 1)"""


@query(f"WITH {_PAIRS} SELECT step, n, round(loss, 7) AS loss FROM s")
def preference_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each optimiser step of a pass adds to the running loss, seven pairs a step."""
    return pairs.loss_steps(_losses(spark, sf_dir).select((F.col("vec_id") * 16 + F.col("i") + 1).alias("n"), "loss"), 7).select("step", "n", F.round("loss", 7).alias("loss"))


@query(f"WITH {_PAIRS} SELECT count(*) AS steps, round(sum(loss), 5) AS loss FROM s")
def preference_running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = pairs.loss_steps(_losses(spark, sf_dir).select((F.col("vec_id") * 16 + F.col("i") + 1).alias("n"), "loss"), 7)
    return pairs.running_loss(steps).select("steps", F.round("loss", 5).alias("loss"))


@query("""WITH x AS (SELECT vec_id, embedding AS e, vec_id % 4 AS prompt, 8 - vec_id % 3 AS real FROM embeddings),
t AS (SELECT vec_id, prompt, real, e, unnest(range(1, 8)) AS t FROM x)
SELECT vec_id, round(sum(CASE WHEN t - 1 >= greatest(prompt - 1, 0) AND t < real THEN e[8 * (t - 1) + (vec_id + t) % 8 + 1]::DOUBLE - ln(list_sum(list_transform(e[8 * (t - 1) + 1 : 8 * t], lambda v: exp(v::DOUBLE)))) ELSE 0 END), 5) AS logprob FROM t GROUP BY vec_id""")
def completion_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed log-probabilities after a prompt: vectors as eight tokens' logits over eight words, the last tokens padding."""
    logits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, 8))
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: ((F.col("vec_id") + t) % 8).cast("int"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: (t < 8 - F.col("vec_id") % 3).cast("int"))
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", logits.alias("logits"), ids.alias("ids"), mask.alias("mask"))
    return rows.select("vec_id", F.round(arrays.completion_logprob(F.col("logits"), F.col("ids"), F.col("mask"), F.col("vec_id") % 4), 5).alias("logprob"))


@query("SELECT l_orderkey, string_agg(CASE WHEN l_linenumber > 2 AND l_linenumber <> 7 THEN l_linenumber ELSE -100 END::VARCHAR, ',' ORDER BY l_linenumber) AS labels, CAST(count_if(l_linenumber <> 7) AS INT) AS length FROM lineitem GROUP BY l_orderkey")
def label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label masks of token arrays (here: line numbers), prompts of two tokens, 7 as the pad, and the tokens that are no pad."""
    rows = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    labels = arrays.label_mask(F.col("ids"), F.size(F.filter("ids", lambda v: v <= 2)), F.lit(7))
    length = arrays.prompt_length(F.transform("ids", lambda v: (v != 7).cast("int")))
    return rows.select("l_orderkey", F.array_join(F.transform(labels, lambda v: v.cast("string")), ",").alias("labels"), length.alias("length"))


@query()
def image_degradations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight image operators on 8 x 8 images from vectors: the pixels' mean and the bytes in hex (tested against plain loops)."""
    e = fx.table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    grey = F.transform("embedding", lambda v: F.lpad(F.hex(F.least(F.greatest(F.round((v + 1) * 127), F.lit(0)), F.lit(255)).cast("int")), 2, "0"))
    data = F.unhex(F.array_join(F.transform(grey, lambda x: F.repeat(x, F.lit(3))), ""))
    rows = e.select("vec_id", data.alias("data"), F.explode(F.array(*[F.lit(x) for x in variants.DEGRADATIONS])).alias("degradation_type"))
    out = images.degrade_column(F.col("data"), F.lit(8), F.lit(8), F.col("degradation_type"), F.lit("medium"), F.col("vec_id").cast("string"))
    return rows.select("vec_id", "degradation_type", F.hex(out).alias("pixels"))


_PICTURES = """f AS (SELECT '/data/img_' || vec_id || '.png' AS path, 'data:image/png;base64,' || base64(unhex('89504E470D0A1A0A') || encode(repeat('vector ' || vec_id || ' label ' || coalesce(label, 0) || ';', 20))) AS address FROM embeddings),
ask AS (SELECT sample_id, question, '/data/img_' || pos % 2503 || '.png' AS image_path FROM ix)"""


@query(f"""WITH {Q}, {_PICTURES} SELECT ask.sample_id, {_SYSTEM} || concat_ws('|', 'user', 'image_url', f.address) || chr(10) || 'user|text|Check the evidence before you reply.' || chr(10) || 'Question: ' || question AS messages,
  CASE WHEN f.path IS NULL THEN image_path ELSE '' END AS missing FROM ask LEFT JOIN f ON f.path = ask.image_path""")
def requests_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests about pictures (files made of vectors' ids and labels), the pictures' bytes in them, and what picture is not there."""
    said = F.repeat(F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" label "), F.coalesce("label", F.lit(0)).cast("string"), F.lit(";")), F.lit(20))
    name = lambda c: F.concat(F.lit("/data/img_"), c.cast("string"), F.lit(".png"))
    files = fx.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("file:"), name(F.col("vec_id"))).alias("path"), F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode(said, "UTF-8")).alias("content"))
    url = text.file_uri(name(F.col("pos") % 2503))
    rows = index(spark, sf_dir).select("sample_id", prompts.inference_messages(F.col("question"), url).alias("messages"))
    got = attach_images(rows, files)
    return got.select("sample_id", _flat(F.col("messages")).alias("messages"), F.array_join("missing_images", ",").alias("missing"))


_ASKED = f"""asked AS (SELECT v.sample_id, CAST(v.variant_idx AS INT) AS variant_idx, ix.pos, sha256(concat_ws('|', 'teacher', '0.2', '800', {_CONTEXT} || chr(10) || v.question)) AS request_key FROM v JOIN ix USING (sample_id)),
known AS (SELECT request_key, min('quality ' || quality) AS response_text FROM asked JOIN labels ON doc_id = pos % 997 WHERE variant_idx = 0 AND quality IS NOT NULL GROUP BY request_key)"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests of all variants, and answers to some, recorded for originals."""
    said = F.concat_ws("\n", prompts.sample_context(F.col("is_counterfactual"), F.col("degradation_type"), F.col("severity")), F.col("question"))
    rows = calls.keyed(_fan(spark, sf_dir).withColumn("messages_json", said), Policy(), "teacher")
    told = fx.table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("_d"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("said"))
    known = rows.where("variant_idx = 0").join(told, F.col("pos") % 997 == F.col("_d")).groupBy("request_key").agg(F.min("said").alias("response_text"), F.lit(1).alias("attempts"))
    return rows, known


@query(f"WITH {Q}, {_FAN}, {_ASKED} SELECT request_key FROM asked WHERE request_key NOT IN (SELECT request_key FROM known) GROUP BY request_key")
def calls_to_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be posted: each different request without a recorded answer, once."""
    rows, known = _asked(spark, sf_dir)
    return calls.to_ask(rows, known).select("request_key")


@query(f"WITH {Q}, {_FAN}, {_ASKED} SELECT sample_id, variant_idx, request_key, response_text FROM asked LEFT JOIN known USING (request_key)")
def calls_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests with their recorded answers."""
    rows, known = _asked(spark, sf_dir)
    return calls.answered(rows, known).select("sample_id", "variant_idx", "request_key", "response_text")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _joined(c: str) -> Column:
    """Lists of numbers as text: numbers by commas, lists by semicolons."""
    return F.array_join(F.transform(c, lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), ",")), ";")


@query()
def sft_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training batches of all question and answer rows: token ids, masks and labels (tested against a plain loop over the tokenizer)."""
    url = text.file_uri(F.concat(F.lit("/data/"), F.col("image_path")))
    rows = index(spark, sf_dir).select(F.concat_ws("_", "sample_id", "pos").alias("key"), prompts.training_messages(F.col("question"), url, F.col("answer")).alias("messages"))
    got = batches.length_batches(batches.sft_tokens(rows, _tokenizer()), "key", 8, 50256)
    lengths = F.array_join(F.transform("prompt_lengths", lambda v: v.cast("string")), ",")
    return got.select("bucket", "shard", "batch", F.array_join("keys", ",").alias("keys"), _joined("input_ids").alias("input_ids"), _joined("attention_mask").alias("attention_mask"), _joined("labels").alias("labels"), lengths.alias("prompt_lengths"))


@query()
def preference_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of inference prompts with their completions, and the prompts' lengths in tokens (tested against a plain loop)."""
    url = text.file_uri(F.concat(F.lit("/data/"), F.col("image_path")))
    prompt = prompts.chat_text(prompts.inference_messages(F.col("question"), url), reply=True)
    got = batches.preference_tokens(index(spark, sf_dir).select("sample_id", "answer", prompt.alias("prompt")), _tokenizer(), F.col("prompt"), F.col("answer"))
    return got.select("sample_id", F.array_join(F.transform("input_ids", lambda v: v.cast("string")), ",").alias("input_ids"), "prompt_tokens")
