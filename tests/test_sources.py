"""Sources, sinks, numbering, records, calls and pixels, against plain Python."""

import http.server
import json
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirador.functions import arrays, rows
from mirador.operators import images, metrics, outputs, pairs, prepare, records, variants
from mirador.sources import io, model

GOOD = '{"explanation": "Plain.", "raw_confidence": 0.5, "decision": "answer", "abstain_type": "none", "risk_level": "low", "answer": "lesion"}'


def test_paths_in_their_order(spark, tmp_path):
    (tmp_path / "VQA_RAD Image Folder").mkdir()
    (tmp_path / "dataset.jsonl").write_text('{"question": "q"}\n')
    assert io.resolve_paths(spark, str(tmp_path)) == (f"{tmp_path}/dataset.jsonl", f"{tmp_path}/VQA_RAD Image Folder")
    (tmp_path / "VQA_RAD Dataset Public.json").write_text("[]")
    (tmp_path / "images").mkdir()
    assert io.resolve_paths(spark, str(tmp_path)) == (f"{tmp_path}/VQA_RAD Dataset Public.json", f"{tmp_path}/images")
    assert io.resolve_paths(spark, None, "a", "b") == ("a", "b")
    with pytest.raises(FileNotFoundError):
        io.resolve_paths(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("text", ['[{"q": "a"}, {"q": "b"}]', '{"data": [{"q": "a"}, {"q": "b"}], "records": []}', '\n {"records": [{"q": "a"}, {"q": "b"}]}'])
def test_json_payloads(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert [(r.pos, r.q) for r in io.read_json(spark, str(tmp_path / "x.json")).orderBy("pos").collect()] == [(0, "a"), (1, "b")]


@pytest.mark.parametrize("text", ['{"question": "a"}', '{"data": {"q": 1}}', "3", ""])
def test_other_payloads_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError, match="neither"):
        io.read_json(spark, str(tmp_path / "x.json"))


def test_written_files_read_back(spark, tmp_path):
    df = spark.createDataFrame([("é", None), ("b", 2)], "a string, b int")
    io.write_jsonl(df, str(tmp_path / "l"))
    assert {tuple(r) for r in io.read_jsonl(spark, str(tmp_path / "l"), "a string, b int").collect()} == {("é", None), ("b", 2)}
    io.append_errors(df, str(tmp_path / "e"))
    io.append_errors(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 4
    io.write_json(spark, {"ä": [1]}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"ä": [1]}
    built = []
    build = lambda: built.append(1) or df
    assert io.cached(spark, str(tmp_path / "c"), build).count() == io.cached(spark, str(tmp_path / "c"), build).count() == 2 and len(built) == 1
    assert io.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "c"), "z") == str(tmp_path / "c") and io.first_existing(spark, "/no", "z") == "z"
    (tmp_path / "c.yaml").write_text("seed: 42\n")
    assert io.read_config(str(tmp_path / "c.yaml")) == {"seed": 42}
    io.split_writer(df.withColumn("split", F.lit("val")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).select("split", "part").distinct().collect() == [("val", "val")]


def test_rows_are_numbered_in_their_order(spark):
    df = spark.range(0, 1000, numPartitions=7)
    assert all(r.id == r.n for r in rows.number_rows(df, "n").collect())
    assert rows.number_rows(df.limit(0), "n").count() == 0


@pytest.mark.parametrize("n", [0, 1, 13, 400, 401])
def test_smallest(spark, n):
    df = spark.range(400).select("id", F.md5((F.col("id") % 100).cast("string")).alias("h"))
    got = {r.id for r in df.where(rows.smallest(df, F.col("h"), F.col("id"), n)).collect()}
    assert got == {r.id for r in df.orderBy("h", "id").limit(n).collect()}


def test_hold_out_size(spark):
    df = spark.range(205).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("sample_id"))
    held = lambda d, r: prepare.hold_out(d, r).where("held_out").count()
    assert held(df, 0.1) == math.ceil(20.5) and held(df, 0.0) == 0 and held(df.limit(20), 0.5) == 0 and held(df.limit(21), 0.5) == 11


def test_interpolation_of_nothing(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (0.0,), (0.25,), (9.0,)], "x double")
    lit = lambda v: F.array(*[F.lit(x) for x in v])
    got = [r[0] for r in df.select(arrays.interpolate(F.col("x"), lit([0.1, 0.4]), lit([0.2, 0.8]))).collect()]
    assert got[0] is None and math.isnan(got[1]) and np.allclose(got[2:], [0.2, 0.5, 0.8])


def test_harmonic(spark):
    sums = np.cumsum([0.0, *(1 / i for i in range(1, 5001))])
    got = np.array([r[0] for r in spark.range(5001).select(metrics.harmonic(F.col("id"))).collect()])
    assert np.abs(got - sums).max() < 1e-12


def test_images_read_as_rgb_and_written(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.png(image.tobytes(), 5, 7))
    (tmp_path / "b.txt").write_text("no image")
    got = io.read_images(spark, str(tmp_path)).collect()
    assert len(got) == 1 and (got[0].height, got[0].width) == (5, 7) and bytes(got[0].data) == image.tobytes()
    assert images.turned(bytes([7, 9]), 1) == bytes([7, 7, 7, 9, 9, 9]) and images.turned(bytes([1, 2, 3, 4]), 4) == bytes([3, 2, 1])


def test_augmented_variants(spark, tmp_path):
    image = np.random.default_rng(4).integers(0, 256, (16, 16, 3)).astype(np.uint8)
    index = spark.createDataFrame([(f"s{i}", f"i{i}.png", f"q{i}", "a", "train") for i in range(6)], "sample_id string, image_path string, question string, answer string, split string")
    known = spark.createDataFrame([(f"i{i}.png", 16, 16, bytearray(image.tobytes())) for i in range(5)], "image_path string, height int, width int, data binary")
    made = variants.fan_out(index, per_sample=6, seed=1)
    out = variants.augmented(made, index, known, "file://" + str(tmp_path / "out"), seed=1).toPandas()
    assert len(out) == 42 and set(out.columns) == set(made.columns)
    degraded = out[out.degradation_type.isin(variants.DEGRADATIONS)]
    assert (degraded.image_path.isna() == (degraded.source_sample_id == "s5")).all()
    row = degraded[(degraded.degradation_type == "center_mask") & degraded.image_path.notna()].iloc[0]
    assert row.sample_id == f"{row.source_sample_id}__center_mask_{row.severity}"
    read = {r.origin.rsplit("/", 1)[-1]: bytes(r.data) for r in io.read_images(spark, str(tmp_path / "out")).collect()}
    assert read[row.image_path.rsplit("/", 1)[-1]] == images.degrade(image, "center_mask", row.severity, np.random.default_rng(0)).tobytes()
    swapped = out[out.degradation_type.isin(variants.MISMATCHES)]
    assert len(swapped) and (swapped.severity == "high").all()


def test_null_pixels(spark):
    df = spark.createDataFrame([(None, 2, 2), (bytearray(5), 2, 2), (bytearray(12), 2, 2)], "d binary, h int, w int")
    got = [r[0] for r in df.select(images.degrade_column(F.col("d"), F.col("h"), F.col("w"), F.lit("center_mask"), F.lit("high"), F.lit("k"))).collect()]
    assert got[0] is None and got[1] is None and len(got[2]) == 12


def plain_blur(a, radius):
    half = int(3 * radius + 0.5)
    k = [math.exp(-(x * x) / (2 * radius * radius)) for x in range(-half, half + 1)]
    out = a.astype(float)
    for axis in (0, 1):
        new = np.zeros_like(out)
        for i in range(a.shape[0]):
            for j in range(a.shape[1]):
                for x, w in zip(range(-half, half + 1), k, strict=True):
                    y = min(max((i if axis == 0 else j) + x, 0), a.shape[axis] - 1)
                    new[i, j] += w / sum(k) * (out[y, j] if axis == 0 else out[i, y])
        out = new
    return out


def plain_boxes(a, radius):
    """Three times a box whose ends count in part, its variance a third of radius ** 2, pixel by pixel."""
    variance = radius * radius / 3
    half = 0
    while (half + 1) * (half + 2) / 3 <= variance:
        half += 1
    share = (2 * half + 1) * (variance - half * (half + 1) / 3) / (2 * ((half + 1) ** 2 - variance))
    kernel = [share] + [1.0] * (2 * half + 1) + [share]
    once = [k / sum(kernel) for k in kernel]
    thrice = [1.0]
    for _ in range(3):
        thrice = [sum(thrice[j] * once[i - j] for j in range(len(thrice)) if 0 <= i - j < len(once)) for i in range(len(thrice) + len(once) - 1)]
    out, reach = a.astype(float), len(thrice) // 2
    for axis in (0, 1):
        new = np.zeros_like(out)
        for i in range(a.shape[0]):
            for j in range(a.shape[1]):
                for x, w in enumerate(thrice):
                    y = min(max((i if axis == 0 else j) + x - reach, 0), a.shape[axis] - 1)
                    new[i, j] += w * (out[y, j] if axis == 0 else out[i, y])
        out = new
    return np.rint(out)


def plain_resize(a, h, w, cubic):
    def kernel(x):
        x = abs(x)
        if not cubic:
            return max(1 - x, 0)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0

    def line(v, m):
        scale, out = len(v) / m, []
        for i in range(m):
            ws = [kernel((j + 0.5 - (i + 0.5) * scale) / max(scale, 1)) for j in range(len(v))]
            out.append(sum(x * y for x, y in zip(ws, v, strict=True)) / sum(ws))
        return out

    tall = np.array([line(list(a[:, j].astype(float)), h) for j in range(a.shape[1])]).transpose(1, 0, 2)
    wide = np.array([line(list(tall[i]), w) for i in range(h)])
    return np.clip(np.rint(wide), 0, 255)


@pytest.mark.parametrize("severity", ["low", "medium", "high"])
def test_pixels_against_plain_loops(severity):
    a = np.random.default_rng(8).integers(0, 256, (9, 11, 3)).astype(np.uint8)
    at = {"low": 0, "medium": 1, "high": 2}[severity]
    go = lambda kind: images.degrade(a, kind, severity, np.random.default_rng(5)).astype(int)
    draw = lambda: np.random.default_rng(5)
    assert np.abs(go("gaussian_blur") - plain_blur(a, (1.2, 2.4, 4.0)[at])).max() <= images.BLUR_TOLERANCE * 255
    assert np.abs(go("gaussian_blur") - plain_boxes(a, (1.2, 2.4, 4.0)[at])).max() <= 1
    s = (0.8, 0.55, 0.35)[at]
    small = plain_resize(a, max(1, int(9 * s)), max(1, int(11 * s)), False)
    assert np.abs(go("resolution_drop") - plain_resize(small, 9, 11, True)).max() <= 1
    s = (0.05, 0.12, 0.2)[at]
    x = a / 255
    assert (go("speckle_noise") == (np.clip(x + x * draw().normal(0, s, a.shape), 0, 1) * 255).astype(int)).all()
    s, r = (0.12, 0.22, 0.34)[at], draw()
    c, b = r.uniform(1 - s, 1 + s), r.uniform(1 - s, 1 + s)
    grey = round(float(np.mean([0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2] for p in a.reshape(-1, 3).astype(float)])))
    want = [[int(min(255, max(0, int(min(255, max(0, grey + (float(v) - grey) * c))) * b))) for v in p] for p in a.reshape(-1, 3)]
    assert np.abs(go("contrast_brightness_shift").reshape(-1, 3) - np.array(want)).max() <= 1
    s, r = (0.12, 0.22, 0.35)[at], draw()
    h, w = max(1, int(9 * s)), max(1, int(11 * s))
    top, left = int(r.integers(0, 9 - h + 1)), int(r.integers(0, 11 - w + 1))
    want = a.astype(int)
    for i in range(top, top + h):
        for j in range(left, left + w):
            want[i, j] = 0
    assert (go("local_occlusion") == want).all()
    s, r = (0.92, 0.8, 0.65)[at], draw()
    h, w = max(1, int(9 * s)), max(1, int(11 * s))
    top, left = int(r.integers(0, 9 - h + 1)), int(r.integers(0, 11 - w + 1))
    assert np.abs(go("random_crop") - plain_resize(a[top : top + h, left : left + w], 9, 11, True)).max() <= 1
    s = (0.18, 0.3, 0.42)[at]
    h, w, want = int(9 * s), int(11 * s), a.astype(int)
    for i in range((9 - h) // 2, (9 - h) // 2 + h):
        for j in range((11 - w) // 2, (11 - w) // 2 + w):
            want[i, j] = 0
    assert (go("center_mask") == want).all()
    s = (0.08, 0.15, 0.22)[at]
    cut = a[int(9 * s) :, int(11 * s) :]
    scale = min(9 / cut.shape[0], 11 / cut.shape[1])
    h, w = min(9, round(cut.shape[0] * scale)), min(11, round(cut.shape[1] * scale))
    want = np.zeros((9, 11, 3))
    want[(9 - h) // 2 : (9 - h) // 2 + h, (11 - w) // 2 : (11 - w) // 2 + w] = plain_resize(cut, h, w, True)
    assert np.abs(go("border_truncate") - want).max() <= 1


def test_records_and_inputs(spark, tmp_path):
    df = spark.createDataFrame([("s", "q", "i", None), ("t", "q", "i", " YES ")], "sample_id string, question string, image_path string, answer string")
    said = outputs.parse_and_validate(df.withColumn("t", F.lit(GOOD.replace("lesion", "yes"))), "t", "prediction")
    got = {r.sample_id: r for r in records.prediction_records(said, F.lit(None)).collect()}
    assert got["s"].reference_answer == "" and got["s"].is_correct is False and got["t"].is_correct is True and got["t"].ground_truth_should_abstain is False
    (tmp_path / "x.jsonl").write_text('{"image_path": "i", "question": "q"}\n')
    assert tuple(records.inference_items(spark, str(tmp_path / "x.jsonl")).first()) == (None, "i", "q")
    assert tuple(records.inference_items(spark, None, "i", "q").first()) == (None, "i", "q")
    with pytest.raises(ValueError, match="image and a question"):
        records.inference_items(spark, None, "i", None)


def test_rules_are_the_same_in_rows_and_columns(spark):
    texts = [GOOD, GOOD.replace("0.5", "1.5"), GOOD.replace("lesion", " "), GOOD.replace('"answer", "abs', '"abstain", "abs'), GOOD.replace('"none"', '"x"'), "no", '{"answer": 1}', GOOD.replace("Plain.", "Not clear"), GOOD.replace('"low"', "3")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in outputs.parse_and_validate(df, "t").collect():
        assert outputs.problems(texts[r.i])[1] == list(r.output_errors)
    good, rest = outputs.quarantine(outputs.parse_and_validate(df, "t"))
    assert good.count() == 1 and rest.count() == len(texts) - 1


def test_rounds_until_valid():
    said, waits = iter(["nothing", GOOD.replace("0.5", "7"), GOOD]), []
    backend = lambda m, p: {"choices": [{"message": {"content": next(said)}}]}
    got, rounds, error = model.complete_output(backend, "[]", model.Policy(), waits.append)
    assert got["answer"] == "lesion" and rounds == 3 and error is None and waits == [2.0, 4.0]
    got, rounds, error = model.complete_output(lambda m, p: {"choices": [{"message": {"content": "none"}}]}, "[]", model.Policy(), lambda s: None)
    assert got is None and rounds == 3 and error == outputs.NO_OBJECT


def test_http_backend(spark, monkeypatch):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"choices": [{"message": {"content": GOOD}}]}).encode()
            self.send_response(200 if len(asked) > 1 else 500)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    make = model.http_backend(f"http://127.0.0.1:{server.server_port}/v1", "m", "MIRADOR_TEST_KEY")
    with pytest.raises(RuntimeError, match="MIRADOR_TEST_KEY"):
        make()
    monkeypatch.setenv("MIRADOR_TEST_KEY", "k")
    got, rounds, _ = model.complete_output(make(), '[{"role": "user", "content": "q"}]', model.Policy(backoff=0.0))
    server.shutdown()
    assert got["decision"] == "answer" and rounds == 1 and len(asked) == 2 and asked[0][0] == "Bearer k"
    assert asked[1][1] == {"model": "m", "messages": [{"role": "user", "content": "q"}], "temperature": 0.2, "max_tokens": 800, "response_format": {"type": "text"}}


def test_loss_steps(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 18)], "n long, loss double")
    got = {r.step: (r.n, r.loss) for r in pairs.loss_steps(df, 8).collect()}
    assert got == {1: (8, sum(range(1, 9)) / 8), 2: (8, sum(range(9, 17)) / 8), 3: (1, 17 / 8)}
    assert pairs.running_loss(pairs.loss_steps(df.limit(0), 8)).first().loss == 0.0


def test_config_of_metrics_by_group(spark):
    df = spark.createDataFrame([("a", "answer", False, True, 0.9), ("a", "abstain", True, True, 0.2), ("b", None, None, None, None)], "g string, decision string, ground_truth_should_abstain boolean, is_correct boolean, raw_confidence double")
    got = {r.g: r for r in metrics.all_metrics(df, "g").collect()}
    assert got["a"]["Accuracy@Answer"] == 1.0 and got["a"]["Coverage"] == 0.5 and got["b"]["Coverage"] == 0.0 and got["b"]["ECE"] == 0.0


def test_command_line(spark, tmp_path, capsys):
    from mirador.__main__ import main

    (tmp_path / "images").mkdir()
    for i in range(30):
        (tmp_path / f"images/i{i}.png").write_bytes(images.png(bytes([i] * 12), 2, 2))
    (tmp_path / "dataset.json").write_text(json.dumps([{"question": f"q{i}", "answer": "yes", "image": f"i{i}.png"} for i in range(30)]))
    assert main(["prepare", "--dataset-root", str(tmp_path), "--output", str(tmp_path / "index")], spark) == {"test": 6, "val": 2, "train": 22}
    (tmp_path / "c.yaml").write_text("augmentation: {per_sample_variants: 2, severity_weights: {low: 1.0}}\n")
    assert main(["variants", "--config", str(tmp_path / "c.yaml"), "--input-jsonl", str(tmp_path / "index/part=train"), "--output", str(tmp_path / "v")], spark) == {"variants": 66}
    said = [{"sample_id": str(i), "prediction": {"decision": "answer", "raw_confidence": i / 10}, "is_correct": i > 4, "ground_truth_should_abstain": False} for i in range(10)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, said)))
    report = main(["calibrate", "--input-jsonl", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "cal.json")], spark)
    assert report["num_samples"] == 10 and json.loads((tmp_path / "cal.json").read_text())["method"] == "isotonic_regression"
    found = main(["evaluate", "--input-jsonl", str(tmp_path / "p.jsonl"), "--apply-calibration", str(tmp_path / "cal.json"), "--output", str(tmp_path / "m.json")], spark)
    assert found["Accuracy@Answer"] == 0.5 and found["ECE"] < 1e-6 and json.loads((tmp_path / "m.json").read_text()) == found
    (tmp_path / "o.jsonl").write_text(json.dumps({"raw_text": GOOD}) + "\n" + json.dumps({"raw_text": "no"}))
    assert main(["validate", "--input-jsonl", str(tmp_path / "o.jsonl"), "--output", str(tmp_path / "w")], spark) == {"ok": 1, "unparsed": 1}
    assert '"unparsed": 1' in capsys.readouterr().out
