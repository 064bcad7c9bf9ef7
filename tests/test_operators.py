import math

import numpy as np
import pytest

from mirador.operators import images, metrics, outputs, variants
from mirador.sources.model import Policy, call_model, complete, content_of


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('so {"a": {"b": 2}} end', '{"a": {"b": 2}}'), ('{"a": "}"}', '{"a": "}')],
)
def test_json_object_text(text, want):
    assert outputs.json_object_text(text) == want


@pytest.mark.parametrize(("text", "error"), [("none", outputs.NO_OBJECT), ('{"a": 1', outputs.UNTERMINATED)])
def test_json_errors(text, error):
    with pytest.raises(ValueError, match=error):
        outputs.json_object_text(text)


def test_validation(spark):
    good = '{"explanation": "Plain.", "raw_confidence": 0.5, "decision": "Answer", "abstain_type": "none", "risk_level": "low", "answer": "lesion"}'
    texts = [good, good.replace('"none"', "null"), good.replace("0.5", "1.5"), good.replace("0.5", "NaN"), good.replace("lesion", " "), good.replace("Answer", "abstain"), '{"answer": "x"}', "nothing", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r["i"]: r for r in outputs.parse_and_validate(df, "t").collect()}
    assert [out[i]["output_status"] for i in range(9)] == ["ok", "ok", "invalid", "ok", "invalid", "invalid", "invalid", "unparsed", "unparsed"]
    assert out[2]["output_errors"] == ["raw_confidence lies outside 0 to 1"]
    assert out[6]["output_errors"][0].startswith("fields missing: ")


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "decision string, ground_truth_should_abstain boolean, is_correct boolean, raw_confidence double")
    assert set(metrics.all_metrics(df).first()) == {0.0}


def test_ece_edges(spark):
    rows = [("answer", False, True, c) for c in (0.0, 0.3, 0.7, 0.9, 1.0, math.nan, 1.2)] + [("answer", False, True, None)]
    df = spark.createDataFrame(rows, "decision string, ground_truth_should_abstain boolean, is_correct boolean, raw_confidence double")
    bins = {r["bin"]: r["n"] for r in metrics.calibration_bins(df).collect()}
    assert bins == {0: 1, 3: 1, 6: 1, 8: 1, 9: 1, None: 2}


def test_isotonic(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.uniform(0, 1, 300), 2)
    y = rng.uniform(0, 1, 300) < x
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y, strict=True)], "raw_confidence double, is_correct boolean")
    model = metrics.fit_calibration(df)
    got = sorted((r[0], r[2]) for r in metrics.apply_calibration(df, model).collect())
    blocks = [[float(y[x == v].mean()), int((x == v).sum()), 1] for v in np.unique(x)]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            (m, n, k), (m2, n2, k2) = out.pop(-2), out.pop()
            out.append([(m * n + m2 * n2) / (n + n2), n + n2, k + k2])
    want = dict(zip(np.unique(x), [m for m, _, k in out for _ in range(k)], strict=True))
    assert all(abs(want[a] - b) < 1e-6 for a, b in got)


@pytest.mark.parametrize("kind", variants.DEGRADATIONS)
@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (9, 14)])
def test_images(kind, shape):
    image = np.random.default_rng(0).integers(0, 256, (*shape, 3)).astype(np.uint8)
    out = images.degrade(image, kind, "odd", np.random.default_rng(1))
    assert out.shape == image.shape and out.dtype == np.uint8


def test_center_mask_and_unknown():
    out = images.degrade(np.full((8, 8, 3), 9, np.uint8), "center_mask", "medium", np.random.default_rng(0))
    assert (out[3:5, 3:5] == 0).all() and (out == 0).sum() == 12
    with pytest.raises(ValueError, match="unknown"):
        images.degrade(out, "swirl", "low", np.random.default_rng(0))


def test_severity_slots():
    assert variants.severity_slots(None) == ["low", "medium", "high"]
    assert variants.severity_slots({"low": 0, "high": 0.29}).count("low") == 1


def test_retry():
    waits, answers = [], iter([{"choices": []}, {"choices": [{"message": {"content": ""}}]}, {"choices": [{"message": {"content": [{"text": "a"}, {"text": ""}, {"text": "b"}]}}]}])
    assert complete(lambda m, p: next(answers), "[]", Policy(), waits.append) == ("a\nb", 3, None)
    assert waits == [2.0, 4.0]
    assert complete(lambda m, p: {}, "[]", Policy(), lambda s: None)[0] is None
    with pytest.raises(ValueError):
        content_of({})


def test_call_model(spark):
    df = spark.createDataFrame([(1, "[]")], "i int, messages_json string")
    make = lambda: lambda m, p: {"choices": [{"message": {"content": "ok"}}]}
    assert call_model(df, make).first()["response_text"] == "ok"


def test_stream(spark, tmp_path):
    from mirador.streaming.outputs import validate_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"sample_id": "1", "raw_text": "none"}\n')
    validate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["output_status"] == "unparsed"
