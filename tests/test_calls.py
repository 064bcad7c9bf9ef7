"""Requests with images, calls made once, the log of attempts, and training batches."""

import base64
import hashlib
import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from mirador.functions import arrays
from mirador.operators import batches, outputs, pairs, prepare, prompts
from mirador.plans import queries as q
from mirador.sources import calls, io, model, requests

GOOD = '{"explanation": "Plain.", "raw_confidence": 0.5, "decision": "answer", "abstain_type": "none", "risk_level": "low", "answer": "lesion"}'
PNG = bytes.fromhex("89504E470D0A1A0A") + bytes(range(256)) * 3


class Service:
    """A chat service: what was posted, and answers as `say` gives them (an error where it gives none)."""

    def __init__(self, say=lambda body, n: GOOD):
        self.posted, service = [], self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                service.posted.append(body)
                said = say(body, len(service.posted))
                self.send_response(200 if said is not None else 500)
                self.end_headers()
                self.wfile.write(json.dumps({"choices": [{"message": {"content": said}}]}).encode())

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.make = model.http_backend(f"http://127.0.0.1:{self.server.server_port}/v1", "m")

    def texts(self):
        return sorted(b["messages"][0]["content"] for b in self.posted)


@pytest.fixture
def service():
    made = []

    def start(*args):
        made.append(Service(*args))
        return made[-1]

    yield start
    for s in made:
        s.server.shutdown()


def asking(spark, texts):
    return spark.createDataFrame([(i, json.dumps([{"role": "user", "content": t}])) for i, t in enumerate(texts)], "i int, messages_json string")


def test_images_travel_as_bytes(spark, tmp_path, service):
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics/a b+ü.png").write_bytes(PNG)
    (tmp_path / "pics/c.jpg").write_bytes(b"\xff\xd8\xff\xe0" + b"x" * 5000)
    names = [f"{tmp_path}/pics/a b+ü.png", f"{tmp_path}/pics/c.jpg", f"{tmp_path}/pics/gone.png"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([*names, names[0]])], "i int, p string").select("i", prompts.teacher_messages(F.lit("q"), q.text.file_uri(F.col("p")), F.lit(False), F.lit("none"), F.lit("none")).alias("messages"))
    got = requests.attach_images(rows, requests.image_files(spark, str(tmp_path / "pics")))
    found = {r.i: r for r in got.collect()}
    assert [found[i].missing_images for i in range(4)] == [[], [], [names[2]], []]
    s = service()
    ready = got.where(F.size("missing_images") == 0).select("i", F.to_json("messages").alias("messages_json"))
    out = calls.ask(ready, str(tmp_path / "store"), s.make, model.Policy(backoff=0.0), "m").collect()
    assert len(out) == 3 and all(r.response_text == GOOD for r in out)
    assert len(s.posted) == 2  # equal requests are posted once
    sent = sorted(p["image_url"]["url"] for b in s.posted for m in b["messages"] for p in m["content"] if p["type"] == "image_url")
    assert sent == sorted(["data:image/png;base64," + base64.b64encode(PNG).decode(), "data:image/jpeg;base64," + base64.b64encode(b"\xff\xd8\xff\xe0" + b"x" * 5000).decode()])
    assert "file:" not in json.dumps(s.posted)


def test_local_addresses_are_not_sent(spark, tmp_path, service):
    s = service()
    text = json.dumps([{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "file:///a.png"}}]}])
    df = spark.createDataFrame([(text,)], "messages_json string")
    out = calls.ask(df, str(tmp_path / "store"), s.make, model.Policy(backoff=0.0), "m").first()
    assert out.response_text is None and not s.posted
    log = calls.failed_attempts(spark, str(tmp_path / "store")).collect()
    assert len(log) == 1 and "no address that can be sent" in log[0].error
    assert model.complete(s.make(), text, model.Policy())[:2] == (None, 0) and not s.posted


def test_addresses(spark):
    rows = [("file:///a%20b.png", "/a b.png"), ("file:/x+y", "/x+y"), ("/p/q", "/p/q"), ("data:image/png;base64,AA", None), ("https://x/y.png", None), (None, None)]
    got = spark.createDataFrame(rows, "a string, w string").select("w", requests.local_path(F.col("a")).alias("p")).collect()
    assert all(r.w == r.p for r in got)


def test_requests_without_images_or_messages(spark):
    kind = "array<struct<role:string,content:array<struct<type:string,text:string,image_url:struct<url:string>>>>>"
    df = spark.createDataFrame([(1, [("user", [("text", "t", None)])]), (2, None), (3, [("user", [("image_url", None, ("https://h/x",))])])], f"i int, messages {kind}")
    files = spark.createDataFrame([], "path string, content binary")
    got = {r.i: r for r in requests.attach_images(df, files).collect()}
    assert got[2].messages is None and got[3].messages[0].content[0].image_url.url == "https://h/x" and all(r.missing_images == [] for r in got.values())


def test_a_second_run_posts_only_what_is_not_stored(spark, tmp_path, service):
    s, store = service(), str(tmp_path / "store")
    policy = model.Policy(backoff=0.0)
    calls.ask(asking(spark, ["a", "b", "a"]), store, s.make, policy, "m")
    assert s.texts() == ["a", "b"]
    out = calls.ask(asking(spark, ["c", "b", "a", "c"]), store, s.make, policy, "m")
    assert s.texts() == ["a", "b", "c"] and {(r.i, r.response_text) for r in out.collect()} == {(i, GOOD) for i in range(4)}
    calls.ask(asking(spark, ["a"]), store, s.make, model.Policy(backoff=0.0, temperature=0.7), "m")
    calls.ask(asking(spark, ["a"]), store, s.make, policy, "other")
    assert s.texts() == ["a", "a", "a", "b", "c"]  # another policy or model is another request
    assert not [p for p in os.listdir(tmp_path) if "waiting" in p]
    assert calls.ask(asking(spark, []), store, s.make, policy, "m").count() == 0


def test_a_run_that_broke_off_goes_on(spark, tmp_path, service):
    texts = [f"t{i}" for i in range(40)]
    flag, s, store = tmp_path / "broken", service(), str(tmp_path / "store")
    policy, make, bad = model.Policy(backoff=0.0), s.make, f'"{texts[17]}"'

    def failing():
        backend = make()

        def post(messages, policy):
            if bad in messages and not flag.exists():
                flag.write_text("")
                os._exit(1)  # the worker dies; no error that the call could catch
            return backend(messages, policy)

        return post

    with pytest.raises(Exception):  # noqa: B017, PT011
        calls.ask(asking(spark, texts), store, failing, policy, "m", wave=5)
    stored = calls.answers(spark, store).count()
    first = len(s.posted)
    assert 0 <= stored < 40 and not [p for p in os.listdir(tmp_path) if "waiting" in p]
    out = calls.ask(asking(spark, texts), store, failing, policy, "m", wave=5)
    assert out.where("response_text is null").count() == 0 and len(s.posted) - first == 40 - stored


def test_failed_attempts_are_logged_in_the_same_pass(spark, tmp_path, service):
    s = service(lambda body, n: None if n < 3 else "fine")
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    out = calls.ask(asking(spark, ["a"]), store, s.make, model.Policy(backoff=0.0), "m", error_log=log).first()
    assert (out.response_text, out.attempts, len(s.posted)) == ("fine", 3, 3)
    rows = spark.read.json(log).orderBy("attempt").collect()
    assert [(r.attempt, r.model, "500" in r.error, r.request_preview.asDict()) for r in rows] == [(i, "m", True, {"temperature": 0.2, "max_tokens": 800, "message_roles": ["user"]}) for i in (1, 2)]
    calls.ask(asking(spark, ["a"]), store, s.make, model.Policy(backoff=0.0), "m", error_log=log)
    assert spark.read.json(log).count() == 2 and len(s.posted) == 3


def test_rounds_until_valid_and_requests_that_never_are(spark, tmp_path, service):
    s = service(lambda body, n: "none" if n == 1 or body["messages"][0]["content"] == "b" else GOOD)
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    policy = model.Policy(backoff=0.0, retries=2)
    one = calls.ask(asking(spark, ["a"]), store, s.make, policy, "m", valid=True, error_log=log).first()
    assert (one.response_text, one.attempts) == (GOOD, 2)
    never = calls.ask(asking(spark, ["b"]), store, s.make, policy, "m", valid=True, error_log=log).first()
    assert never.response_text is None and len(s.posted) == 4
    rows = spark.read.json(log).collect()
    assert sorted(r.attempt for r in rows) == [1, 1, 2] and all("no valid output" in r.error for r in rows)
    calls.ask(asking(spark, ["b"]), store, s.make, policy, "m", valid=True)
    assert len(s.posted) == 6  # without an answer it is asked again


def test_posts_and_rounds_nest():
    said, waits = iter([None, "none", None, None]), []

    def backend(m, p):
        text = next(said)
        if text is None:
            raise OSError("down")
        return {"choices": [{"message": {"content": text}}]}

    got = calls.attempted(backend, "[]", model.Policy(retries=2), "m", True, waits.append)
    assert got[:2] == (None, 4) and [(f["attempt"], f["request_preview"] is None) for f in got[2]] == [(1, False), (1, True), (1, False), (2, False), (2, True)]
    assert waits == [2.0, 2.0, 2.0]


def test_batches_are_bounded_and_settings_return(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with requests.arrow_batches(spark, 3, 1000):
        sizes = spark.range(10, numPartitions=1).mapInPandas(lambda it: (f.assign(id=len(f)) for f in it), "id long").toPandas().id.max()
        big = spark.range(10, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(600)).alias("t")).mapInPandas(lambda it: (f.iloc[:1].assign(n=len(f))[["n"]] for f in it), "n long").toPandas().n.max()
    assert sizes <= 3 and big <= 2
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# ---------------------------------------------------------------- texts and tokens


def test_chosen_is_the_teachers_own_text(spark):
    extra = '```json\n{"note": {"ü": [1, "a/b"]}, "explanation": " Plain é. ", "raw_confidence": "0.25", "decision": " Abstain ", "abstain_type": "region_missing", "risk_level": "HIGH", "answer": 7, "z": null}\n```'
    t = outputs.parse_and_validate(spark.createDataFrame([("s", 1, "i", "q", extra)], "sample_id string, variant_idx int, image_path string, question string, t string"), "t", "teacher_output")
    s = outputs.parse_and_validate(spark.createDataFrame([("s", 1, GOOD)], "sample_id string, variant_idx int, student_text string"), "student_text", "student_output")
    got = pairs.mine_pairs(pairs.pair_outputs(t, s)).first()
    assert got.chosen == '{"note": {"ü": [1, "a/b"]}, "explanation": "Plain é.", "raw_confidence": 0.25, "decision": "abstain", "abstain_type": "region_missing", "risk_level": "high", "answer": "7", "z": null}'
    assert got.rejected == GOOD and got.teacher_output.asDict() == {**{k: json.loads(got.chosen)[k] for k in outputs.REQUIRED}, "extra": '{"note": {"ü": [1, "a/b"]}, "z": null}'}
    assert got.student_output.extra is None and set(got.student_output.asDict()) == {*outputs.REQUIRED, "extra"}


@pytest.mark.parametrize("text", ['[{"question": "a", "image": "x.png", "pos": 7}, {"question": "b", "image": "y.png", "pos": 7}]', '{"data": [{"question": "a", "image": "x.png", "pos": 7}, {"question": "b", "image": "y.png", "pos": 7}]}'])
@pytest.mark.parametrize("lines", [False, True])
def test_a_field_named_pos(spark, tmp_path, text, lines):
    name = str(tmp_path / ("x.jsonl" if lines else "x.json"))
    with open(name, "w") as f:
        f.write("\n".join(map(json.dumps, json.loads(text) if text[0] == "[" else json.loads(text)["data"])) if lines else text)
    rows = prepare.normalize_rows(io.read_json(spark, name))
    assert [(r.pos, r.question, json.loads(r.raw_metadata)["pos"]) for r in rows.orderBy("pos").collect()] == [(0, "a", 7), (1, "b", 7)]
    listing = spark.createDataFrame([("/r/x.png",), ("/r/y.png",)], "path string")
    assert {(r.question, r.image_path) for r in prepare.resolve_images(rows, listing, "/r").collect()} == {("a", "/r/x.png"), ("b", "/r/y.png")}


def plain_batches(rows, size, pad, step, shard_rows, most):
    """Batches by loops: rows are (key, whole text, prompt text)."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = lambda x: t.encode(x, add_special_tokens=False).ids[:most]
    buckets = {}
    for key, whole, prompt in rows:
        a = ids(whole)
        buckets.setdefault(-(-len(a) // step), []).append((len(a), key, a, len(ids(prompt))))
    out = set()
    for bucket, found in buckets.items():
        shards = -(-len(found) // shard_rows)
        for shard in range(shards):
            mine = sorted(r for r in found if int(hashlib.md5(r[1].encode()).hexdigest()[:8], 16) % shards == shard)
            for i in range(0, len(mine), size):
                group = mine[i : i + size]
                longest = max(r[0] for r in group)
                padded = [r[2] + [pad] * (longest - r[0]) for r in group]
                labels = [[-100 if j < r[3] or v == pad else v for j, v in enumerate(p)] for p, r in zip(padded, group, strict=True)]
                mask = [[int(j < r[0]) for j in range(longest)] for r in group]
                text = lambda lists: ";".join(",".join(map(str, x)) for x in lists)
                out.add((bucket, shard, i // size, ",".join(r[1] for r in group), text(padded), text(mask), text(labels), ",".join(str(r[3]) for r in group)))
    return out


def chat(messages, reply):
    text = "".join(f"<|{r}|>\n" + "\n".join(x if k == "text" else "<image>" for k, x in parts) + "\n<|end|>\n" for r, parts in messages)
    return text + "<|assistant|>\n" if reply else text


def conversations(rows):
    out = []
    for key, question, answer in rows:
        asked = [("system", [("text", prompts.SYSTEM)]), ("user", [("image_url", None), ("text", f"Question: {question}")])]
        out.append((key, chat([*asked, ("assistant", [("text", answer)])], False), chat(asked, True)))
    return out


def flat(df):
    text = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), ",")), ";")
    return df.select("bucket", "shard", "batch", F.array_join("keys", ","), text("input_ids"), text("attention_mask"), text("labels"), F.array_join(F.transform("prompt_lengths", lambda v: v.cast("string")), ","))


@pytest.mark.parametrize(("shard_rows", "most"), [(4096, 1536), (7, 60)])
def test_batches_against_a_plain_loop(spark, shard_rows, most):
    import public_tokenizers

    said = [(f"k{i}", "why é? " * (i % 9 + 1), "<|endoftext|> yes 🙂 " * (i % 5)) for i in range(60)] + [("k1", "again", ""), ("k1", "again", "")]
    df = spark.createDataFrame(said, "key string, question string, answer string").select("key", prompts.training_messages(F.col("question"), F.lit("file:///i"), F.col("answer")).alias("messages"))
    tokens = batches.sft_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), most)
    got = batches.length_batches(tokens, "key", 4, 50256, 16, shard_rows)
    assert {tuple(r) for r in flat(got).collect()} == plain_batches(conversations(said), 4, 50256, 16, shard_rows, most)
    assert batches.length_batches(tokens.limit(0), "key", 4, 50256).collect() == []


def test_batch_query_against_a_plain_loop(spark):
    rows = [(f"{r.sample_id}_{r.pos}", r.question, r.answer) for r in q.index(spark, "/root/testdata/sf0.001").collect()]
    got = {tuple(r) for r in q.sft_batches(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain_batches(conversations(rows), 8, 50256, 64, 4096, 1536)


def test_preference_tokens_against_a_plain_loop(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for r in q.index(spark, "/root/testdata/sf0.001").collect():
        asked = [("system", [("text", prompts.SYSTEM)]), ("user", [("image_url", None), ("text", f"Check the evidence before you reply.\nQuestion: {r.question}")])]
        prompt = chat(asked, True)
        want.append((r.sample_id, ",".join(map(str, t.encode(prompt + r.answer, add_special_tokens=False).ids)), len(t.encode(prompt, add_special_tokens=False).ids)))
    assert sorted(map(tuple, q.preference_tokens(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_log_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 1000.0],), ([],), (None,)], "x array<double>")
    got = [r[0] for r in df.select(arrays.log_softmax(F.col("x"))).collect()]
    assert got[0] == pytest.approx([-2.40760596, -1.40760596, -0.40760596]) and got[1] == pytest.approx([-0.69314718] * 2) and got[3] is None


def test_outputs_are_parsed_once_when_written(spark, tmp_path):
    df = outputs.parse_and_validate(spark.createDataFrame([(1, GOOD), (2, "no")], "i int, t string"), "t")
    good, rest = outputs.write_quarantined(df, str(tmp_path / "q"))
    assert [r.i for r in good.collect()] == [1] and [r.i for r in rest.collect()] == [2] and good.columns == df.columns


# ---------------------------------------------------------------- files by probing, and the commands that call services


def test_files_are_found_by_probing(spark, tmp_path, monkeypatch):
    from mirador.sources import probe

    root, out = tmp_path / "root", tmp_path / "elsewhere"
    for name in ("root/a.png", "root/images/b.png", "root/deep/er/c.jpg", "root/deep/d.e.png", "root/sub/f.png", "elsewhere/g.png", "elsewhere/h.png", "root/other/h.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    want = {
        "a.png": root / "a.png", "gone/a.png": root / "a.png", "b.png": root / "images/b.png", "sub/f.png": root / "sub/f.png", f"{out}/g.png": out / "g.png",
        "c.jpg": root / "deep/er/c.jpg", "c": root / "deep/er/c.jpg", "d": root / "deep/d.e.png", "d.e.png": root / "deep/d.e.png", "g.png": None, f"{out}/c.jpg": root / "deep/er/c.jpg",
        f"{out}/h.png": out / "h.png", "h.png": root / "other/h.png", "x/none.png": None, "  a.png ": root / "a.png", f"{out}/none.png": None,
    }
    rows = spark.createDataFrame(list(enumerate(want)), "pos int, image_path string").withColumn("asked", F.col("image_path"))
    got = {r.asked: r.image_path for r in probe.resolve_by_probing(rows, str(root)).collect()}
    assert got == {k: v and str(v) for k, v in want.items()}
    monkeypatch.setattr(probe, "image_listing", lambda *a: pytest.fail("the whole tree was listed"))
    few = probe.resolve_by_probing(rows.where(F.col("asked").isin("a.png", "b.png", f"{out}/g.png")), str(root))
    assert few.count() == 3 and few.where("image_path is null").isEmpty()


def test_pairs_and_inference_from_the_command_line(spark, tmp_path, service, capsys):
    from mirador.__main__ import main

    (tmp_path / "pics").mkdir()
    for i in range(6):
        (tmp_path / f"pics/{i}.png").write_bytes(PNG + bytes([i]))
    index = [{"sample_id": f"s{i}", "image_path": f"{tmp_path}/pics/{i}.png", "question": f"q{i}", "answer": "yes", "split": "val"} for i in range(7)]
    (tmp_path / "val.jsonl").write_text("\n".join(map(json.dumps, index)))
    question = lambda body: next(p["text"] for m in body["messages"] for p in m["content"] if p["type"] == "text" and "Question: " in p["text"]).rsplit("Question: ", 1)[1]
    abstains = GOOD.replace('"answer", "abs', '"abstain", "abs').replace('"none"', '"region_missing"')
    teacher = service(lambda body, n: abstains if question(body) in ("q1", "q3") else GOOD.replace('"low"', '"high"') if question(body) == "q4" else GOOD)
    student = service(lambda body, n: abstains if question(body) == "q3" else GOOD.replace("0.5", "0.75"))
    urls = ["--teacher-url", f"http://127.0.0.1:{teacher.server.server_port}/", "--student-url", f"http://127.0.0.1:{student.server.server_port}/", "--backoff", "0"]
    run = ["pairs", "--input-jsonl", str(tmp_path / "val.jsonl"), "--images-dir", str(tmp_path / "pics"), "--store", str(tmp_path / "store"), "--output", str(tmp_path / "pairs"), *urls]
    assert main(run, spark) == {"pairs": 2}
    made = {r.sample_id: r for r in spark.read.json(str(tmp_path / "pairs")).collect()}
    assert set(made) == {"s1", "s4"} and made["s1"].chosen == abstains and made["s4"].rejected == GOOD.replace("0.5", "0.75")
    assert len(teacher.posted) == 6 and sorted(map(question, student.posted)) == ["q1", "q3", "q4"]  # s6 has no picture; the student is asked only where a pair may come of it
    assert main(run, spark) == {"pairs": 2} and len(teacher.posted) == 6 and len(student.posted) == 3
    model = {"method": "isotonic_regression", "x_thresholds": [0.0, 1.0], "y_thresholds": [0.0, 0.5]}
    (tmp_path / "cal.json").write_text(json.dumps(model))
    ask = ["infer", "--store", str(tmp_path / "store"), "--output", str(tmp_path / "said"), "--apply-calibration", str(tmp_path / "cal.json"), *urls[2:]]
    assert main([*ask, "--image-path", f"{tmp_path}/pics/2.png", "--question", "q2"], spark) == {"predictions": 1, "rejected": 0}
    row = spark.read.json(str(tmp_path / "said")).first()
    assert row.question == "q2" and row.sample_id is None and row.prediction.raw_confidence == 0.75 and row.prediction.calibrated_confidence == 0.375
    assert main([*ask, "--input-jsonl", str(tmp_path / "val.jsonl"), "--images-dir", str(tmp_path / "pics")], spark) == {"predictions": 6, "rejected": 1}
    assert '"rejected": 1' in capsys.readouterr().out


def test_teaching_and_batches_from_the_command_line(spark, tmp_path, service):
    import numpy as np
    import public_tokenizers

    from mirador.__main__ import main
    from mirador.operators import images, variants

    (tmp_path / "pics").mkdir()
    rng = np.random.default_rng(0)
    for i in range(5):
        (tmp_path / f"pics/{i}.png").write_bytes(images.png(rng.integers(0, 256, 16 * 16 * 3).astype(np.uint8).tobytes(), 16, 16))
    index = [{"sample_id": f"s{i}", "image_path": f"{tmp_path}/pics/{i}.png", "question": f"q{i}", "answer": "yes", "split": "train"} for i in range(6)]
    (tmp_path / "train.jsonl").write_text("\n".join(map(json.dumps, index)))
    said = '{"note": 1, "explanation": "Plain.", "raw_confidence": "0.5", "decision": "Answer", "abstain_type": "none", "risk_level": "low", "answer": "lesion"}'
    teacher = service(lambda body, n: said)
    run = ["teach", "--input-jsonl", str(tmp_path / "train.jsonl"), "--images-dir", str(tmp_path / "pics"), "--store", str(tmp_path / "store"), "--output", str(tmp_path / "out"), "--backoff", "0"]
    report = main([*run, "--teacher-url", f"http://127.0.0.1:{teacher.server.server_port}/"], spark)
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert report["records"] == len(rows) and report["records"] + report["rejected"] == 30 and report["rejected"] >= 1  # s5 has no picture
    assert {r.teacher_text for r in rows} == {said.replace('"0.5"', "0.5").replace("Answer", "answer")} and rows[0].teacher_output.extra == '{"note": 1}'
    degraded = [r for r in rows if r.degradation_type in variants.DEGRADATIONS]
    assert degraded and all(r.image_path.startswith(f"{tmp_path}/out-images/") and r.sample_id.startswith(f"{r.source_sample_id}__") for r in degraded)
    posted = len(teacher.posted)
    assert "file:" not in json.dumps(teacher.posted)
    assert main([*run, "--teacher-url", f"http://127.0.0.1:{teacher.server.server_port}/"], spark) == report and len(teacher.posted) == posted
    made = main(["batches", "--input-jsonl", str(tmp_path / "out"), "--output", str(tmp_path / "b"), "--tokenizer", public_tokenizers.path("byte_bpe_50k.json"), "--pad-id", "50256", "--batch-size", "4", "--eval-ratio", "0.1"], spark)
    train, held = (spark.read.parquet(str(tmp_path / f"b/{x}")).collect() for x in ("train", "eval"))
    assert made == {"train": len(train), "eval": len(held)}
    assert sum(len(b["keys"]) for b in train) + sum(len(b["keys"]) for b in held) == len(rows) and sum(len(b["keys"]) for b in held) == (3 if len(rows) > 20 else 0)
    assert all(len({len(x) for x in (*b.input_ids, *b.labels, *b.attention_mask)}) == 1 for b in train)
