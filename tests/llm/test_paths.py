"""Plans that depend on size, each forced on small tables; clashing columns; held-out accuracy; the pipeline's decisions."""

import random
import re
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirador.llm import backoff_lm, common, decontaminate, hnsw, html_text, jaccard_join, language_id, line_dedup, quality, registry, warc

SF = "/root/testdata/sf0.01"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_texts(rng, groups, words, long=60):
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, long))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t) + 1)
                t[at:at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
            out.append(" ".join(t))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(UP))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("forced", [{}, {"BLOCK_SHINGLES": 40, "BROADCAST_CLASSES": 0}, {"HEAVY_FROM": 2, "SEEN": 2}, {"BLOCK_SHINGLES": 1}])
def test_jaccard_paths(spark, monkeypatch, forced):
    for k, v in forced.items():
        monkeypatch.setattr(jaccard_join, k, v)
    rng = random.Random(9)
    texts = near_texts(rng, 60, [f"w{k}" for k in range(40)]) + near_texts(rng, 6, [f"v{k}" for k in range(3000)], 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == components([shingles(t) for t in texts])


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(1500):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 500)), dtype=np.uint64))
        n = len(base)
        keep = rng.permutation(base)[int(rng.integers(0, n // 5 + 1)) :]
        other = np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(base, other))
        if 100 * both < 80 * (n + len(other) - both):
            continue
        met += 1
        heavy = np.zeros(1 << jaccard_join.HEAVY_BITS, bool)
        every = rng.permutation(np.union1d(base, other))
        heavy[(every[: int(rng.uniform() * len(every))] & np.uint64((1 << jaccard_join.HEAVY_BITS) - 1)).astype(np.int64)] = True
        heavy = np.packbits(heavy, bitorder="little")
        assert len(np.intersect1d(jaccard_join.signatures(base, 80, heavy), jaccard_join.signatures(other, 80, heavy)))
    assert met > 300


@pytest.mark.parametrize("forced", [{}, {"BROADCAST_ROWS": 0, "BROADCAST_SETS": 0, "BROADCAST_BYTES": 0}])
def test_line_dedup_paths(spark, monkeypatch, forced):
    import duckdb

    for k, v in forced.items():
        monkeypatch.setattr(line_dedup, k, v)
    rng = random.Random(5)
    lines = near_texts(rng, 120, [f"w{k}" for k in range(60)], 40)
    for _ in range(40):  # pairs of sizes as unlike as can be
        t = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(40, 300))]
        cut = (len(t) - 4) * rng.choice((79, 80, 81, 82, 85, 90)) // 100 + 4
        at = rng.randint(0, len(t) - cut)
        lines += [" ".join(t), " ".join(t[at : at + cut])]
    lines += ["", " \t ", "Read more here", "read  MORE here", "É a", "é a"] * 5
    rng.shuffle(lines)
    texts = [(i, "\n".join(lines[i * 7 : i * 7 + 7])) for i in range(-(-len(lines) // 7))] + [(9000, None), (9001, "")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts, columns=["doc_id", "text"]))
    want = con.execute(registry.ORACLE_SQL["op6_line_dedup"]).fetchall()
    got = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).select("doc_id", "n_lines", "n_gone", "text").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(3)
    lines = near_texts(rng, 40, [f"w{k}" for k in range(60)], 40)
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(10)], "doc_id long, text string")
    once = {tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_gone", "text").collect()}
    twice = [tuple(r) for r in line_dedup.dedup_lines(docs.union(docs)).select("doc_id", "n_gone", "text").collect()]
    assert set(twice) == once and len(twice) == 20 and sum(n for _, n, _ in once) > 0


def test_plain_lines_stay_distinct(spark):
    """Lines that differ in more than A-Z and white space differ in what they are compared by; all characters, and pairs."""
    chars = spark.range(0x110000).where("id not between 55296 and 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS text")
    some = chars.where("id < 400 or id % 9973 = 0")
    pairs = some.select("text").crossJoin(some.selectExpr("text AS next")).selectExpr("concat(text, next) AS text")
    old = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\x0b\f\r", "abcdefghijklmnopqrstuvwxyz    ")
    for texts in (chars.select("text"), pairs):
        got = texts.select(old.alias("old"), line_dedup._plain().alias("new")).agg(F.count_distinct("old"), F.count_distinct("new"), F.count_distinct("old", "new")).first()
        assert got[0] == got[1] == got[2] > 100_000


def test_decontamination_by_shuffle(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    few = {tuple(r) for r in decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "items_sha256").collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert {tuple(r) for r in decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "items_sha256").collect()} == few
    assert sum(n > 0 for _, _, n, _ in few) > 0


def test_clashing_columns(spark):
    names = ["n_lines", "n_gone", "hits", "lang_pred", "th", "k", "root", "items", "w", "contaminated", "n_words"]
    kind = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)
    line = "the same long line of words comes twice"
    rows = [(1, line + "\nmine alone is this", "en", *names), (2, line + "\nthis is yours alone", "en", *names), (3, "a b c d e f g h i j k", "en", *names), (None, None, None, *names)]
    docs = spark.createDataFrame(rows, kind)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lang", *names[2:], "n_lines", "n_gone"] and {r.doc_id: r.n_gone for r in out.collect()} == {1: 0, 2: 1, 3: 0, None: 0}
    kept = line_dedup.without_repeats(docs).collect()
    assert all(list(r)[3:] == names for r in kept) and {r.doc_id for r in kept} == {1, 2, 3, None}
    span = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, mode="span").collect()}
    assert span[3].text == "k" and span[3].hits == "hits" and span[1].text == rows[0][1]
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {1, 2, None}
    assert language_id.accepted(docs).columns == docs.columns and language_id.accepted(docs.limit(0)).count() == 0
    assert jaccard_join.keep_one(docs).columns == docs.columns and jaccard_join.keep_one(docs).count() == 4
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0 and decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_html_scanner_is_linear():
    n = 100_000
    pages = ["<a " + '"' * (n + 1), "<a " * n, '<a ">" ' * n, "<div class=" * n, "<!--" * n, "<script>" * n, '<a href="x>' * n + '"', "<div>" * n + "x", "<nav>" * 1000 + "<article></article>" * 20_000]
    for page in pages:
        began = time.time()
        html_text.extract(page)
        assert time.time() - began < 5
    good = "<p>It is the story of the man who went to the sea and was not seen again by any of them.</p>" * 3
    assert html_text.extract(f"<article>{good}<p title=\"a > b\" lang='x>y'>Then the end came.</p></article>").endswith("Then the end came.")


def test_html_measures_decide():
    dense = "It is the story of the man who went to the sea and was not seen again by any of them. " * 3
    bare = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna. " * 3
    clean = lambda t: " ".join(t.split())
    for name in ("class='share-price'", "id='legal-history'", "class='cookie-recipes main'"):
        assert html_text.extract(f"<article><h2>What it cost</h2><div {name}><p>{dense}</p></div></article>") == f"What it cost {clean(dense)}"
        assert html_text.extract(f"<article><p>{dense}</p><div {name}><p>Short thing.</p></div></article>") == clean(dense)
    for name in ("class='share-buttons'", "class='comment-list'", "id=comments", "class='related-stories'", "class='cookie-banner'"):
        assert html_text.extract(f"<article><p>{dense}</p><div {name}><p>{dense}</p></div></article>") == clean(dense)
    page = f"<body><div><p>{dense}</p></div><div><p>{bare}</p></div></body>"
    assert html_text.extract(page) == clean(dense)
    assert html_text.extract(page, html_text.Rules(stop_high=2.0, stop_low=2.0)) == ""
    assert html_text.extract(page, html_text.Rules(stop_high=0.0, stop_low=0.0)) == clean(dense + bare)
    links = "<a href=x>" + dense + "</a>"
    assert html_text.extract(f"<body><div><p>{dense}</p></div><div><p>{links}</p></div></body>") == clean(dense)


def test_nearest_recall_of_the_query(spark):
    d = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack(d.embedding.to_numpy()).astype(np.float64)
    ids = d.vec_id.to_numpy()
    got = registry.QUERIES["op7_nearest_neighbours"](spark, SF).toPandas()
    asked, found = np.flatnonzero(ids % 20 == 0), 0
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]])
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert len(mine) == 20 and mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, [x[i] @ x[np.flatnonzero(ids == v)[0]] for v in mine.vec_id], atol=1e-12)
        found += len(want & set(mine.vec_id))
    assert found >= 0.95 * 20 * len(asked)


def test_language_held_out(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]]
    out = registry.QUERIES["op5_language_id"](spark, SF).toPandas().merge(d, on="doc_id")
    held = out[out.held_out & (out.lang_pred != "und") & out.lang.notna()]
    assert len(held) > 150 and (held.lang_pred == held.lang).mean() > 0.97


def test_ngram_counts_by_hand():
    texts = ["Ab c", "", "ab c", "漢 字"]
    grams, sizes = language_id.ngrams(texts)
    begin = np.cumsum(sizes) - sizes
    assert sizes.tolist() == [6, 2, 6, 5]
    assert (grams[:, begin[0] : begin[0] + 6] == grams[:, begin[2] : begin[2] + 6]).all()  # case does not count
    one = grams[1, begin[0] : begin[0] + 6]
    padded = " ab c "
    pairs = [padded[i : i + 2] for i in range(5)]
    assert len(set(pairs)) == len({int(v) for v in one[:5]}) and one[5] == grams[0, begin[0] + 5]  # no pair crosses the border


def test_ftrl_step_by_hand():
    # one text, one step: z = g, n = g * g, and the weight follows in closed form; the gradient is (p - y) times tf-idf
    idf = np.linspace(1, 2, language_id.FEATURES)
    counts = [(np.array([3, 10]), np.array([1, 3]), 4), (np.array([5]), np.array([2]), 4)]
    model = language_id.fit(counts, ["a", "b"], idf, alpha=0.5, beta=1.0, l1=0.01, l2=0.02, epochs=1, batch=2, scale=2.0)
    for row, (f, c, n) in enumerate(counts):
        for feature, times in zip(f, c, strict=True):
            x = times / n * idf[feature] * 2.0
            for k in (0, 1):
                g = (0.5 - (k == row)) * x / 2
                w = 0.0 if abs(g) <= 0.01 else -(g - np.sign(g) * 0.01) / ((1.0 + abs(g)) / 0.5 + 0.02)
                assert np.isclose(model.weights[feature, k], w * idf[feature] * 2.0, rtol=1e-5)
    text = "so ab"
    grams, sizes = language_id.ngrams([text])
    f, c = np.unique(grams, return_counts=True)
    assert np.allclose(model.logits([text])[0], c @ model.weights[f] / sizes[0] + model.bias, atol=1e-6)


def test_embedding_average_by_hand():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    vectors, out = rng.normal(size=(quality.BUCKETS, 5)), rng.normal(size=(2, 5))
    model = quality.QualityModel((vectors @ (out[1] - out[0])).astype(np.float64), 0.3)
    for text in ("Some words, some Words", "漢字 x", "a"):
        data, offsets = common.text_buffer(pa.array([text]))
        f, _ = quality.features(data, offsets, 0, 1)
        z = out @ vectors[f].mean(0) + np.array([0.0, 0.3])
        assert np.isclose(model.scores(pa.array([text]))[0], np.exp(z[1]) / np.exp(z).sum())
        raw = text.encode()
        assert len(f) == len(text.split()) + sum(max(len(raw) - n + 1, 0) for n in quality.LENGTHS)


def test_contradictory_labels_are_left_out(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad signs there") for i in range(1, 30)] + [(31, "odd one")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)] + [(31, 0), (31, 1), (1, 1), (None, 1)], "doc_id long, quality int")
    a, b = (quality.train_quality_model(docs, x) for x in (labels, labels.where("doc_id is null or doc_id <> 31")))
    assert np.array_equal(a.table, b.table) and a.bias == b.bias


def test_shared_folder_must_be_named_on_a_cluster():
    unset = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)


def test_warc_files_are_rolled(spark, monkeypatch):
    from functools import partial

    monkeypatch.setattr(warc, "_write", partial(_rolled, warc._write))
    monkeypatch.setattr(warc, "FRAMES_PER_FILE", 4)
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, common.new_path(spark, "w"))
    assert spark.read.format("binaryFile").load(path).count() == 7  # three records and a dictionary each
    assert sorted(r.page_id for r in warc.read_archives(spark, path).collect()) == list(range(20))


def _rolled(write, dictionary, date):
    run = write(dictionary, date)

    def small(batches):  # workers import the module anew
        warc.FRAMES_PER_FILE = 4
        yield from run(batches)

    return small


def test_warc_of_repeated_rows(spark):
    pages = spark.createDataFrame([(7, "u", "<p>same</p>")] * 5 + [(8, "u", "<p>same</p>")], "page_id long, url string, html string")
    got = warc.read_archives(spark, warc.write_archives(pages, common.new_path(spark, "w"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(7, "response", None)] * 5 + [(8, "revisit", 7)]


def test_lm_of_the_query_by_hand(spark):
    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    got = registry.QUERIES["op9_lm_scoring"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    import zlib

    fold = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in d.doc_id}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)), ""] for i, t in zip(d.doc_id, d.text, strict=True)}
    from collections import Counter

    counts = [Counter() for _ in range(3)]
    for i, t in tokens.items():
        if not fold[i]:
            for n in (1, 2, 3):
                counts[n - 1].update(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    words = sorted(counts[0])
    place = {w[0]: k for k, w in enumerate(words)}
    kept = [{g: c for g, c in x.items() if c >= 3} for x in counts[1:]]
    grams = [(np.array([[place[w] for w in g] for g in x], np.int32).reshape(-1, n), np.array(list(x.values()))) for n, x in enumerate(kept, 2)]
    total = sum(counts[0].values())
    machine = backoff_lm.build(np.arange(len(words), dtype=np.uint64), np.array([counts[0][w] for w in words]), grams, total, len(words))
    for i in list(tokens)[:60]:
        ids = np.array([place.get(w, -1) for w in tokens[i]])
        want = machine.walk(ids, np.array([len(ids)]))[0] + (ids < 0).sum() * np.log10(1 / (total + len(words) + 1))
        assert abs(got.score[i] - want) < 1e-6 * max(1, abs(want)) and got.n_tokens[i] == len(ids) and got.held_out[i] == fold[i]


def test_pipeline_decisions(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    english = [f"{a}{b}" for a in ("the", "and", "ing", "tion", "ent") for b in ("er", "ly", "ed", "st")]
    french = [f"{a}{b}" for a in ("eau", "que", "oux", "ême", "çai") for b in ("ez", "eux", "oi", "ère")]
    text = lambda words, n=60: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, text(english if i % 2 else french), "en" if i % 2 else "fr") for i in range(1, 41)]
    item = text(english, 12)
    base = text(english)
    shared = text(french, 30)
    rows += [(100, base, "en"), (101, base.replace(" ", "  "), "en"), (102, base + " more", "en"), (103, f"{text(english, 30)} {item} {text(english, 30)}", "en"), (104, "12 34 !!", "en"), (105, None, None)]
    rows += [(110, f"{shared}\n{text(french, 40)}", "fr"), (111, f"{text(french, 40)}\n{shared}", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.toPandas()
    ids = lambda name: set(seen[name].doc_id)
    assert ids("language_id") == {r[0] for r in rows} - {104, 105}
    lines = seen["line_dedup"].set_index("doc_id").text
    assert "\n" not in lines[111] and lines[110].startswith(shared) and ids("line_dedup") == ids("language_id") - {101, 102}  # one line each, so gone with it
    assert ids("ngram_jaccard_join") == ids("line_dedup")
    assert ids("benchmark_decontamination") == ids("ngram_jaccard_join") - {103}
    assert ids("packing") == ids("benchmark_decontamination")
    final = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(final.doc_id) == ids("packing") and final.sequence_id.is_unique


def test_pieces_are_written_by_length(spark, tmp_path):
    from mirador.llm import packing

    docs = spark.createDataFrame([(1, "some words of a text " * 30), (2, ""), (3, None)], "doc_id long, text string")
    pieces = packing.pack_documents(docs)
    packing.write_sequences(pieces, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.count() == pieces.count() and all(r.length == 1 << r.bucket for r in back.collect())


def test_documents_are_dropped_by_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_DOCUMENTS", 0)
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (None, "a b c d e f g h i j k"), (2, "x"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, mode="span").collect()} == {1: "k", None: "k", 2: "x", 3: None}
    with pytest.raises(ValueError, match="unknown mode"):
        decontaminate.decontaminate(docs, bench, mode="line")
