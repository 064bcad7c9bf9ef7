import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mirador.llm import backoff_lm, decontaminate, hnsw, html_text, jaccard_join, language_id, line_dedup, packing, quality, registry, warc

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n_lines long, th string, lang string"


def frame(spark, texts, extra=("x", "y", "en")):
    return spark.createDataFrame([(i if i >= 0 else None, t, 1, extra[0], extra[2]) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    texts = [(0, " ".join(base)), (1, " ".join([*base[:-1], "other"])), (2, " ".join(base)), (2, " ".join(base)), (-1, " ".join(base)), (3, None), (4, ""), (5, "a b"), (6, "A  b"), (7, " \t"), (8, "lone " * 40000), (9, "é ß 漢字 <|endoftext|> don't x'sabc ÀÉ!? 12ab"), (10, "\n".join([" ".join(base), "a b c d e f", "a b c d e f"]))]
    return frame(spark, texts)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()}
    n = len(shingles(" ".join(odd.where("doc_id = 0").first().text.split())))
    assert {(0, n, 0), (1, n, 0), (2, n, 0), (None, n, 0), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 1, 8)} <= got
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(odd).collect() if r.doc_id is not None)
    assert kept == [0, 3, 4, 5, 7, 8, 9]  # 10 has 56 shingles of 66 from 0
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0


def test_keep_one_row_of_each_component(spark):
    a, b = "one text of six words here", "quite another text that shares nothing"
    docs = frame(spark, [(1, a), (1, b), (1, b), (2, b), (-1, a), (-1, "lines of no one at all"), (-1, "lines of no one at all"), (3, None), (-1, ""), (-1, None)])
    got = sorted(((r.doc_id, r.text or "") for r in jaccard_join.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, "lines of no one at all"), (3, ""), (None, ""), (None, "")], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_trie_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 40, int(rng.integers(1, 60))).astype(np.uint64)
        for _ in range(int(rng.integers(1, 5))):
            keep = base[rng.uniform(size=len(base)) > 0.08]
            sets.append(np.unique(keep if len(keep) else base))
    got = jaccard_join.trie_components(sets, 80)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    assert len({(find(i), int(g)) for i, g in enumerate(got)}) == len({find(i) for i in range(len(sets))}) == len(set(got.tolist()))


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    tidy = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert [re.sub(r"\.0\b", "", x) for x in tidy(got)] == [re.sub(r"\.0\b", "", x) for x in tidy(want)]


def test_line_dedup_odd(spark, odd):
    got = {(r.doc_id, r.n_gone) for r in line_dedup.dedup_lines(odd.drop("n_lines", "th")).collect()}
    assert {(0, 0), (1, 1), (2, 1), (None, 1), (3, 0), (10, 2)} <= got
    assert line_dedup.dedup_lines(odd.drop("n_lines").limit(0)).count() == 0


def test_short_lines_match_equal_ones(spark):
    docs = frame(spark, [(0, "Two words\n\nkept here\n\n漢字漢字"), (1, "two  WORDS\nthe rest of this line is kept\n漢字漢字\n \nnew"), (2, "words two\nnew\ntwo words more\none two three four"), (3, "one two three four five")])
    got = {r.doc_id: (r.n_gone, r.text) for r in line_dedup.dedup_lines(docs.drop("n_lines", "th")).collect()}
    assert got[0] == (0, "Two words\n\nkept here\n\n漢字漢字") and got[1] == (2, "the rest of this line is kept\n \nnew")
    assert got[2] == (1, "words two\ntwo words more\none two three four") and got[3][0] == 0
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}[1] == got[1][1]


def test_documents_of_short_lines_stay(spark):
    licence = "this long licence line is shared by all"
    docs = frame(spark, [(0, licence), (1, f"{licence}\nfour short\nlines of\n漢字かな"), (2, f"{licence}\n \t\n")])
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()} == {0: licence, 1: "four short\nlines of\n漢字かな"}


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, "A b"), (2, None), (3, ""), (None, "lone lone")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(odd, bench).collect()}
    assert (got[5].n_hit, got[5].n_items, got[5].items_sha256) == (2, 1, hashlib.sha256(b"1").hexdigest())
    assert got[8].n_hit == 40000 and got[3].n_words == 0 and not got[0].contaminated
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.decontaminate(odd, bench, mode="span").where("doc_id = 5").first().text == ""


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(odd.where("doc_id <> 2 and doc_id is not null")).toPandas()
    for r in odd.where("doc_id <> 2 and doc_id is not null").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = rows[rows.doc_id == r.doc_id].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    assert rows.sequence_id.is_unique and rows.length.isin([1 << k for k in range(12)]).all()


def test_lm(spark, odd):
    got = backoff_lm.score_documents(odd, odd).toPandas()
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(UP)), None] for r in odd.collect()]
    c = Counter(w for t in tokens for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) for t in tokens)
    assert np.allclose(sorted(got.base_score), want) and (got.train_tokens == n).all()
    assert backoff_lm.score_documents(odd.limit(0), odd).count() == 0
    assert (backoff_lm.score_documents(odd, odd.limit(0)).toPandas().n_known == 0).all()


def test_lm_keeps_from_the_same_count_at_every_size(spark):
    # 4,000,000 tokens and more, so a least share of 1e-6 of them would ask for more than the three times "x y z" has
    rng = random.Random(1)
    texts = [(i, "a b c d " * 1000) for i in range(1001)] + [(2000 + i, f"x y z q{i}") for i in range(3)] + [(3000, "x y z"), (3001, "y z u u"), (3002, "z x y"), (3003, " ".join(rng.choice("abcdxyz") for _ in range(500)))]
    docs = frame(spark, texts)
    train = docs.where("doc_id < 3000")
    got = {r.doc_id: r.score for r in backoff_lm.score_documents(docs, train).where("doc_id >= 2000").collect()}
    tokens = [[*t.split(), ""] for i, t in texts if i < 3000]
    count = [Counter(tuple(t[k : k + n]) for t in tokens for k in range(len(t) - n + 1)) for n in (1, 2, 3)]
    words = sorted(count[0])
    place = {w[0]: k for k, w in enumerate(words)}
    grams = []
    for c in count[1:]:
        kept = {g: m for g, m in c.items() if m >= 3}
        grams.append((np.array([[place[w] for w in g] for g in kept], np.int32), np.array(list(kept.values()))))
    total = sum(count[0].values())
    machine = backoff_lm.build(np.arange(len(words), dtype=np.uint64), np.array([count[0][w] for w in words]), grams, total, len(words))
    assert total > 4_000_000
    for i, t in texts:
        if i >= 2000:
            ids = np.array([place.get(w, -1) for w in [*t.split(), ""]])
            want = machine.walk(ids, np.array([len(ids)]))[0] + (ids < 0).sum() * math.log10(1 / (total + len(words) + 1))
            assert abs(got[i] - want) < 1e-6


def test_automaton_sums_to_one():
    rng = np.random.default_rng(2)
    text = rng.choice(6, 4000, p=[0.4, 0.25, 0.15, 0.1, 0.06, 0.04])
    counts = np.bincount(text, minlength=6)
    grams = []
    for n in (2, 3):
        g, c = np.unique(np.stack([text[i : len(text) - n + 1 + i] for i in range(n)], 1), axis=0, return_counts=True)
        grams.append((g[c >= 5].astype(np.int32), c[c >= 5]))
    machine = backoff_lm.build(np.arange(6, dtype=np.uint64), counts, grams, len(text), 6)
    score = lambda ids: machine.walk(np.array(ids), np.array([len(ids)]))[0]
    for context in ([0], [1, 2], [5, 5], [3, 0]):
        total = sum(10 ** (score([*context, w]) - score(context)) for w in range(6))
        none = 10 ** (score([*context, -1]) - score(context)) / (len(text) + 7)  # a word never seen
        assert abs(total + none - 1) < 1e-9


def test_lanes_equal_one_walk():
    rng = np.random.default_rng(5)
    text = rng.integers(-1, 4, 1000)
    machine = backoff_lm.build(np.arange(4, dtype=np.uint64), np.bincount(text[text >= 0]), [(np.array([[0, 1], [1, 2]], np.int32), np.array([50, 40]))], 1000, 9)
    lane, backoff_lm.LANE = backoff_lm.LANE, 10_000
    whole = machine.walk(text, np.array([1000]))
    backoff_lm.LANE = lane
    assert np.allclose(machine.walk(text, np.array([1000])), whole)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nb", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "é", "é" * 100000)], "page_id long, url string, html string")
    from mirador.llm.common import new_path

    got = {r.page_id: r for r in warc.read_archives(spark, warc.write_archives(pages, new_path(spark, "w"))).collect()}
    assert len(got) == 6 and got[1].record_type == "response" and got[2].refers_to == 1 and got[None].refers_to == 1
    assert got[4].refers_to == 3 and got[3].payload_bytes == 0 and got[5].payload_bytes == 200000 and got[1].payload_digest == warc.base32_sha1(b"<p>x</p>")
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), new_path(spark, "w"))).count() == 0


def test_html():
    body = "<p>" + "The cat sat on the mat and it was happy with the day. " * 5 + "</p>"
    want = " ".join(("The cat sat on the mat and it was happy with the day. " * 5).split())
    menu = "<nav><ul><li><a href=x>Home</a></ul></nav><div class='cookie-notice'>We use cookies on the site.</div>"
    page = f"<html><head><title>T</title><script>a<b</script></head><body>{menu}<article><h1>The title &amp; more</h1>{body}<p>Short.</p><form>Sign up</form><section id=comments><p>I like it.</p></section></article><footer>c</footer>"
    assert html_text.extract(page) == f"The title & more {want} Short."
    assert html_text.extract(f"<body>{menu}<div>{body}</div><footer>All rights</footer>") == want
    assert html_text.extract(None) == html_text.extract("") == "" and html_text.extract("<nav>open <article><p>Kept text here") == "Kept text here"
    assert html_text.extract("<" * 5000 + "a" * 5000 + '"' * 5000) is not None


def test_html_article_is_a_prior():
    want = " ".join(("The cat sat on the mat and it was happy with the day. " * 5).split())
    teaser = "<article>It is the story of the dog that had to go to the sea.</article>"
    assert want in html_text.extract(f"<body><div><p>{want}</p></div>{teaser}</body>")
    for wrapper in ("has-sidebar", "sidebar-right comments-open"):
        assert html_text.extract(f"<body><nav>Home</nav><div class='{wrapper}'><article><p>{want}</p></article></div></body>") == want
    assert html_text.extract(f"<body><div><p>{want}</p></div><div class=sidebar>{teaser}</div></body>") == want
    assert html_text.extract(f"<body><article><p>{want}</p></article><div><p>{'Price list item number five. ' * 8}</p></div></body>") == want


def test_language(spark):
    import pandas as pd

    d = pd.read_parquet(f"{SF}/documents.parquet")
    docs = spark.createDataFrame(d[["doc_id", "text", "lang"]])
    out = language_id.identify(docs.union(spark.createDataFrame([(None, None, None), (-2, "12 !", "en")], docs.schema)), language_id.train_language_model(docs)).toPandas()
    assert (out.lang_pred == "und").sum() == 2 and (out.lang_pred == out.lang).mean() > 0.95
    assert language_id.identify(docs, language_id.train_language_model(docs.limit(0))).count() == len(d)


def test_quality(spark):
    out = registry.QUERIES["op8_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    import pandas as pd

    m = out.merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert ((m.predicted == m.quality).mean()) > 0.9 and out.score.between(0, 1).all()
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert quality.score_quality(empty, quality.fit([], np.zeros(0, np.int64))).count() == 2


def test_whole_texts_and_rare_languages_are_learned(spark, monkeypatch):
    pad = "1 " * 12000
    texts = [(i, pad + ("aab bba " if i % 2 else "xxy yyx ") * 3000, "en" if i % 2 else "fr") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    out = language_id.identify(docs, language_id.train_language_model(docs)).toPandas()
    assert (out.lang_pred == out.lang).all()
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    table = quality.train_quality_model(docs, labels)
    p = quality.score_quality(docs, table).toPandas().set_index("doc_id").score
    assert p[p.index % 2 == 1].min() > p[p.index % 2 == 0].max()
    monkeypatch.setattr(language_id, "FIT_ROWS", 100)
    many = spark.createDataFrame([(i, f"aab bba {i}", "en") for i in range(3000)] + [(9000, "żółw ćma", "pl")], "doc_id long, text string, lang string")
    assert "pl" in language_id.train_language_model(many).classes


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[5:40] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (None, [1.0] * 16), (9004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, df.where("vec_id % 20 = 0"), 20, 1500).toPandas()
    s = x[::20].astype(float) @ x.astype(float).T
    s[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    cut = np.sort(s, 1)[:, -20]
    assert (got.groupby("query_id").size() == 20).all() and len(got) == 3000
    assert (got.score >= cut[got.query_id // 20] - 1e-9).mean() >= 0.9
    assert np.allclose(got.score, s[got.query_id // 20, got.vec_id]) and not got.duplicated(["query_id", "vec_id"]).any()
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0
