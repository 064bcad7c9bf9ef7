"""Null, empty, repeated and odd rows, operator by operator; tables written by an operator that fails are gone."""

import os

import pytest
from pyspark.sql import functions as F

from mirador.llm import common, components, decontaminate, hnsw, language_id, packing, quality, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "the cat and the dog", "en", "a", 1), (1, "the cat and the dog", "en", "a", 1), (None, "le chat et le chien", "fr", None, None), (None, None, None, None, None), (2, "", None, "b", 0), (3, " \t\n", "en", "b", 3), (4, "x" * 70_000, None, "c", None), (5, "1234 !!", "de", None, 7)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_packing_of_odd_rows(spark, docs):
    pieces = packing.pack_documents(docs).collect()
    by = {}
    for r in pieces:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    # a row's pieces cover its ids, each once; the two equal rows have theirs each
    assert sum(r.length for r in pieces if r.doc_id == 1) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 1)
    assert sorted(r.doc_tokens for r in pieces if r.doc_id is None and r.length == 1 and r.doc_tokens == 1) == [1]
    assert {r.doc_tokens for r in pieces if r.doc_id in (2, 3)} == {1}
    assert all(r.length & (r.length - 1) == 0 and r.offset == 0 for r in pieces)
    long = sorted((r.start, r.length) for r in pieces if r.doc_id == 4)
    assert [a for a, _ in long] == [sum(n for _, n in long[:i]) for i in range(len(long))]
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_language_of_odd_rows(spark, docs):
    train = spark.createDataFrame([(10 + i, t, lang, "a", 1) for i, (t, lang) in enumerate([("the cat and the dog went out", "en"), ("le chat et le chien sont la", "fr")] * 6)], SCHEMA)
    model = language_id.train_language_model(train)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert 0 <= r.lang_score <= 1 and r.lang_pred in ("en", "fr", "und")
    assert sorted(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 5)) == [True] * 3
    assert language_id.identify(docs.limit(0), model).collect() == []


def test_contamination_of_odd_rows(spark, docs):
    items = spark.createDataFrame([(7, "the cat and the dog"), (8, None), (9, ""), (None, "le chat et le chien")], "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert len(got) == len(ODD) and sum(r.contaminated for r in got if r.doc_id == 1) == 2
    assert {r.n_words for r in got if r.doc_id in (2, 3)} == {0}
    assert decontaminate.contamination(docs.limit(0), items).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())


def test_components_alone(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (7, 8), (4, 4), (9, 5), (9, 5)], "src long, dst long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset({3, 5, 9}), frozenset({7, 8})}
    chain = spark.range(300).select(F.xxhash64("id").alias("src"), F.xxhash64(F.col("id") + 1).alias("dst"))  # ids are hashes
    assert len({r.root for r in components.connected_components(chain).collect()}) == 1
    assert components.connected_components(edges.limit(0)).collect() == []


def test_vectors_of_odd_shapes(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (None, [1.0, 1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, df, 20).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(1, 2), (2, 1)} and len([r for r in got if r.query_id == 1]) == 2


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_failing_operator_leaves_no_tables(spark, docs):
    def fails(session, sf_dir):
        common.materialize(docs, "left")
        raise KeyError("x")

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with pytest.raises(KeyError):
        common.tidy(fails)(spark, "")
    assert set(os.listdir(folder)) == before
    assert all(f.__wrapped__ for f in registry.QUERIES.values())


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(10 + i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    train = spark.createDataFrame([(10 + i, "good plain words here" if i % 2 else "&&& %%% ###", "en", "a", 1) for i in range(40)], SCHEMA)
    model = quality.train_quality_model(docs.unionByName(train), labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score_quality(docs.limit(0), model).collect() == []


def test_near_copies_cost_their_number(spark, monkeypatch):
    """A cluster of near copies of one text, and some texts that drift away from it, in small blocks: blocks are made for the latter."""
    import random

    from mirador.llm import jaccard_join

    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(300)] = f"x{i}"
        texts.append(" ".join(t))
    drift = list(base)
    for i in range(12):  # each like the one before it, the last unlike the first
        drift[i * 20 : i * 20 + 8] = [f"d{i}-{j}" for j in range(8)]
        texts.append(" ".join(drift))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    joined = []
    real = jaccard_join._dealt
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(jaccard_join, "_dealt", lambda *a: joined.append(real(*a)) or joined[-1])
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == want and len(set(got.values())) < 12
    assert joined
