import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from ruleweave.llm import graph, quality, secret_scan, simhash
from ruleweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    _, _, same, note = compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert same is not False, note


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "secrets", "mix", "pack"]
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = {i for i, text in rows.items() if model.score(quality.statistics(text)[None, :])[0] >= 0.5}
    kept = stage["quality"](spark, docs, FOLDER)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == COLUMNS
    fps = {i: simhash.fingerprint(rows[i]) for i in want}
    edges = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    later = {r.node for r in graph.components(spark.createDataFrame(edges or [(0, 0)], "src long, dst long")).filter("node <> component").collect()}
    alone = stage["near_duplicates"](spark, kept, FOLDER)
    assert {r.doc_id for r in alone.collect()} == want - later and alone.columns == COLUMNS
    clean = stage["secrets"](spark, alone, FOLDER)
    found = {r.doc_id for r in secret_scan.scan(alone).filter(F.size("spans") > 0).collect()}
    assert clean.columns == COLUMNS and clean.count() == len(want - later)
    assert all((r.text != rows[r.doc_id]) == (r.doc_id in found) and r.n_chars == len(r.text) for r in clean.collect())
    mixed = stage["mix"](spark, clean, FOLDER)
    assert mixed.columns == COLUMNS and sorted(r.doc_id for r in mixed.collect()) == sorted(want - later)


def test_run(spark):
    pieces = corpus_pipeline.run(spark, FOLDER)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens"))
    assert whole.filter("n <> tokens").count() == 0 and whole.count() > 100


def test_stages_take_any_table(make):
    """Names that stages could use inside, nulls, repeats and empty tables: the first four keep the columns."""
    rows = [(1, "some words here", "a"), (1, "some words here", "a"), (None, None), (2, "", None), (3, "secret = abcdefghijkl1234", "b")]
    spark = make([]).sparkSession
    for docs in (make(rows), make([])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert out.count() >= 0
            if name != "pack":
                assert out.columns == docs.columns, name


def test_a_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    folder, asked = str(tmp_path), []
    stages = [(name, lambda *args, name=name, stage=stage: asked.append(name) or stage(*args)) for name, stage in corpus_pipeline.STAGES]
    stages[2] = ("secrets", lambda *args: 1 / 0)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, FOLDER, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:2], ("secrets", corpus_pipeline.scrubbed), *stages[3:]])
    assert corpus_pipeline.run(spark, FOLDER, folder).count() > 0
    assert asked == ["quality", "near_duplicates", "mix", "pack"]


def test_a_giant_component(spark):
    star = spark.createDataFrame([(i, 0) for i in range(1, 3000)] + [(5001, 5000), (5002, 5001)], "src long, dst long")
    found = {r.node: r.component for r in graph.components(star).collect()}
    assert found == {i: 0 for i in range(3000)} | {5000: 5000, 5001: 5000, 5002: 5000}


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 7), (7, 7), (7, 1), (None, 3), (5, None)] + [(1000, 1000 + i) for i in range(50)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {1: 1, 7: 1} | {1000 + i: 1000 for i in range(50)}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
