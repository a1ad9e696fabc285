import zlib

import numpy as np
from pyspark.sql import functions as F

from ruleweave.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in kept]) > 0.97


def test_only_the_text_counts(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.fit(docs, labels)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = (sorted(tuple(r) for r in quality.scored(d, model, "doc_id").collect()) for d in (docs, other))
    assert a == b
    changed = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, changed)
    assert np.allclose(model.means, again.means) and np.allclose(model.factors, again.factors)


def test_edges(spark, make):
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1), (3, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    rows = [(1, None), (1, ""), (None, "x"), (2, "word " * 50_000)]
    got = quality.classify(make(rows), labels).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"] and {r.score for r in got} == {0.5}
    assert quality.classify(make([]), labels).count() == 0
    kept = quality.accepted(make(rows), labels)
    assert kept.columns == make(rows).columns and kept.count() == 4


def test_one_class_alone():
    rows = np.random.default_rng(1).standard_normal((3, quality.FEATURES))
    moments = {1: (3.0, rows.sum(axis=0), rows.T @ rows)}
    score = quality.Quadratic.fit(moments).score(np.zeros((2, quality.FEATURES)))
    assert np.isfinite(score).all()
