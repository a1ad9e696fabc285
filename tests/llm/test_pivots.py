import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import pivots
from ruleweave.llm.pivots import Index
from ruleweave.llm.queries import QUERIES

ODD = [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0, None] * 4), (980, [float("inf")] + [0.0] * 7), (1000, []), (1020, [3.0, -2.0])]
EVERYTHING = Index(pivots=12, nearest=6, share=1.0, growth=1.0, vectors=40, queries=3)


def brute(rows, k, step=20):
    """Each query row's k largest products, one row for each candidate row but itself."""
    rows = [(i, v) for i, v in rows if i is not None and v and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (query, q) in enumerate(rows):
        if query % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for other, (i, v) in enumerate(rows) if other != at)
            out += [(query, rank, i, -score) for rank, (score, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def made(seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-4, 5, (160, 8)))]
    return rows + [(200 + i, rows[3][1]) for i in range(60)] + [(40, rows[9][1]), (3, rows[3][1]), (60, rows[60][1]), (60, rows[60][1]), (None, rows[1][1])] + ODD


@pytest.mark.parametrize("k", [4, 20, 500])
@pytest.mark.parametrize("kind", ["float", "int"])
def test_all_candidates_give_the_exact_lists(spark, k, kind):
    rows = made() if kind == "float" else [(i, v and [None if x is None else int(x) for x in v]) for i, v in made() if not v or all(x is None or math.isfinite(x) for x in v)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("class_id", F.lit("x")).withColumn("rank", F.lit("y")).withColumn("vector", F.lit(0))
    got = sorted(tuple(r) for r in pivots.nearest_neighbours(frame.repartition(3), F.col("vec_id") % 20 == 0, k, EVERYTHING).collect())
    assert got == brute(rows, k)


def test_lists_are_full_and_scores_exact(spark):
    rows = [(i, v) for i, v in made() if i is not None]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pivots.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, 7, Index(pivots=10, nearest=4, share=0.1, growth=0.1, vectors=50, queries=4)).collect()
    scores = {}
    for i, v in rows:
        scores.setdefault(i, []).append(v)
    assert all(any(r["score"] == sum(a * b for a, b in zip(q, v)) for q in scores[r["query_id"]] for v in scores[r["vec_id"]]) for r in got)
    wanted = brute(rows, 7)
    assert sorted((r["query_id"], r["rank"]) for r in got) == sorted((q, rank) for q, rank, _, _ in wanted)


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(20, [1.0]), (40, [1.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in pivots.nearest_neighbours(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == [(20, 1, 40, 1.0), (20, 2, 3, -1.0), (40, 1, 20, 1.0), (40, 2, 3, -1.0)]
    assert pivots.nearest_neighbours(frame.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert pivots.nearest_neighbours(frame.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_lengths_count():
    """Longer vectors have larger products: the added component keeps the order of pivots by distance."""
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((300, 6)) * rng.uniform(0.1, 3, (300, 1))
    longest = (rows * rows).sum(axis=1).max()
    places = pivots.Permutations(rows[:20], 20, longest)
    full = np.column_stack((rows, np.sqrt(np.maximum(longest - (rows * rows).sum(axis=1), 0))))
    for queries, points in ((False, full), (True, np.column_stack((rows, np.zeros(300))))):
        far = ((points[:, None, :] - full[:20]) ** 2).sum(axis=2)
        ranked = np.take_along_axis(far, places.of(rows, queries), 1)
        assert (np.diff(ranked, axis=1) >= -1e-9).all()


def test_agreement_is_the_footrule_distance():
    rng = np.random.default_rng(6)
    m, n = 15, 6
    orders = np.array([rng.permutation(m)[:n] for _ in range(50)])
    files = pivots.InvertedFiles(orders, m)
    place = lambda order, p: list(order).index(p) if p in order else n
    for query in orders[:10]:
        footrule = [sum(abs(place(query, p) - place(v, p)) for p in range(m)) for v in orders]
        assert (n * (n + 1) - 2 * files.agreement(query) == footrule).all()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    """Against brute force, with production parameters, on the whole table."""
    table = pq.read_table(f"{folder}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)
    hits = total = 0
    got = {}
    for r in QUERIES["op13_pivot_search"](spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hits += len(got[ids[at]] & set(best.tolist()))
        total += len(best)
        assert len(got[ids[at]]) == 20
    assert hits / total >= 0.95, hits / total
    print(folder, "recall", hits / total)
