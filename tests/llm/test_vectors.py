import numpy as np
import pytest
from conftest import roots
from pyspark.sql import functions as F

from ruleweave.llm import lattice, topk

ODD = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [float("inf")] + [0.0] * 15), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0])]


@pytest.fixture
def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    away = rng.standard_normal((60, 16))
    away -= (away * base).sum(1, keepdims=True) / (base * base).sum(1, keepdims=True) * base
    away *= np.linalg.norm(base, axis=1, keepdims=True) / np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.9505, 0.999, (60, 1))
    near = cosine * base + np.sqrt(1 - cosine**2) * away
    dense = base[0] + 0.15 * rng.standard_normal((40, 16))
    copies = np.repeat(base[5:6], 12, axis=0)
    rows = np.concatenate([base, near * 3, dense, copies])
    return [(i, [float(x) for x in row]) for i, row in enumerate(rows)] + ODD + [(None, [1.0] * 16), (5, [float(x) for x in base[5]])]


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("node", F.lit("x")).withColumn("links", F.lit("y"))
    got = sorted(tuple(r) for r in lattice.near_vectors(frame).collect())
    rows = [(i, v) for i, v in vectors if i is not None]
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                pairs.append((a, b))
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    root = roots({i for i, _ in rows}, [(rows[a][0], rows[b][0]) for a, b in pairs])
    assert got == sorted((i, int(degree[k]), root[i], i == root[i]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width", [16, 64, 300])
def test_no_pair_at_the_threshold_is_missed(width):
    """Pairs just above the threshold meet in some table, at every size that a lattice is fitted to."""
    rng = np.random.default_rng(width)
    one, other = rng.standard_normal((2, 3000, width))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(1, keepdims=True) * one
    other = 0.9505 * one + np.sqrt(1 - 0.9505**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    for rows in (100, 1_000_000):
        fit = lattice.fitted(rows, width, 0.95)
        met = np.zeros(len(one), bool)
        for table in range(fit.tables):
            a, b = fit.cells(one, table), fit.cells(other, table)
            met |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
        assert met.mean() >= 0.999, (rows, fit)


def test_unlike_vectors_met_hardly_grow_with_the_table():
    def strangers(rows):
        x = np.random.default_rng(rows).standard_normal((rows, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        fit, met = lattice.fitted(rows, 64, 0.95), 0
        for table in range(fit.tables):
            cells = fit.cells(x, table)
            homes, counts = np.unique(cells[:, 0], return_counts=True)
            at = np.clip(np.searchsorted(homes, cells), 0, len(homes) - 1)
            met += (counts[at] * (homes[at] == cells)).sum() - rows
        return met / rows

    small, large = strangers(4_000), strangers(40_000)
    assert large < 1.5 * small and large < 150, (small, large)


def test_nearest_is_a_lattice_point():
    points = np.random.default_rng(1).uniform(-3, 3, (500, 8))
    found = lattice.nearest(points)
    assert (np.isin((found * 2) % 2, [0, 1])).all() and (found.sum(axis=1) % 2 == 0).all()
    own = ((points - found) ** 2).sum(axis=1)
    assert len(lattice.ROOTS) == 240 and all((own <= ((points - found - root) ** 2).sum(axis=1) + 1e-9).all() for root in lattice.ROOTS)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice.near_vectors(none).count() == 0
    assert topk.top_k(none, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("scale,blocks", [(1024.0, (8192, 1024)), (3.0, (16, 2)), (1e7, (16, 2))])
def test_top_k(spark, vectors, monkeypatch, scale, blocks):
    monkeypatch.setattr(topk, "VECTORS", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rows = [(i, v) for i, v in vectors if i is not None]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("g", F.lit("g"))
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 7, scale).collect())
    whole = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, own in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)[:7]
            want += [(q, rank, i, -score) for rank, (score, i) in enumerate(scores, 1)]
    assert got == sorted(want)


def test_few_candidates(spark):
    frame = spark.createDataFrame([(100, [1.0]), (200, [1.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0).collect())
    assert got == [(100, 1, 200, 1048576), (100, 2, 3, -1048576), (200, 1, 100, 1048576), (200, 2, 3, -1048576)]


@pytest.mark.parametrize("k", [2, 9])
def test_rows_that_share_an_id(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "VECTORS", 2)
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (3, [5.0, 0.0]), (3, [5.0, 0.0]), (3, [4.0, 0.0]), (3, [0.0, 7.0]), (4, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0, k, 1.0).collect())
    scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for i, q in rows if i == 100 for j, v in rows if j != i)
    assert got == [(100, rank, j, -score) for rank, (score, j) in enumerate(scores[:k], 1)]
