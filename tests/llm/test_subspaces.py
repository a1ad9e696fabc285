import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import subspaces
from ruleweave.llm.subspaces import Codec

ODD = [(900, 1, None), (901, None, [0.0] * 8), (902, 1, [float("nan")] + [0.0] * 7), (903, 1, [1.0, None] * 4), (904, 1, [float("-inf")] * 8), (905, 2, []), (906, 2, [1.0, -2.5])]


def slow(rows, codec):
    """Every distance of every part, in Python's whole numbers."""
    rows = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = max([len(r[2]) for r in rows], default=0)
    width = max(-(-width // codec.parts), 1) * codec.parts
    step = width // codec.parts
    points = [[math.floor(codec.scale * x) for x in r[2]] + [0] * (width - len(r[2])) for r in rows]
    cut = lambda x, p: tuple(x[p * step : (p + 1) * step])
    first = sorted((r[0], r[2], i) for i, r in enumerate(rows) if r[0] is not None)[: codec.entries]
    books = [[cut(points[i], p) for _, _, i in first] or [(0,) * step] for p in range(codec.parts)]
    for turn in range(codec.rounds + 1):
        codes, errors = [], []
        for x in points:
            found = [min((sum((a - b) ** 2 for a, b in zip(cut(x, p), c)), e) for e, c in enumerate(books[p])) for p in range(codec.parts)]
            codes.append([e for _, e in found])
            errors.append(sum(d for d, _ in found))
        if turn < codec.rounds:
            for p in range(codec.parts):
                for e in range(len(books[p])):
                    mine = [cut(x, p) for x, code in zip(points, codes) if code[p] == e]
                    if mine:
                        books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    sums = {}
    for r, error in zip(rows, errors):
        sums[r[1]] = sums.get(r[1], 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for e in code), error, sums[r[1]], sha) for r, code, error in zip(rows, codes, errors)]


def rows_of(seed, n=150):
    rng = np.random.default_rng(seed)
    points = rng.standard_normal((n, 8)).round(2)
    points[40:90] = points[3] + 0.02 * rng.integers(-1, 2, (50, 8))
    points[100:130] = points[7]
    return [(i, i % 4 or None, [float(x) for x in p]) for i, p in enumerate(points)] + ODD + [(None, 3, [0.5] * 8), (5, 1, [0.25] * 8), (5, 1, [0.25] * 8)]


CODECS = [
    Codec(parts=4, entries=16, most=4), Codec(parts=4, entries=16, most=4, rounds=6, least=1), Codec(parts=3, entries=200, most=8), Codec(parts=2, entries=8, most=1, least=1, rounds=5, open_share=0.0),
    Codec(parts=4, entries=12, most=50, rounds=4), Codec(parts=4, entries=1), Codec(parts=4, entries=16, rounds=0), Codec(parts=8, entries=16, scale=2.0, rounds=4),
]


@pytest.mark.parametrize("codec", CODECS, ids=range(len(CODECS)))
def test_codes(spark, codec):
    rows = rows_of(CODECS.index(codec))
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("vector", F.lit("x")).withColumn("error", F.lit("y")).withColumn("own", F.lit(1))
    got = sorted((tuple(r) for r in subspaces.encode(frame.repartition(3), codec).collect()), key=str)
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert got == sorted(slow(rows, codec), key=str)


def test_large_components_stay_whole(spark):
    rows = [(i, 1, [float((-1) ** i * (i + 1) * 1000), 90000.0, -90000.0, 0.001]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    codec = Codec(parts=2, entries=6, rounds=3)
    assert sorted(tuple(r) for r in subspaces.encode(frame, codec).collect()) == sorted(slow(rows, codec))
    huge = spark.createDataFrame([(1, 1, [1e300, -1e300]), (2, 1, [0.0, 1e38])], "vec_id long, label int, embedding array<double>")
    assert subspaces.encode(huge, codec).count() == 2


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert subspaces.encode(none).count() == 0
    assert subspaces.encode(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).count() == 0
    alone = subspaces.encode(spark.createDataFrame([(None, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["error"], r["label_error"]) for r in alone] == [(None, 0, 0)]  # the entry of zeros has moved there


def test_bounds_spare_most_distances_and_are_adapted():
    """Where entries move little, few rows look at all entries, and none is assigned otherwise than by all distances."""
    rng = np.random.default_rng(1)
    rows = rng.integers(-500, 500, (4000, 4))
    entries = rows[:64].copy()
    held, _ = subspaces.first_bounds(rows, entries, 8)
    for _ in range(12):
        moved_to = entries + rng.integers(-6, 7, entries.shape)
        moved = subspaces._above(((moved_to - entries) ** 2).sum(axis=1))
        entries = moved_to
        held, best, depth = subspaces.next_bounds(rows, entries, moved, held, 8)
        found = subspaces.squares(rows, entries)
        assert (held.own == found.argmin(axis=1)).all() and (best == found.min(axis=1)).all()
        assert (depth < 0).mean() < 0.2
        roots = np.sqrt(found.astype(float))
        assert (held.lower <= np.take_along_axis(roots, held.listed, 1)).all()
        np.put_along_axis(roots, held.listed, np.inf, 1)
        roots[np.arange(len(rows)), held.own] = np.inf
        assert (held.outer <= roots.min(axis=1)).all()
    wider, _, _ = subspaces.next_bounds(rows, entries, moved, held, 12)
    narrow, _, _ = subspaces.next_bounds(rows, entries, moved, held, 3)
    assert wider.listed.shape[1] == 12 and narrow.listed.shape[1] == 3
