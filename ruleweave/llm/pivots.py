"""Approximate nearest neighbours by an index of pivot permutations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ruleweave.llm.common import cut, ship
from ruleweave.llm.topk import usable


@dataclass(frozen=True)
class Index:
    """``pivots`` points of the table; each vector is posted under its ``nearest`` ones.

    ``share * rows ** growth`` candidates of a query, by footrule, are looked at again. A shard of the
    index holds about ``vectors`` of them and meets about ``queries`` at a time.
    """

    pivots: int = 2048
    nearest: int = 96
    share: float = 5.0
    growth: float = 0.6
    vectors: int = 16384
    queries: int = 4096

    def candidates(self, rows: int) -> int:
        return int(np.ceil(self.share * rows**self.growth))


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """List rows in double precision, zero beyond their end."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    rows = np.zeros((len(sizes), width))
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows[np.repeat(np.arange(len(sizes)), sizes), at] = lists.flatten().to_numpy(zero_copy_only=False)
    return rows


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last whatever stands beside them."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        total += left[:, j] * right[:, j]
    return total


class Permutations:
    """Vectors as the order of their nearest pivots.

    The largest inner product is the smallest distance once every vector gets one more component that
    makes all lengths equal (zero for a query); so pivots are ordered by inner products of such vectors.
    """

    def __init__(self, pivots: np.ndarray, nearest: int, longest: float) -> None:
        self.longest = longest
        self.pivots = np.column_stack((pivots, self.rest(pivots)))
        self.nearest = min(nearest, len(pivots))

    def rest(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (rows * rows).sum(axis=1), 0.0))

    def of(self, rows: np.ndarray, queries: bool) -> np.ndarray:
        """Numbers of each row's nearest pivots, the nearest first, ties to the smaller number."""
        last = np.zeros(len(rows)) if queries else self.rest(rows)
        far, n = -(np.column_stack((rows, last)) @ self.pivots.T), self.nearest
        if n == far.shape[1]:
            return np.argsort(far, axis=1, kind="stable")
        near = np.sort(np.argpartition(far, n - 1, axis=1)[:, :n], axis=1)
        values = np.take_along_axis(far, near, 1)
        order = np.take_along_axis(near, np.argsort(values, axis=1, kind="stable"), 1)
        tied = np.flatnonzero((far <= values.max(axis=1, initial=-np.inf)[:, None]).sum(axis=1) > n)
        order[tied] = np.argsort(far[tied], axis=1, kind="stable")[:, :n]
        return order


class InvertedFiles:
    """For every pivot the vectors that hold it among their nearest, with its place in their order."""

    def __init__(self, orders: np.ndarray, pivots: int) -> None:
        self.size, self.nearest = orders.shape
        pivot = orders.ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        self.vector = (by_pivot // self.nearest).astype(np.int32)
        self.weight = (self.nearest - by_pivot % self.nearest).astype(np.int32)
        self.bounds = np.searchsorted(pivot[by_pivot], np.arange(pivots + 1))

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """Half of the greatest footrule distance less each vector's own, from the lists of the query's pivots.

        With n places and the place n for a pivot that is missing, a pivot at places i and j takes
        n - max(i, j) off that half, and all others nothing.
        """
        parts = [slice(self.bounds[p], self.bounds[p + 1]) for p in order]
        own = np.repeat(self.nearest - np.arange(len(order)), [part.stop - part.start for part in parts])
        weight = np.minimum(np.concatenate([self.weight[part] for part in parts]), own)
        return np.bincount(np.concatenate([self.vector[part] for part in parts]), weight, self.size)


def _represent(pivots: np.ndarray, index: Index, scale: float, longest: float, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's nearest pivots in order, as 32-bit numbers."""
        places = Permutations(pivots, index.nearest, longest)
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                some = batch.slice(low, 4096)
                order = places.of(dense(some.column(1), pivots.shape[1]) * scale, queries).astype("<u4")
                blobs = [row.tobytes() for row in order]
                yield pa.record_batch([some.column(0), some.column(1), pa.array(blobs, pa.binary())], ["class_id", "vector", "places"])

    return run


def _orders(column: pa.ChunkedArray) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<u4").reshape(len(blobs), -1).astype(np.int64)


def _search(width: int, pivots: int, index: Index, k: int, rows: int):
    share = index.candidates(rows) / max(rows, 1)

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """The best k rows of this shard for each query, of those that the footrule distance puts first."""
        q, v = dense(queries["vector"], width), dense(vectors["vector"], width)
        q_ids, v_ids = queries["class_id"].to_numpy(), vectors["class_id"].to_numpy()
        out = []
        if len(q) and len(v):
            files = InvertedFiles(_orders(vectors["places"]), pivots)
            enough = min(len(v), max(k, int(np.ceil(share * len(v)))))
            for i, order in enumerate(_orders(queries["places"])):
                agree = files.agreement(order)
                least = np.partition(agree, len(agree) - enough)[len(agree) - enough]
                at = np.flatnonzero(agree >= least)
                score = products(v[at], np.broadcast_to(q[i], (len(at), width)))
                if len(at) > k:
                    kept = np.flatnonzero(score >= np.partition(score, len(at) - k)[len(at) - k])
                    at, score = at[kept], score[kept]
                out.append((np.full(len(at), q_ids[i]), v_ids[at], score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_class": pa.array(columns[0], pa.int64()), "class_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 20, index: Index = Index()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row.

    Each vector is represented by the order of its nearest pivots, points of the table that its hash
    picks, and posted in the inverted files of those pivots. The files are cut into shards of vectors;
    every block of queries meets every shard once, so no pair leaves a task: the lists of a query's
    pivots give the footrule distance to every vector of the shard, the shard's part of
    ``index.candidates`` is looked at again by exact inner products in double precision, ties at the
    cutoff included, and at most the k best leave the task. Hash-dealt shards see like samples, so the
    parts add up to the whole table's candidates.

    ``queries`` is a condition on vec_id that says which rows are queries; candidates are all rows but
    the query's own, ties go to the smaller vec_id. Equal vectors are one point of the index with its
    k + 1 smallest ids, which are all that can be among the k best. Rows that are equal in id and
    vector are rows like any other: each is a candidate of its copies and has, as a query, its own
    list. Vectors that are null, zero or hold a null or non-finite component take no part; shorter
    ones count as zero beyond their end; rows without a vec_id are left out; other columns are
    ignored; an empty table gives an empty one.
    """
    ship(vectors.sparkSession)
    given = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if given in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.filter(usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    held = cut(rows.groupBy("vector", "vec_id").agg(F.count(F.lit(1)).alias("copies")))
    of_class = Window.partitionBy("vector").orderBy("vec_id")
    firsts = held.withColumn("nth", F.row_number().over(of_class)).filter(F.col("nth") <= k + 1)
    points = cut(firsts.filter("nth = 1").select(F.monotonically_increasing_id().alias("class_id"), "vector"))
    members = firsts.join(points, "vector").select("class_id", "vec_id", "copies")
    asked = held.filter(queries).join(points, "vector").select(F.col("class_id").alias("query_class"), F.col("vec_id").alias("query_id"), F.col("copies").alias("asked"))
    query_points = cut(asked.select(F.col("query_class").alias("class_id")).distinct().join(points, "class_id").select("class_id", "vector"))
    n, width, scale, longest = _measures(points)
    pivots = np.zeros((min(n, index.pivots), width))
    for at, row in enumerate(points.orderBy(F.xxhash64("vector"), "vector").limit(index.pivots).collect()):
        pivots[at, : len(row["vector"])] = row["vector"]
    kind = points.schema["vector"].dataType.simpleString()

    def represented(some: DataFrame, of_queries: bool) -> DataFrame:
        return some.mapInArrow(_represent(pivots * scale, index, scale, longest, of_queries), f"class_id long, vector {kind}, places binary")

    shards, blocks = max(1, -(-n // index.vectors)), max(1, -(-query_points.count() // index.queries))
    deal = lambda parts: F.pmod(F.xxhash64("vector"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    spread = represented(points, False).select("class_id", "vector", "places", deal(shards).alias("shard"), every(blocks).alias("block"))
    sent = represented(query_points, True).select("class_id", "vector", "places", deal(blocks).alias("block"), every(shards).alias("shard"))
    search = _search(width, len(pivots), index, k + 1, n)
    found = sent.groupBy("shard", "block").cogroup(spread.groupBy("shard", "block")).applyInArrow(search, "query_class long, class_id long, score double")
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id")
    named = found.join(members, "class_id").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    own = (F.col("class_id") == F.col("query_class")) & (F.col("vec_id") == F.col("query_id"))
    others = F.least(F.lit(k).cast("long"), F.col("copies") - F.when(own, 1).otherwise(0))
    pairs = named.join(asked, "query_class").withColumn("others", others).filter("others > 0")
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(1).cast("long"), "others")))
    order = Window.partitionBy("query_class", "query_id").orderBy(F.desc("score"), "vec_id")
    lists = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return lists.withColumn("asker", F.explode(F.sequence(F.lit(1).cast("long"), "asked"))).select("query_id", "rank", "vec_id", "score")


def _measures(points: DataFrame) -> tuple[int, int, float, float]:
    """Vectors, their width, what scales the largest component to one, and the longest scaled square length."""
    top = F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))).cast("double")
    sizes = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(top).alias("top")).first()
    if not sizes["n"]:
        return 0, 1, 1.0, 0.0
    scale = 1.0 / sizes["top"]
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + (x.cast("double") * scale) * (x.cast("double") * scale))
    return sizes["n"], sizes["width"], scale, points.agg(F.max(square).alias("longest")).first()["longest"]
