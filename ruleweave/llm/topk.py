"""Exact top-k inner products by a three-phase uniform threshold over slices of the dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ruleweave.llm.common import cut, ship

#: Vectors and queries that meet in one task, queries scored at a time, and slices of the dimensions.
VECTORS, QUERIES, STRIPE, SLICES = 8192, 1024, 128, 4


def usable(vector: Column) -> Column:
    """Not null, and no component null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(column: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of list rows, missing dimensions zero; whole numbers held in float64."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    rows = np.zeros((len(sizes), width))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    rows[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * scale)
    return rows


def _width(*columns: pa.ChunkedArray) -> int:
    return max([1, *(pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns if len(c))])


def _slices(queries: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
    """Integer partial scores of each slice; float64 products while they are exact, else 64-bit integers."""
    top = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1] * SLICES
    if top >= 2**53:
        queries, vectors = queries.astype(np.int64), vectors.astype(np.int64)
    parts = [part for part in np.array_split(np.arange(queries.shape[1]), SLICES) if len(part)]
    return [queries[:, part] @ vectors[:, part].T for part in parts]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _gather(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """Phase 1: of each query's best k partial scores in every slice, the k best whole scores."""
        out_query, out_score = [], []
        width = _width(queries["vector"], vectors["of"])
        q, v = matrix(queries["vector"], width, 1.0), matrix(vectors["of"], width, 1.0)
        q_ids, v_ids = queries["query_id"].to_numpy(), vectors["id"].to_numpy()
        for low in range(0, len(q), STRIPE):
            parts = _slices(q[low : low + STRIPE], v)
            total = sum(parts)
            for i, query in enumerate(q_ids[low : low + STRIPE]):
                most = min(k + 1, len(v_ids))  # one may be the query itself
                lists = [np.argpartition(part[i], len(v_ids) - most)[len(v_ids) - most :] for part in parts]
                seen = np.unique(np.concatenate(lists))
                seen = seen[v_ids[seen] != query]
                best = np.sort(total[i, seen])[::-1][:k]
                out_query += [query] * len(best)
                out_score.append(best)
        scores = np.concatenate(out_score).astype(np.int64) if out_score else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(out_query, pa.int64()), "score": pa.array(scores)})

    return run


def _collect(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """Phases 2 and 3: entries with a slice at the query's cutoff / slices, then their whole scores."""
        out_query, out_vec, out_score, out_times = [], [], [], []
        width = _width(queries["vector"], vectors["of"])
        q, v = matrix(queries["vector"], width, 1.0), matrix(vectors["of"], width, 1.0)
        q_ids, v_ids, cutoffs = queries["query_id"].to_numpy(), vectors["id"].to_numpy(), queries["cutoff"].to_pylist()
        asked, copies = queries["asked"].to_numpy(), vectors["copies"].to_numpy()
        for low in range(0, len(q), STRIPE):
            parts = _slices(q[low : low + STRIPE], v)
            for i, query in enumerate(q_ids[low : low + STRIPE]):
                cutoff = cutoffs[low + i]
                enough = v_ids != query
                if cutoff is not None:
                    enough &= np.maximum.reduce([part[i] for part in parts]) * len(parts) >= cutoff
                at = np.flatnonzero(enough)
                whole = sum(part[i, at] for part in parts)
                if cutoff is not None:
                    at, whole = at[whole >= cutoff], whole[whole >= cutoff]
                best = _best(whole, v_ids[at], k)
                out_query += [query] * len(best)
                out_vec.append(v_ids[at[best]])
                out_score.append(whole[best])
                out_times.append(np.minimum(asked[low + i] * copies[at[best]], k))
        join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(out_query, pa.int64()), "vec_id": pa.array(join(out_vec)), "score": pa.array(join(out_score)), "times": pa.array(join(out_times))})

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row, exactly.

    Components become floor(scale * x). ``queries`` says which rows are queries; candidates are all
    rows with another vec_id. Ties go to the smaller vec_id. Vectors that are null or hold a null or
    non-finite component take no part; shorter vectors count as zero beyond their end; rows without a
    vec_id are left out. Rows with one vec_id are candidates of their own, whether their vectors differ or
    not, and as queries share one list, in which each of them finds every candidate. Equal rows meet as
    one row with a number of copies. An empty table gives an empty one.

    Vectors and queries are dealt into blocks of fixed size and every query block meets every vector
    block once in each pass; a block returns at most k entries for a query. Pass 1 gathers the local
    lists of each slice of the dimensions, whose k-th best whole score is a cutoff that no answer is
    below; an entry that reaches it has a slice that reaches cutoff / slices, so pass 2 collects just
    those and resolves their scores.
    """
    ship(vectors.sparkSession)
    vector = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    rows = vectors.filter("vec_id IS NOT NULL").filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    counted = rows.groupBy("vec_id", "embedding").agg(F.least(F.count(F.lit(1)), F.lit(k).cast("long")).alias("copies"))
    rows = cut(counted.select("vec_id", vector.alias("vector"), "copies"))
    asked = rows.filter(queries).select(F.col("vec_id").alias("query_id"), "vector", F.col("copies").alias("asked"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(queries).alias("m")).first()
    groups, blocks = max(1, -(-counts["n"] // VECTORS)), max(1, -(-counts["m"] // QUERIES))
    deal = lambda name, parts: F.pmod(F.xxhash64(name, "vector"), F.lit(parts)).cast("int")
    all_ = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    spread = rows.select(F.col("vec_id").alias("id"), F.col("vector").alias("of"), "copies", deal("vec_id", groups).alias("g"), all_(blocks).alias("b"))

    def meet(asked: DataFrame, work, schema: str) -> DataFrame:
        sent = asked.select("*", deal("query_id", blocks).alias("b"), all_(groups).alias("g"))
        return sent.groupBy("g", "b").cogroup(spread.groupBy("g", "b")).applyInArrow(work, schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    lists = meet(asked, _gather(k), "query_id long, score long")
    cutoffs = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    cutoffs = cutoffs.groupBy("query_id").agg(F.max_by("score", "rank").alias("cutoff"), F.max("rank").alias("rank"))
    cutoffs = cutoffs.filter(F.col("rank") == k).select("query_id", "cutoff")
    entries = meet(asked.join(cutoffs, "query_id", "left"), _collect(k), "query_id long, vec_id long, score long, times long")
    entries = entries.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
