"""Product codes of vectors, learned by k-means with adaptive distance bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ruleweave.llm.common import cut, ship
from ruleweave.llm.topk import usable


@dataclass(frozen=True)
class Codec:
    """``parts`` codebooks of ``entries``; components become floor(scale * x); ``rounds`` of learning.

    A part first keeps bounds of ``most`` entries. Where none at a position looked that far, fewer are
    kept next time, ``least`` at least; where more than ``open_share`` looked at all entries, twice as many.
    """

    parts: int = 16
    entries: int = 64
    scale: float = 256.0
    rounds: int = 2
    most: int = 8
    least: int = 2
    open_share: float = 0.25


def limit(width: int) -> int:
    """Largest magnitude of a component for which squared distances and their sums fit 62 bits."""
    return 1 << ((58 - int(width).bit_length()) // 2)


def whole(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of list rows, zero beyond their end, held within ``limit``."""
    sizes = np.asarray(pc.list_value_length(column)).astype(np.int64)
    rows = np.zeros((len(sizes), width), np.int64)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    most = limit(width)
    rows[np.repeat(np.arange(len(sizes)), sizes), at] = np.clip(flat, -most, most).astype(np.int64)
    return rows


def _below(squares: np.ndarray) -> np.ndarray:
    """Float32 numbers not above the roots."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def _above(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def squares(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry, in whole numbers."""
    top = max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0))
    if rows.shape[1] * (2 * int(top)) ** 2 < 1 << 53:  # then float64 holds every term and sum
        a, b = rows.astype(np.float64), entries.astype(np.float64)
        found = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return found.astype(np.int64)
    return ((rows[:, None, :] - entries) ** 2).sum(axis=2)


@dataclass
class Bounds:
    """For each row: its entry, the entries listed next with lower bounds of their distances in rising
    order, and one lower bound for all entries that are not listed."""

    own: np.ndarray
    listed: np.ndarray
    lower: np.ndarray
    outer: np.ndarray


def first_bounds(rows: np.ndarray, entries: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds from all distances, and the squared distance of each row's entry."""
    found = squares(rows, entries)
    own = found.argmin(axis=1)  # the first of equally near ones
    every = np.arange(len(rows))
    best = found[every, own]
    found[every, own] = np.iinfo(np.int64).max
    b = min(b, len(entries) - 1)
    if b == len(entries) - 1:
        listed = np.argsort(found, axis=1, kind="stable")[:, :b]
        outer = np.full(len(rows), np.inf, np.float32)
    else:
        listed = np.argpartition(found, b, axis=1)[:, : b + 1]
        listed = np.take_along_axis(listed, np.argsort(np.take_along_axis(found, listed, 1), axis=1, kind="stable"), 1)
        outer = _below(found[every, listed[:, b]])
        listed = listed[:, :b]
    return Bounds(own, listed, _below(np.take_along_axis(found, listed, 1)), outer), best


def next_bounds(rows: np.ndarray, entries: np.ndarray, moved: np.ndarray, held: Bounds, b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """Bounds after the entries moved by at most ``moved``; squared distances; entries looked at (-1: all).

    Bounds fall by as much as their entry moved, the outer one by the largest move. The listed entries
    whose bound does not exceed the distance of the row's own entry are verified in whole numbers; a row
    whose distance reaches the outer bound is compared with all entries. The lists shrink or grow to b.
    """
    n = len(rows)
    own, listed = held.own.copy(), held.listed
    least = np.minimum.accumulate((held.lower - moved[listed])[:, ::-1], axis=1)[:, ::-1] if listed.shape[1] else held.lower
    lower = np.nextafter(held.lower - moved[listed], np.float32(-np.inf))
    least = np.nextafter(least, np.float32(-np.inf))
    outer = np.nextafter(held.outer - moved.max(initial=0), np.float32(-np.inf))
    best = ((rows - entries[own]) ** 2).sum(axis=1)
    reach = _above(best)
    depth = (least <= reach[:, None]).sum(axis=1)
    unsure = reach >= outer
    depth[unsure] = 0
    first, before = best.copy(), own.copy()
    for j in range(int(depth.max(initial=0))):
        at = np.flatnonzero(depth > j)
        entry = listed[at, j]
        found = ((rows[at] - entries[entry]) ** 2).sum(axis=1)
        lower[at, j] = _below(found)
        nearer = (found < best[at]) | ((found == best[at]) & (entry < own[at]))
        own[at[nearer]], best[at[nearer]] = entry[nearer], found[nearer]
    # the entry that a row has left takes the place of the one that it has now
    changed = np.flatnonzero(own != before)
    listed = listed.copy()
    if len(changed):
        place = (listed[changed] == own[changed, None]).argmax(axis=1)
        listed[changed, place], lower[changed, place] = before[changed], _below(first[changed])
    order = np.argsort(lower, axis=1, kind="stable")
    listed, lower = np.take_along_axis(listed, order, 1), np.take_along_axis(lower, order, 1)
    if b < listed.shape[1]:  # what leaves the lists is covered by the outer bound
        outer, listed, lower = np.minimum(outer, lower[:, b]), listed[:, :b], lower[:, :b]
    elif b > listed.shape[1]:  # places that only rows compared with all entries can fill
        spare = ((0, 0), (0, b - listed.shape[1]))
        listed, lower = np.pad(listed, spare, constant_values=-1), np.pad(lower, spare, constant_values=np.inf)
    depth[unsure] = -1
    if unsure.any():
        at = np.flatnonzero(unsure)
        fresh, best[at] = first_bounds(rows[at], entries, b)
        own[at], listed[at], lower[at], outer[at] = fresh.own, fresh.listed, fresh.lower, fresh.outer
    return Bounds(own, listed, lower, outer), best, depth


def _fixed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


STATE = "vec_id long, label {label}, vector array<int>, own binary, depth array<byte>, listed array<short>, lower array<float>, outer array<float>"
CODED = "vec_id long, label {label}, own binary, error long"


def _bytes(rows: np.ndarray) -> pa.Array:
    body, width = np.ascontiguousarray(rows, np.uint8), rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).astype(np.int64)


def _state(ids: pa.Array, labels: pa.Array, vectors: np.ndarray, made: list[Bounds], depth: np.ndarray) -> pa.RecordBatch:
    own, outer = np.stack([held.own for held in made], axis=1), np.stack([held.outer for held in made], axis=1)
    listed = np.concatenate([held.listed for held in made], axis=1)
    lower = np.concatenate([held.lower for held in made], axis=1)
    columns = [_fixed(vectors, pa.int32()), _bytes(own), _fixed(depth, pa.int8()), _fixed(listed, pa.int16()), _fixed(lower, pa.float32()), _fixed(outer, pa.float32())]
    return pa.record_batch([ids, labels, *columns], ["vec_id", "label", "vector", "own", "depth", "listed", "lower", "outer"])


def _coded(ids: pa.Array, labels: pa.Array, own: list[np.ndarray], best: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([ids, labels, _bytes(np.stack(own, axis=1)), pa.array(sum(best))], ["vec_id", "label", "own", "error"])


def _begin(books: np.ndarray, keep: list[int], codec: Codec, width: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All distances: the first bounds of every part."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = whole(batch.column(2), width, codec.scale)
            parts = vectors.reshape(n, codec.parts, -1)
            made = [first_bounds(parts[:, p], books[p], keep[p]) for p in range(codec.parts)]
            ids, labels = batch.column(0), batch.column(1)
            if last:
                yield _coded(ids, labels, [held.own for held, _ in made], [best for _, best in made])
            else:
                yield _state(ids, labels, vectors, [held for held, _ in made], np.full((n, codec.parts), -1))

    return run


def _continue(books: np.ndarray, moved: np.ndarray, held: list[int], keep: list[int], codec: Codec, last: bool):
    """held, keep: entries listed for each part in the table that comes in, and in the one that goes out."""
    starts = np.cumsum([0, *held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = _numbers(batch.column(3))
            vectors, listed, lower, outer = (_matrix(batch.column(i), n) for i in (2, 5, 6, 7))
            vectors, listed = vectors.astype(np.int64), listed.astype(np.int64)
            parts, made = vectors.reshape(n, codec.parts, -1), []
            for p in range(codec.parts):
                span = slice(starts[p], starts[p + 1])
                bounds = Bounds(own[:, p], listed[:, span], lower[:, span], outer[:, p])
                made.append(next_bounds(parts[:, p], books[p], moved[p], bounds, keep[p]))
            if last:
                yield _coded(batch.column(0), batch.column(1), [held.own for held, _, _ in made], [best for _, best, _ in made])
            else:
                yield _state(batch.column(0), batch.column(1), vectors, [held for held, _, _ in made], np.stack([depth for _, _, depth in made], axis=1))

    return run


def _sums(codec: Codec, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's rows: size, sums, deepest look and looks at all entries, by part and entry."""
        total = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors, own, depth = _matrix(batch.column(0), n).astype(np.int64), _numbers(batch.column(1)), _matrix(batch.column(2), n)
            parts = vectors.reshape(n, codec.parts, -1)
            if total is None:
                total = np.zeros((codec.parts, entries, parts.shape[2] + 1), np.int64)
                deepest, looks = np.zeros(codec.parts, np.int64), np.zeros(codec.parts, np.int64)
            for p in range(codec.parts):
                np.add.at(total[p], own[:, p], np.column_stack((parts[:, p], np.ones(n, np.int64))))
            deepest = np.maximum(deepest, depth.max(axis=0))
            looks += (depth < 0).sum(axis=0)
        if total is not None:
            p, e = np.divmod(np.arange(codec.parts * entries), entries)
            body = total.reshape(len(p), -1)
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(body[:, -1]), _fixed(body[:, :-1], pa.int64()), pa.array(deepest[p]), pa.array(looks[p])]
            yield pa.record_batch(columns, ["part", "entry", "size", "sums", "deepest", "looks"])

    return run


def _learn(state: DataFrame, books: np.ndarray, listed: list[int], codec: Codec, first: bool) -> tuple[np.ndarray, list[int]]:
    """Each entry as the floor of its parts' mean, and how many entries to list from now on.

    Only parts x entries sums come to the driver: a size that the codec fixes.
    """
    entries, width = books.shape[1:]
    local = state.select("vector", "own", "depth").mapInArrow(_sums(codec, entries), "part int, entry int, size long, sums array<long>, deepest long, looks long")
    sums = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)]
    found = local.groupBy("part", "entry").agg(F.sum("size").alias("size"), F.max("deepest").alias("deepest"), F.sum("looks").alias("looks"), *sums).collect()
    books, listed = books.copy(), list(listed)
    rows = sum(row["size"] for row in found if row["part"] == 0)
    for row in found:
        p = row["part"]
        if row["size"]:
            books[p, row["entry"]] = [row[f"s{j}"] // row["size"] for j in range(width)]
        if row["entry"] == 0 and not first:
            needed = 2 * listed[p] if row["looks"] > codec.open_share * rows else min(listed[p], row["deepest"])
            listed[p] = int(min(max(needed, codec.least), entries - 1))
    return books, listed


def encode(vectors: DataFrame, codec: Codec = Codec()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is not dropped.

    Vectors are cut into ``codec.parts`` consecutive parts of equal width, and every part position has
    a codebook that starts as that part of the smallest vec_ids' vectors. A round assigns each part to
    its nearest entry, ties to the lower index, and moves entries to the floor of their parts' mean;
    unused ones stay. The first assignment leaves, in a table in the shared folder, each part's nearest
    entries with lower bounds of their distances and one bound for the rest; the next ones take off how
    far the entries have moved and verify in whole numbers what the bounds leave open. How many entries
    are listed follows what the last assignment needed.

    Rows are dropped whose vector is null or holds a null or non-finite component. The width is the
    longest vector's, rounded up to a multiple of the parts; shorter vectors count as zero beyond their
    end. Components beyond ``limit`` of the width count as that limit. Equal rows are rows like any
    other; the starting entries are the smallest vec_ids in order, then the smaller vector; a null
    vec_id stays null and starts no entry (one of zeros, should there be no other). label_error is the
    sum over equal labels, nulls together (null, should it not fit a long); without a label column all
    rows are one. Other columns are ignored; an empty table gives an empty one.
    """
    ship(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))
    width = rows.agg(F.max(F.size("vector")).alias("width")).first()["width"] or 0
    width = max(-(-width // codec.parts), 1) * codec.parts
    state_kind, coded_kind = (x.format(label=rows.schema["label"].dataType.simpleString()) for x in (STATE, CODED))
    seeds = rows.filter("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(codec.entries).select("vector").toArrow()["vector"]
    entries = whole(pa.concat_arrays(seeds.chunks), width, codec.scale) if len(seeds) else np.zeros((1, width), np.int64)
    books = np.ascontiguousarray(entries.reshape(len(entries), codec.parts, -1).swapaxes(0, 1))
    listed = [min(codec.most, books.shape[1] - 1)] * codec.parts
    begin = _begin(books, listed, codec, width, last=not codec.rounds)
    found = rows.mapInArrow(begin, state_kind if codec.rounds else coded_kind)
    for turn in range(codec.rounds):
        state, last, before, held = cut(found), turn + 1 == codec.rounds, books, listed
        books, listed = _learn(state, books, listed, codec, first=not turn)
        moved = _above(((books - before) ** 2).sum(axis=2))
        moved[(books == before).all(axis=2)] = 0
        found = state.mapInArrow(_continue(books, moved, held, listed, codec, last), coded_kind if last else state_kind)
    coded = cut(found)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    totals = coded.groupBy(F.col("label").alias("label_of_sum")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("label_of_sum")))
    return joined.select("vec_id", F.lower(F.hex("own")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
