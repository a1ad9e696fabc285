"""Near-duplicate vectors by hashing random projections to points of the E8 lattice."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ruleweave.llm.common import cut, release, ship
from ruleweave.llm.graph import components
from ruleweave.llm.topk import usable

#: Members of a cell that are compared in one task; larger cells are dealt out in pairs of blocks.
BLOCK = 1024


@dataclass(frozen=True)
class Lattice:
    """``tables`` of cells, each of ``joined`` projections to eight dimensions decoded together.

    ``scale`` is the lattice's unit; a vector visits the cells in which one of its lattice points is
    replaced by one of the ``probes`` neighbours nearest to it.
    """

    tables: int = 12
    scale: float = 0.22
    probes: int = 8
    joined: int = 2
    seed: int = 7

    @property
    def seats(self) -> int:
        """Cells of a vector in one table: its own, then those that it visits."""
        return 1 + self.probes * self.joined

    def frame(self, table: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        return _frame(self.seed, table, width)

    def cells(self, units: np.ndarray, table: int) -> np.ndarray:
        """Hashes of each unit vector's own cell, then of those that it visits, for one table."""
        homes, near = [], []
        for part in range(self.joined):
            axes, offset = self.frame(table * self.joined + part, units.shape[1])
            points = units @ axes / self.scale + offset
            home = nearest(points)
            rank = (points - home) @ ROOTS.T
            order = np.argpartition(-rank, self.probes, axis=1)[:, : self.probes]  # the same for the same vector
            homes.append(np.rint(home * 2).astype(np.int64))
            near.append(np.rint((home[:, None, :] + ROOTS[order]) * 2).astype(np.int64))
        own = [_folded(home, part) for part, home in enumerate(homes)]
        moved = [_folded(cells, part) for part, cells in enumerate(near)]
        base = sum(own)
        visits = [base[:, None] - own[part][:, None] + moved[part] for part in range(self.joined)]
        return _mixed(np.concatenate((base[:, None], *visits), axis=1), table, units.shape[1])


#: The unit for so many vectors, in distances that projection leaves between vectors at the threshold;
#: finer with more rows, so that unlike vectors share cells about as often at every size. By the number
#: of points joined: rows from which it is used, rows that the unit is for, and how it falls with rows.
UNIT, STEPS = 2.3, ((2, 0, 10_000, 1 / 11), (3, 3_000_000, 1_000_000, 1 / 16.5))
#: Chance that all tables miss a pair whose cosine is the threshold.
MISS = 1e-5


def fitted(rows: int, width: int, least: float, miss: float = MISS) -> Lattice:
    """The lattice for a table of that size: finer with more rows, and with as many tables as that needs.

    How often a pair at the threshold meets in one table is found by trial on random pairs of that
    width, with a fixed seed, so the same table gets the same lattice.
    """
    away = np.sqrt(max(2 - 2 * least, 1e-6) * min(1.0, 8 / width))
    joined, _, base, power = [step for step in STEPS if rows >= step[1]][-1]
    scale = float(away * np.clip(UNIT * (base / max(rows, 1)) ** power, 0.7, 4.0))
    trial = Lattice(tables=4, scale=scale, joined=joined)
    random, width = np.random.default_rng(width), max(width, 2)
    one, other = random.standard_normal((2, 1000, width))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    cosine = min(max(least, -1.0), 1.0)
    other = cosine * one + np.sqrt(1 - cosine * cosine) * other
    met = 0.0
    for table in range(trial.tables):
        a, b = trial.cells(one, table), trial.cells(other, table)
        met += ((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)).mean() / trial.tables
    tables = int(np.ceil(np.log(miss) / np.log1p(-min(max(met, 1e-3), 0.9999))))
    return Lattice(tables=max(tables, 2), scale=scale, joined=joined)


@lru_cache(maxsize=256)
def _frame(seed: int, table: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([seed, table, width])
    axes, _ = np.linalg.qr(random.standard_normal((max(width, 8), 8)))
    return axes[:width], random.random(8)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two ones of either sign, or eight halves with an even number of minus signs."""
    whole = np.zeros((112, 8))
    for row, ((i, j), (s, t)) in enumerate(product(combinations(range(8), 2), product((1, -1), repeat=2))):
        whole[row, [i, j]] = s, t
    halves = np.array([signs for signs in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in signs) % 2 == 0])
    return np.concatenate((whole, halves))


ROOTS = _roots()
ODD = np.random.default_rng(2024).integers(1 << 62, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def _folded(doubled: np.ndarray, part: int) -> np.ndarray:
    """A 64-bit sum of one lattice point, given as doubled coordinates, so that points can be joined by addition."""
    return (doubled.view(np.uint64) * (ODD * np.uint64(2 * part + 1) + np.uint64(part << 40))).sum(axis=-1, dtype=np.uint64)


def _mixed(key: np.ndarray, table: int, width: int) -> np.ndarray:
    """A 64-bit key of joined lattice points."""
    key = key + np.uint64(table * 8191 + width)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
    return (key ^ (key >> np.uint64(33))).view(np.int64)


def _even(points: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum."""
    whole = np.rint(points)
    away = points - whole
    worst = np.abs(away).argmax(axis=1)
    odd = np.flatnonzero(whole.sum(axis=1).astype(np.int64) & 1)
    whole[odd, worst[odd]] += np.where(away[odd, worst[odd]] >= 0, 1, -1)
    return whole


def nearest(points: np.ndarray) -> np.ndarray:
    """Nearest E8 point: the nearer of the even whole points and the even points moved by a half."""
    whole, half = _even(points), _even(points - 0.5) + 0.5
    closer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _units(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision, scaled first so that no square overflows."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _hash(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(1)))
            for width in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == width))
                units = _units(rows.column(1))
                cells = np.concatenate([lattice.cells(units, t) for t in range(lattice.tables)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
                yield pa.record_batch([rows.column(0), lists], ["point", "cells"])

    return run


def _compare(lattice: Lattice, least: float):
    def earlier(units: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray | int) -> np.ndarray:
        """Whether the pairs meet in a table before this one too, where they have been counted."""
        met = np.zeros(len(a), bool)
        if not table or not len(a):
            return met
        members, places = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = places[: len(a)], places[len(a) :]
        for t in range(table):
            cells = lattice.cells(units[members], t)
            met |= (cells[a] == cells[b][:, :1]).any(axis=1) | (cells[b] == cells[a][:, :1]).any(axis=1)
        return met

    def twice(units: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, cell: int) -> np.ndarray:
        """Whether a pair also meets in another cell of this table, which counts it: the one with the smaller key."""
        members, places = np.unique(np.concatenate((a, b)), return_inverse=True)
        cells = lattice.cells(units[members], table)
        a, b = places[: len(a)], places[len(a) :]
        best = np.full(len(a), np.iinfo(np.int64).max)
        for one, other in ((a, b), (b, a)):
            visits = (cells[one] == cells[other][:, :1]).any(axis=1)
            best = np.where(visits, np.minimum(best, cells[other][:, 0]), best)
        return best < cell

    def bucket(table: int, cell: int, node, units, copies, side) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(node, copies linked, smallest node joined here) of the points with links; side is 2 * block + visitor."""
        home, block = side % 2 == 0, side // 2
        residents = np.flatnonzero(home)
        if not len(residents):
            return None
        a_all, b_all = [], []
        mixed = len(np.unique(block)) > 1
        for low in range(0, len(residents), 256):
            left = residents[low : low + 256]
            near = units[left] @ units.T >= least
            i, b = np.nonzero(near)
            a = left[i]
            keep = (a != b) & (~home[b] | (a < b))
            if mixed:
                keep &= block[a] != block[b]
            a_all.append(a[keep])
            b_all.append(b[keep])
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        exact = np.einsum("ij,ij->i", units[a], units[b]) >= least
        a, b = a[exact], b[exact]
        if not len(a):
            return None
        fresh = ~earlier(units, a, b, table)
        a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        fresh = ~twice(units, a, b, table, cell)
        a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        root = np.arange(len(node))
        order = np.argsort(node)
        while True:
            before, best = root, node[root]
            low = np.minimum(best[a], best[b])
            np.minimum.at(best, a, low)
            np.minimum.at(best, b, low)
            root = order[np.searchsorted(node, best, sorter=order)]
            if (root == before).all():
                break
        at = np.flatnonzero(links)
        return node[at], links[at].astype(np.int64), node[root[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (table, cell, pair); a cell may go on in the next batch."""
        held: pa.Table | None = None

        def done(rows: pa.Table, last: bool):
            keys = np.stack([rows.column(name).to_numpy() for name in ("lattice_table", "cell", "pair")])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            cuts = [0, *change.tolist(), rows.num_rows]
            count = len(cuts) - 1 if last else len(cuts) - 2
            nodes, copies, sides = (rows.column(name).to_numpy() for name in ("node", "copies", "side"))
            out = []
            if count:
                vectors = rows.column("vector").combine_chunks()
                vectors = vectors if isinstance(vectors, pa.Array) else vectors.chunk(0)
                sizes = np.asarray(pc.list_value_length(vectors))
                for start, stop in zip(cuts[:count], cuts[1 : count + 1]):
                    if stop - start > 1 and (sizes[start:stop] == sizes[start]).all():
                        units = _units(vectors.slice(start, stop - start))
                        found = bucket(int(keys[0, start]), int(keys[1, start]), nodes[start:stop], units, copies[start:stop], sides[start:stop])
                        if found is not None:
                            out.append(found)
            return out, None if last else rows.slice(cuts[count])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            out, held = done(held, False)
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links", "root"])
        if held is not None and held.num_rows:
            out, _ = done(held, True)
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, lattice: Lattice | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links are cosines of ``least`` or more.

    Each vector stands in its own lattice cell of every table and visits neighbouring cells; the lattice
    is ``fitted`` to the table's size unless one is given, so that the number of unlike vectors that a
    vector meets hardly grows with the table. Only ids are dealt to cells, and those that meet nobody
    are dropped before their vectors are sent. Residents and visitors of a cell are compared in double precision, so no link below
    ``least`` is reported, and a pair that meets several times is counted at its first meeting, which
    both vectors determine. Equal vectors are one point with a number of copies, so they are never
    compared. A cell with more than ``BLOCK`` points is dealt out in pairs of blocks. No pairs leave
    a task: only link counts and the smallest node that a point is joined to.

    Vectors that are null, zero or hold a null or non-finite component link with nothing, and vectors
    of different lengths do not link. Rows without a vec_id are left out; repeated rows are vectors
    like any other and link with each other. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    kind = rows.schema["vector"].dataType.simpleString()
    good = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(good, F.col("vector")))
    points = rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    points = cut(points.select(F.monotonically_increasing_id().alias("point"), "vector", "node", "copies"))
    if lattice is None:
        size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
        lattice = fitted(size["n"], size["width"] or 1, least)
    step = lattice.seats
    hashed = points.select("point", "vector").mapInArrow(_hash(lattice), "point long, cells array<long>")
    seats = hashed.select("point", F.posexplode("cells").alias("at", "cell"))
    seats = cut(seats.select("point", F.floor(F.col("at") / step).cast("int").alias("lattice_table"), (F.col("at") % step != 0).cast("int").alias("visit"), "cell"))
    sizes = seats.groupBy("lattice_table", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("visit") == 0).alias("residents"))
    sizes = sizes.filter("n > 1 AND residents > 0").select("lattice_table", "cell", "n")
    seats = seats.join(sizes, ["lattice_table", "cell"]).join(points, "point")
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    seats = seats.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pair = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
    side = F.col("visit") + 2 * F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2))
    seats = seats.select("lattice_table", "cell", pair.alias("pair"), "node", "vector", "copies", side.cast("int").alias("side"))
    dealt = seats.repartition("lattice_table", "cell", "pair").sortWithinPartitions("lattice_table", "cell", "pair")
    found = cut(dealt.mapInArrow(_compare(lattice, least), "node long, links long, root long"))
    release(vectors.sparkSession)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst"))).toDF("node", "component_id")
    named = points.join(links, "node", "left").join(groups, "node", "left").select(
        F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "node").alias("component_id"),
    )
    result = rows.join(named, rows["vector"] == named["_vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
