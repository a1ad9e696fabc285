"""SimHash fingerprints linked exactly within a Hamming radius by covering masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ruleweave.llm.common import cut, free, ship
from ruleweave.llm.graph import components

BITS = 64
FULL = (1 << BITS) - 1
#: Buckets above this many fingerprints are covered anew on their free bits; three levels leave
#: fewer than 2**9 free patterns, so the last level can never exceed it.
BUCKET = 1024


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 (seed 42) of all 3-word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x09-\x0D, \x20 only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= 3:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - 2].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[2:].tolist())), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(text.as_py()) for text in batch.column(1)]
        signed = np.array(values, np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array(signed)], ["doc_id", "fp"])


def _marked_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (prints,) = _fingerprints(iter([batch]))
        yield pa.record_batch([batch.column(0), batch.column(2), prints.column(1)], ["doc_id", "text_key", "fp"])


def covering_masks(radius: int, free: int = FULL) -> list[int]:
    """Masks such that two words differing in at most ``radius`` of the ``free`` bits agree on one of them.

    Every free bit gets a nonzero vector of radius+1 bits; mask v holds the bits whose vector has an
    odd product with v. The vectors of ``radius`` differing bits leave some v orthogonal to all.
    """
    codes = (1 << (radius + 1)) - 1
    bits = [i for i in range(BITS) if free >> i & 1]
    return [
        sum(1 << bit for n, bit in enumerate(bits) if ((n % codes + 1) & v).bit_count() & 1) for v in range(1, codes + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _masks(level: int, radius: int) -> list[int]:
    """Masks of a level: those of the level above, each covered anew on the bits that it leaves free."""
    masks = covering_masks(radius)
    for _ in range(level):
        masks = [mask | more for mask in masks for more in covering_masks(radius, FULL & ~mask)]
    return masks


def _cells(masks: list[int], child: Column | None, fan: int) -> Column:
    """One (table, key) per mask, or per child mask of the row's own table."""
    table = F.array(*[F.lit(_signed(mask)) for mask in masks])
    mine = table if child is None else F.slice(table, child * fan + 1, fan)
    base = F.lit(0) if child is None else child * fan
    return F.transform(mine, lambda mask, i: F.struct((base + i).cast("int").alias("table"), F.col("fp").bitwiseAND(mask).alias("key")))


def _linked(fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Star edges of the components that Hamming links form among the members of one bucket."""
    if len(fps) == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= radius
        return ([int(nodes[0])], [int(nodes[1])]) if near else ([], [])
    order = np.argsort(nodes, kind="stable")
    fps, nodes = fps[order], nodes[order]
    left = np.ones(len(fps), bool)
    source, target = [], []
    for at in range(len(fps)):
        if not left[at]:
            continue
        left[at] = False
        front = [at]
        while front:
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[(np.bitwise_count(fps[rest][:, None] ^ fps[front[:64]][None, :]) <= radius).any(axis=1)]
            left[near] = False
            source += [int(nodes[at])] * len(near)
            target += nodes[near].tolist()
            front = front[64:] + near.tolist()
    return source, target


def _link_buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (table, key); a bucket may go on in the next batch."""
        held = None
        for columns in _with_end(batches):
            last = columns is None
            if last:
                columns = held
            elif held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            if columns is None:
                return
            table, key, fp, node = columns
            edge = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            cuts = [0, *edge.tolist(), len(table)]
            done = len(cuts) - 1 if last else len(cuts) - 2
            source: list[int] = []
            target: list[int] = []
            for start, stop in zip(cuts[:done], cuts[1 : done + 1]):
                if stop - start > 1:
                    a, b = _linked(fp[start:stop], node[start:stop], radius)
                    source += a
                    target += b
            held = None if last else [column[cuts[done] :] for column in columns]
            if source:
                yield pa.record_batch([pa.array(source, pa.int64()), pa.array(target, pa.int64())], ["src", "dst"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray] | None]:
    for batch in batches:
        if batch.num_rows:
            table, key, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            yield [table, key, fp.astype(np.int64).view(np.uint64), node]
    yield None


def links(points: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (src, dst) that connect whatever is reachable by links of at most ``radius`` differing bits.

    ``points``: (node long, fp long), fingerprints distinct. Every pair within the radius shares a
    bucket of some table. Bucket sizes are counted with partial aggregates first; a bucket of more
    than ``BUCKET`` fingerprints is not compared but covered again on the bits that its mask leaves
    free, at most twice, so no task holds an unbounded bucket and none is skipped.
    """
    fan = (1 << (radius + 1)) - 1
    rows, found, parent = points.select("node", "fp"), [], None
    for level in range(3):
        rows = rows.select("node", "fp", F.explode(_cells(_masks(level, radius), parent, fan)).alias("c")).select("node", "fp", "c.table", "c.key")
        sizes = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = rows.join(sizes, ["table", "key"])
        if level < 2:
            rows = cut(rows)
        small = rows.filter(F.col("n") <= BUCKET) if level < 2 else rows
        sorted_ = small.select("table", "key", "fp", "node").repartition("table", "key").sortWithinPartitions("table", "key")
        found.append(sorted_.mapInArrow(_link_buckets(radius), "src long, dst long"))
        if level < 2:
            rows = rows.filter(F.col("n") > BUCKET).select("node", "fp", "table")
            if rows.isEmpty():
                break
            parent = F.col("table")
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long), fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest doc_id that links reach. A null text counts as empty, and an empty text has fingerprint
    zero, which links like any other. Rows without a doc_id are left out; repeated rows stay and
    share their component. Other columns of ``docs`` are ignored. The text is read in one narrow
    pass; equal fingerprints are one point of the search, so exact copies are never compared.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    prints = cut(texts.mapInArrow(_fingerprints, "doc_id long, fp long"))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(points, radius))
    named = points.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", "fp", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of each near-duplicate group, columns unchanged.

    The row with the smallest doc_id stays; rows without one come after those with one, and of several
    rows with that doc_id the one with the smaller hash of its text, once. All rows are compared, those
    without a doc_id and those that repeat one too; a null or empty text is one of the texts with
    fingerprint zero. An empty table gives an empty one.

    Only hashes are shuffled to find the groups. The rows themselves cross one shuffle, in which equal
    (doc_id, text) are brought down to one before they leave their task.
    """
    ship(docs.sparkSession)
    key, mark = free(docs, "doc_key", "text_key")
    text = F.col("text").cast("string")
    keyed = docs.withColumns({key: F.col("doc_id").cast("long"), mark: F.xxhash64(F.coalesce(text, F.lit("")))})
    texts = keyed.select(key, mark, text.alias("_text")).toDF("doc_id", "text_key", "text")
    prints = cut(texts.select("doc_id", "text", "text_key").mapInArrow(_marked_fingerprints, "doc_id long, text_key long, fp long").distinct())
    points = prints.select(F.col("fp").alias("node"), "fp").distinct()
    found = components(links(cut(points), radius))
    grouped = prints.join(found, prints["fp"] == found["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    kept = grouped.groupBy("component").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_text_key"))
    alone = keyed.dropDuplicates([key, mark])
    return alone.join(kept, alone[key].eqNullSafe(kept["_id"]) & (alone[mark] == kept["_text_key"]), "left_semi").select(*[alone[c] for c in docs.columns])
