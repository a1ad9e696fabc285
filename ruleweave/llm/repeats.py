"""Removal of repeated 50-byte strings by a hash-compared suffix sort of sampled places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ruleweave.llm.common import by_rows, cut, release, ship

SPAN, ANCHOR = 50, 20
REACH = SPAN - ANCHOR + 1
#: Bytes that are hashed at a time; longer documents are cut into overlapping pieces.
RUN = 1 << 19
#: Contexts of one anchor above which they are dealt out by window instead of by anchor.
HOT = 4096
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Columns of the packed rows by kind, after the documents and their row counts.
RANGES, ANCHORS, PLACES, CONTEXTS = 1, 0, 2, 3
FORMATS = {
    RANGES: (("at", "<u4"), ("end", "<u4")),
    ANCHORS: (("key", "u6"), ("context", "u6"), ("at", "<u4"), ("size", "u1")),
    PLACES: (("key", "u6"), ("at", "<u4"), ("size", "u1"), ("hot", "u1")),
    CONTEXTS: (("key", "u6"), ("at", "<u4"), ("size", "u1")),
}
SCHEMA = "kind int, bucket int, body binary"


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(size - 1, base, U))))
        down = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(size - 1, pow(base, -1, 1 << 64), U))))
    return up, down


class Hashes:
    """Prefix polynomial hashes of a byte array modulo 2**64; any substring's hash is one subtraction and product."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int) -> None:
        size = max(len(data) + 1, 2 * RUN + SPAN)
        if base not in self._tables or len(self._tables[base][0]) < size:
            self._tables[base] = _powers(base, size)
        up, self.down = self._tables[base]
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def short(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits, which is what is packed."""
    return x >> U(16)


def _to_bytes(values: np.ndarray, dtype: str) -> bytes:
    if dtype == "u6":
        return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return values.astype(dtype).tobytes()


def _from_bytes(body: bytes, dtype: str, count: int, at: int) -> np.ndarray:
    if dtype == "u6":
        wide = np.zeros((count, 8), np.uint8)
        wide[:, :6] = np.frombuffer(body, np.uint8, count * 6, at).reshape(-1, 6)
        return wide.view("<u8").ravel()
    return np.frombuffer(body, dtype, count, at)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, key, context) of the runs of windows that share an anchor, for texts laid end to end.

    A window's anchor is its least-hashed ANCHOR bytes, the leftmost if equal, so equal windows have
    equal anchors at equal places. A run's context is all that its windows cover, hashed with the place
    of the anchor in it.
    """
    size = len(data)
    if size < SPAN:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U))
    first = Hashes(data, BASES[0])
    key = mixed(first.all(ANCHOR))
    shift = U(size.bit_length())
    order = (key >> shift << shift) | np.arange(len(key), dtype=U)
    least = order
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: size - SPAN + 1], least[REACH - 16 :][: size - SPAN + 1])
    place = (least & ((U(1) << shift) - U(1))).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    blocked = np.zeros(size + 1, np.int32)
    np.add.at(blocked, np.maximum(starts, ends - SPAN + 1), 1)
    np.add.at(blocked, ends, -1)
    valid = np.flatnonzero(np.cumsum(blocked[: size - SPAN + 1]) == 0)
    if not len(valid):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U))
    change = np.flatnonzero((np.diff(valid) != 1) | (np.diff(place[valid]) != 0))
    a, b = valid[np.concatenate(([0], change + 1))], valid[np.concatenate((change, [len(valid) - 1]))]
    spot = place[a]
    context = mixed(Hashes(data, BASES[1]).of(a, b + SPAN) + mixed(((b - a) * 256 + spot - a).astype(U)))
    return a, b, short(key[spot]), short(context)


class Rows:
    """Columns with the documents that they belong to, packed into bytes with each document named once."""

    def __init__(self, doc: np.ndarray, text: np.ndarray, **columns: np.ndarray) -> None:
        self.doc, self.text, self.columns = doc, text, columns

    def __len__(self) -> int:
        return len(self.doc)

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.doc[at], self.text[at], **{k: v[at] for k, v in self.columns.items()})

    def pack(self, kind: int) -> bytes:
        change = np.flatnonzero((np.diff(self.doc) != 0) | (np.diff(self.text) != 0)) + 1
        heads = np.concatenate(([0], change)) if len(self) else np.zeros(0, np.int64)
        runs = np.diff(np.concatenate((heads, [len(self)])))
        parts = [(np.array([len(heads), len(self)]), "<u4"), (self.doc[heads], "<i8"), (self.text[heads], "<i8"), (runs, "<u4")]
        parts += [(self.columns[name], dtype) for name, dtype in FORMATS[kind]]
        return b"".join(_to_bytes(*part) for part in parts)

    @classmethod
    def unpack(cls, kind: int, bodies: list[bytes]) -> tuple[Rows, list[bytes]]:
        """All rows of the bodies, and what follows them in each."""
        docs, texts, rest = [], [], []
        columns: dict[str, list[np.ndarray]] = {name: [] for name, _ in FORMATS[kind]}
        for body in bodies:
            heads, size = np.frombuffer(body, "<u4", 2).tolist()
            at = 8

            def read(dtype: str, count: int) -> np.ndarray:
                nonlocal at
                values = _from_bytes(body, dtype, count, at)
                at += count * int(dtype[-1])
                return values

            doc, text, runs = read("<i8", heads), read("<i8", heads), read("<u4", heads)
            docs.append(np.repeat(doc, runs))
            texts.append(np.repeat(text, runs))
            for name, dtype in FORMATS[kind]:
                columns[name].append(read(dtype, size))
            rest.append(body[at:])
        join = lambda parts, dtype: np.concatenate(parts) if parts else np.zeros(0, dtype)
        return cls(join(docs, "<i8"), join(texts, "<i8"), **{name: join(columns[name], dtype) for name, dtype in FORMATS[kind]}), rest


def _send(kind: int, rows: Rows, bucket: np.ndarray, tails: np.ndarray | None = None) -> pa.RecordBatch | None:
    """One packed row per bucket; rows keep their order. ``tails``: bytes of each row's context, laid end to end."""
    if not len(rows):
        return None
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows.take(order), bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    if tails is not None:
        sizes = rows.size.astype(np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = sizes
        starts = (np.cumsum(back) - back)[order]
        tails = tails[spread(starts, sizes)]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
    bodies = []
    for a, b in zip(cuts, cuts[1:]):
        body = rows.take(slice(a, b)).pack(kind)
        bodies.append(body if tails is None else body + tails[bounds[a] : bounds[b]].tobytes())
    return pa.record_batch([pa.array([kind] * len(bodies), pa.int32()), pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(bodies, pa.binary())], ["kind", "bucket", "body"])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each of the runs, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _ranges(doc: np.ndarray, text: np.ndarray, at: np.ndarray, end: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """Overlapping ranges of a document joined, packed by the document's bucket."""
    if not len(doc):
        return None
    order = np.lexsort((at, text, doc))
    doc, text, at, end = doc[order], text[order], at[order].astype(np.int64), end[order].astype(np.int64)
    new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(text) != 0)))
    number = np.cumsum(new)
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + number * wide)
    heads = np.flatnonzero(np.concatenate(([True], at[1:] + number[1:] * wide > reach[:-1])))
    stops = reach[np.concatenate((heads[1:] - 1, [len(at) - 1]))] - number[heads] * wide
    rows = Rows(doc[heads], text[heads], at=at[heads], end=stops)
    return _send(RANGES, rows, (rows.doc ^ rows.text) % buckets)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts laid end to end, and where each ends."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if values.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _find(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors by bucket of their key, without those that an earlier document of the batch has alike."""
        for batch in by_rows(batches, "text", 8 << 20):
            doc, text = (batch.column(i).to_numpy() for i in (0, 1))
            data, ends = _bytes(batch.column(2))
            starts = np.concatenate(([0], ends[:-1]))
            parts, row = [], 0
            while row < len(ends):
                if ends[row] - starts[row] > RUN:
                    for low in range(int(starts[row]), int(ends[row]) - SPAN + 1, RUN):
                        high = min(int(ends[row]), low + RUN + SPAN - 1)
                        found = anchors(data[low:high], np.array([high - low]))
                        parts.append((np.full(len(found[0]), row), found[0] + low - starts[row], *found[1:], found[1] - found[0] + SPAN))
                    row += 1
                    continue
                low, stop = int(starts[row]), int(np.searchsorted(ends, starts[row] + RUN, side="right"))
                stop = max(stop, row + 1)
                found = anchors(data[low : ends[stop - 1]], ends[row:stop] - low)
                owner = row + np.searchsorted(ends[row:stop] - low, found[0], side="right")
                parts.append((owner, found[0] + low - starts[owner], *found[1:], found[1] - found[0] + SPAN))
                row = stop
            if not parts:
                continue
            owner, at, _, key, context, size = (np.concatenate(column) for column in zip(*parts))
            if not len(owner):
                continue
            ids = doc[owner]
            order = np.argsort(key ^ (context * U(BASES[0])), kind="stable")
            same = np.concatenate(([False], (np.diff(key[order]) == 0) & (np.diff(context[order]) == 0)))
            heads = np.flatnonzero(~same)
            least = np.minimum.reduceat(ids[order], heads)
            later = np.empty(len(ids), bool)
            later[order] = ids[order] > np.repeat(least, np.diff(np.concatenate((heads, [len(ids)]))))
            out = _ranges(ids[later], text[owner[later]], at[later], at[later] + size[later], buckets)
            if out is not None:
                yield out
            keep = np.flatnonzero(~later)
            rows = Rows(ids[keep], text[owner[keep]], key=key[keep], context=context[keep], at=at[keep], size=size[keep])
            out = _send(ANCHORS, rows, (key[keep] % U(buckets)).astype(np.int64))
            if out is not None:
                yield out

    return run


def _match(buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts that an earlier document has alike are ranges; anchors in unlike contexts are looked at again."""
        bodies: list[bytes] = []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if (kinds == RANGES).any():
                yield batch.filter(pa.array(kinds == RANGES))
            bodies += batch.column(2).filter(pa.array(kinds == ANCHORS)).to_pylist()
        if not bodies:
            return
        rows, _ = Rows.unpack(ANCHORS, bodies)
        bodies.clear()
        rows = rows.take(np.lexsort((rows.context, rows.key)))
        new_key = np.concatenate(([True], np.diff(rows.key) != 0))
        new = new_key | np.concatenate(([True], np.diff(rows.context) != 0))
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(rows.doc, heads)
        later = rows.doc > least[group]
        out = _ranges(rows.doc[later], rows.text[later], rows.at[later], rows.at[later].astype(np.int64) + rows.size[later], buckets)
        if out is not None:
            yield out
        tops = np.flatnonzero(new_key[heads])
        counts = np.diff(np.concatenate((tops, [len(heads)])))
        unlike = (counts > 1) & (np.maximum.reduceat(least, tops) > np.minimum.reduceat(least, tops))
        key = np.repeat(np.arange(len(tops)), counts)[group]
        at = np.flatnonzero(~later & unlike[key])
        found = rows.take(at)
        found = Rows(found.doc, found.text, key=found.key, at=found.at, size=found.size, hot=(counts[key[at]] > most))
        found = found.take(np.lexsort((found.at, found.text, found.doc)))
        out = _send(PLACES, found, (found.doc ^ found.text) % buckets)
        if out is not None:
            yield out

    return run


def _owners(rows: Rows, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Row of the table for each packed row; equal documents share one."""
    index = {pair: at for at, pair in reversed(list(enumerate(zip(doc.tolist(), text.tolist()))))}
    change = np.flatnonzero(np.concatenate(([True], (np.diff(rows.doc) != 0) | (np.diff(rows.text) != 0))))
    owners = np.array([index[pair] for pair in zip(rows.doc[change].tolist(), rows.text[change].tolist())], np.int64)
    return np.repeat(owners, np.diff(np.concatenate((change, [len(rows)]))))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    for batch in batches:
        bodies = pc.fill_null(batch.column(3).cast(pa.large_binary()), b"").to_pylist()
        packed = pa.array([pa.compress(body, codec="zstd", asbytes=True) for body in bodies], pa.binary())
        sizes = pa.array([len(body) for body in bodies], pa.int64())
        yield pa.record_batch([*batch.columns[:3], sizes, packed], ["doc", "text_key", "bucket", "size", "body"])


def _table(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, text keys, and the bytes of all texts laid end to end with where each ends."""
    sizes = batch["size"].to_numpy()
    bodies = [pa.decompress(body, size, "zstd", asbytes=True) for body, size in zip(batch["body"].to_pylist(), sizes.tolist())]
    return batch["doc"].to_numpy(), batch["text_key"].to_numpy(), np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes)


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows that start at ``a`` and ``b`` hold the same bytes."""
    whole = np.full(len(a), SPAN)
    return (data[spread(a, whole)].reshape(-1, SPAN) == data[spread(b, whole)].reshape(-1, SPAN)).all(axis=1)


def _fetch(buckets: int):
    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        """The bytes of the contexts, by bucket of their anchor; of hot anchors, of each window, earliest only."""
        out = []
        if docs.num_rows and places.num_rows:
            rows, _ = Rows.unpack(PLACES, places["body"].to_pylist())
            doc, text, data, ends = _table(docs)
            starts = np.concatenate(([0], ends[:-1]))
            begin = starts[_owners(rows, doc, text)] + rows.at.astype(np.int64)
            hot = rows.hot != 0
            cool = np.flatnonzero(~hot)
            some = rows.take(cool)
            tails = data[spread(begin[cool], some.size.astype(np.int64))]
            out.append(_send(CONTEXTS, Rows(some.doc, some.text, key=some.key, at=some.at, size=some.size), (some.key % U(buckets)).astype(np.int64), tails))
            if hot.any():
                many = np.flatnonzero(hot)
                windows = rows.size[many].astype(np.int64) - SPAN + 1
                at = spread(begin[many], windows)
                here = np.repeat(many, windows)
                key = np.empty(len(at), U)
                for part in range(0, len(at), RUN):  # the windows of a stretch, hashed over their own bytes
                    piece = at[part : part + RUN]
                    body = data[spread(piece, np.full(len(piece), SPAN))].reshape(-1, SPAN).astype(U) + U(1)
                    key[part : part + RUN] = short(mixed((body * _powers(BASES[1], SPAN)[0]).sum(axis=1, dtype=U)))
                order = np.lexsort((rows.doc[here], key))
                key, at, here = key[order], at[order], here[order]
                heads = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
                head = np.repeat(heads, np.diff(np.concatenate((heads, [len(key)]))))
                shift = at - begin[here] + rows.at[here]
                later = rows.doc[here] > rows.doc[here[head]]
                alike = np.flatnonzero(later)
                for part in range(0, len(alike), RUN // 8):  # a window goes only if its bytes are those of the first of its hash
                    piece = alike[part : part + RUN // 8]
                    later[piece] = _same(data, at[piece], at[head[piece]])
                out.append(_ranges(rows.doc[here[later]], rows.text[here[later]], shift[later], shift[later] + SPAN, buckets))
                keep = np.flatnonzero(~later)
                keep = keep[np.lexsort((shift[keep], rows.text[here[keep]], rows.doc[here[keep]]))]
                first = Rows(rows.doc[here[keep]], rows.text[here[keep]], key=key[keep], at=shift[keep], size=np.full(len(keep), SPAN))
                tails = data[spread(at[keep], np.full(len(keep), SPAN))]
                out.append(_send(CONTEXTS, first, (first.key % U(buckets)).astype(np.int64), tails))
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
        return pa.Table.from_batches([part for part in out if part is not None], schema)

    return run


class Suffixes:
    """Suffixes of a byte array, sorted group by group on their first SPAN bytes.

    Two suffixes are compared by their common extension, which a binary search over prefix hashes
    finds, and by the byte after it. Ties on the first eight bytes are sorted by bottom-up merging, in
    which every suffix finds its place in the neighbouring run by binary search; all of a round's
    comparisons are done together.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> None:
        self.data = np.concatenate((data, np.zeros(SPAN, np.uint8)))
        self.hashes = Hashes(self.data, BASES[0])
        self.starts = starts
        head = np.zeros(len(starts), U)
        for i in range(8):
            head = head << U(8) | self.data[starts + i].astype(U)
        order = np.lexsort((head, group))
        tie = np.concatenate(([True], (np.diff(group[order]) != 0) | (np.diff(head[order]) != 0)))
        first = np.flatnonzero(tie)
        size = np.diff(np.concatenate((first, [len(order)])))
        self.order, self.base, self.most = order, np.repeat(first, size), np.repeat(size, size)
        self._merge()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes, SPAN at most."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), SPAN)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.hashes.of(a, a + middle) == self.hashes.of(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
        length = self.common(a, b)
        whole = length == SPAN
        return np.where(whole, equal, self.data[a + length] < self.data[b + np.minimum(length, SPAN - 1)])

    def _merge(self) -> None:
        width = 1
        while len(self.order) and (self.most > width).any():
            live = np.flatnonzero(self.most > width)
            base, most = self.base[live], self.most[live]
            own = live - base
            run = own // width
            left = run % 2 == 0
            other = (run ^ 1) * width
            low = base + np.minimum(other, most)
            high = base + np.minimum(other + width, most)
            bottom = low.copy()
            mine = self.starts[self.order[live]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                theirs = self.starts[self.order[middle]]
                # equal suffixes of the left run come first
                less = self.before(theirs, mine[open_], False)
                right = np.flatnonzero(~left[open_])
                if len(right):
                    less[right] |= self.common(theirs[right], mine[open_][right]) == SPAN
                low[open_], high[open_] = np.where(less, middle + 1, low[open_]), np.where(less, high[open_], middle)
            place = base + (run // 2) * 2 * width + own % width + (low - bottom)
            merged = self.order.copy()
            merged[place] = self.order[live]
            self.order = merged
            width *= 2

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and which of them differ from the one before; equal hashes are verified byte by byte."""
        at = self.starts[self.order]
        new = np.ones(len(at), bool)
        near = np.flatnonzero(np.diff(self.base) == 0) + 1
        for low in range(0, len(near), 1 << 16):
            part = near[low : low + (1 << 16)]
            alike = self.hashes.of(at[part], at[part] + SPAN) == self.hashes.of(at[part - 1], at[part - 1] + SPAN)
            part = part[alike]
            a, b = (self.data[spread(at[p], np.full(len(p), SPAN))].reshape(-1, SPAN) for p in (part, part - 1))
            new[part[(a == b).all(axis=1)]] = False
        return self.order, new


def _sort(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of contexts that an earlier document has too, found by sorting their suffixes."""
        bodies: list[bytes] = []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if (kinds == RANGES).any():
                yield batch.filter(pa.array(kinds == RANGES))
            bodies += batch.column(2).filter(pa.array(kinds == CONTEXTS)).to_pylist()
        if not bodies:
            return
        rows, tails = Rows.unpack(CONTEXTS, bodies)
        data = np.frombuffer(b"".join(tails), np.uint8)
        sizes = rows.size.astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(rows.key, kind="stable")
        bounds = np.flatnonzero(np.concatenate(([True], np.diff(rows.key[order]) != 0)))
        weight = np.cumsum(sizes[order])
        part = np.searchsorted(np.arange(1, weight[-1] // (2 << 20) + 2) * (2 << 20), weight[bounds])
        cuts = [*bounds[np.concatenate(([True], np.diff(part) != 0))].tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:]):  # whole groups, about two megabytes at a time
            some = order[a:b]
            own = data[spread(begin[some], sizes[some])]
            heads = np.cumsum(sizes[some]) - sizes[some]
            windows = sizes[some] - SPAN + 1
            starts = spread(heads, windows)
            owner = np.repeat(some, windows)
            ranked, new = Suffixes(own, starts, rows.key[owner]).runs()
            owner, shift = owner[ranked], (starts - np.repeat(heads, windows))[ranked]
            first = np.flatnonzero(new)
            least = np.minimum.reduceat(rows.doc[owner], first)
            later = rows.doc[owner] > np.repeat(least, np.diff(np.concatenate((first, [len(owner)]))))
            owner, at = owner[later], rows.at[owner[later]].astype(np.int64) + shift[later]
            out = _ranges(rows.doc[owner], rows.text[owner], at, at + SPAN, buckets)
            if out is not None:
                yield out

    return run


def _apply(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    """Each document's removed runs and what is left of it."""
    doc, text, data, ends = _table(docs)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    by: dict[tuple[int, int], tuple[int, int]] = {}
    at = end = np.zeros(0, np.int64)
    if ranges.num_rows:
        rows, _ = Rows.unpack(RANGES, ranges["body"].to_pylist())
        order = np.lexsort((rows.at, rows.text, rows.doc))
        rows = rows.take(order)
        at, end = rows.at.astype(np.int64), rows.end.astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], (np.diff(rows.doc) != 0) | (np.diff(rows.text) != 0))))
        stops = np.concatenate((heads[1:], [len(at)]))
        by = dict(zip(zip(rows.doc[heads].tolist(), rows.text[heads].tolist()), zip(heads.tolist(), stops.tolist())))
    kept, spans = [], []
    raw = data.tobytes()
    for row, pair in enumerate(zip(doc.tolist(), text.tolist())):
        a, b = by.get(pair, (0, 0))
        body = raw[starts[row] : ends[row]]
        own: list[list[int]] = []
        for low, high in zip(at[a:b].tolist(), end[a:b].tolist()):
            if own and low <= own[-1][1]:
                own[-1][1] = max(own[-1][1], high)
            else:
                own.append([low, high])
        edges = [0, *(x for span in own for x in span), len(body)]
        kept.append(b"".join(body[p:q] for p, q in zip(edges[::2], edges[1::2])) if own else body)
        spans.append([{"start": p, "end": q} for p, q in own])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": pa.array(doc), "n_bytes": pa.array(ends - starts), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind)})


def without_repeats(docs: DataFrame, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, kept (binary) and spans (start, end in bytes) for every row of ``docs``.

    Removes each byte that is covered by a 50-byte string which also starts in a document with a
    smaller doc_id. A null text counts as empty; rows without a doc_id are left out; rows that repeat
    a doc_id do not remove each other's bytes; other columns are ignored; an empty table gives an
    empty table.

    Equal strings have equal anchors (the least-hashed bytes inside), about one in sixteen places, so
    only anchors are shuffled, packed by bucket, after each batch has settled those that its own
    documents share. Anchors in like contexts (96 bits of hashes) settle all their windows at once.
    Where an anchor has unlike contexts, near the ends of a repeat, the contexts' bytes are fetched
    and their suffixes sorted. ``buckets`` is twice spark.sql.shuffle.partitions by default and
    bounds what a task holds: a bucket of texts, anchors or contexts. An anchor with more than ``hot``
    unlike contexts is dealt out by window, the earliest of each bucket of texts only; its later windows
    are compared with that one byte by byte, and those that only share its hash are sorted too.
    """
    spark = ship(docs.sparkSession)
    count = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = rows.mapInArrow(_find(count), SCHEMA).repartition("kind", "bucket")
    matched = cut(found.mapInArrow(_match(count, hot), SCHEMA))
    del found
    release(spark)
    bucket = F.pmod(F.col("doc").bitwiseXOR(F.col("text_key")), F.lit(count)).cast("int").alias("bucket")
    stored = rows.select("doc", "text_key", bucket, "text").mapInArrow(_squeeze, "doc long, text_key long, bucket int, size long, body binary")

    def meet(packed: DataFrame, work, schema: str) -> DataFrame:
        return stored.groupBy("bucket").cogroup(packed.groupBy("bucket")).applyInArrow(work, schema)

    fetched = meet(matched.filter(F.col("kind") == PLACES), _fetch(count), SCHEMA)
    sorted_ = cut(fetched.repartition("kind", "bucket").mapInArrow(_sort(count), SCHEMA))
    del fetched
    release(spark)
    ranges = matched.filter(F.col("kind") == RANGES).union(sorted_)
    return meet(ranges, _apply, "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")


def digest(result: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
