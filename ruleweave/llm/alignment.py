"""Alignment of two tokenizers over a corpus, every distinct text tokenised once."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ruleweave.llm.common import by_rows, ship
from ruleweave.session import shared_folder

#: Bytes of text that are aligned together; their distinct pairs are counted and looked up together.
BLOCK = 4 << 20
#: Words that are encoded at a time, words that a worker remembers before it starts anew, and the longest that it does.
WORDS, REMEMBERED, LONGEST = 10_000, 600_000, 48


def byte_symbols() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, all other bytes for those from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    return {chr(byte): byte for byte in shown} | {chr(256 + at): byte for at, byte in enumerate(hidden)}


def _joined(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls, one after another."""
    if not len(column):
        return np.zeros(0, np.uint8)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)


def _cut(body: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column of the stretches of ``body`` between ``bounds``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])


@dataclass
class Aligned:
    """Texts one after another: tokens of both sides, linked pairs (a << 32 | b) in order, groups as bytes
    that all end with a semicolon, and whether both sides gave the text's own bytes; all zero if not."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    groups: pa.Array
    good: np.ndarray

    def take(self, at: np.ndarray) -> Aligned:
        starts = np.cumsum(self.n_links) - self.n_links
        counts = self.n_links[at]
        link = np.repeat(starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return Aligned(self.n_a[at], self.n_b[at], counts, self.links[link], self.groups.take(pa.array(at)), self.good[at])


def nothing() -> Aligned:
    none = np.zeros(0, np.int64)
    return Aligned(none, none, none, none, pa.array([], pa.large_binary()), np.zeros(0, bool))


def together(parts: list[Aligned]) -> Aligned:
    arrays = [np.concatenate([getattr(part, f.name) for part in parts]) for f in fields(Aligned)[:4]]
    return Aligned(*arrays, pa.concat_arrays([part.groups for part in parts]), np.concatenate([part.good for part in parts]))


class Pair:
    """The two tokenizers, the bytes of each of their ids, and how ids are written in groups."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        symbols, words = byte_symbols(), self.a.get_vocab()
        left = [b""] * (max(words.values()) + 1)
        for word, at in words.items():
            left[at] = bytes(symbols[c] for c in word) if all(c in symbols for c in word) else word.encode()
        pieces = [self.b.id_to_piece(at) for at in range(self.b.get_piece_size())]
        right = [bytes([int(p[3:5], 16)]) if self.b.is_byte(at) else p.replace("▁", " ").encode() for at, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = pa.array(left, pa.binary()), pa.array(right, pa.binary())
        # an id of a with a comma or, as the last of its group, a bar; one of b with a comma or a semicolon
        self.written = pa.array([f"{at}{end}".encode() for side, ends in ((left, ",|"), (right, ",;")) for end in ends for at in range(len(side))], pa.binary())
        self.n = len(left), len(right)
        self.known, self.held = pa.array([], pa.string()), nothing()

    def encode(self, texts: pa.Array) -> Aligned:
        """Alignment of texts that begin with a space, which the piece model adds by itself."""
        parts = [self._some(texts.slice(low, WORDS)) for low in range(0, len(texts), WORDS)]
        return together(parts) if parts else nothing()

    def words(self, texts: pa.Array) -> Aligned:
        """The same for distinct words, of which those seen lately are remembered."""
        texts = texts.cast(pa.string()) if pa.types.is_large_string(texts.type) and pc.sum(pc.binary_length(texts)).as_py() < 1 << 31 else texts
        if len(self.known) > REMEMBERED or texts.type != self.known.type:
            self.known, self.held = pa.array([], texts.type), nothing()
        place = pc.fill_null(pc.index_in(texts, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = place < 0
        fresh = self.encode(texts.filter(pa.array(new)))
        place[new] = len(self.known) + np.arange(int(new.sum()))
        held = together([self.held, fresh])
        short = np.flatnonzero(pc.less_equal(pc.binary_length(texts), LONGEST).to_numpy(zero_copy_only=False)[new])
        if len(short):
            self.known = pa.concat_arrays([self.known, texts.filter(pa.array(new)).take(pa.array(short))])
            self.held = together([self.held, fresh.take(short)])
        return held.take(place)

    def _some(self, texts: pa.Array) -> Aligned:
        plain = texts.to_pylist()
        a, n_a = _flat([found.ids for found in self.a.encode_batch_fast(plain, add_special_tokens=False)])
        b, n_b = _flat(self.b.encode([text[1:] for text in plain], num_threads=1))
        body = np.frombuffer("".join(plain).encode(), np.uint8)
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        good = np.ones(len(plain), bool)
        for ids, counts, table in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            tokens = table.take(pa.array(ids))
            lengths = pc.binary_length(tokens).to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(plain)), counts)
            fits = np.bincount(owner, lengths, len(plain)).astype(np.int64) == sizes
            good &= fits
            same = _joined(tokens.filter(pa.array(fits[owner]))) == body[np.repeat(fits, sizes)]
            good[np.repeat(np.arange(len(plain)), np.where(fits, sizes, 0))[~same]] = False
        return self._align(a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], np.where(good, n_a, 0), np.where(good, n_b, 0), np.where(good, sizes, 0), good)

    def _align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> Aligned:
        """No token is empty, so an offset ends one token of each side at most; both sides end with every text."""
        a_ends = np.cumsum(pc.binary_length(self.a_bytes).to_numpy().astype(np.int64)[a])
        b_ends = np.cumsum(pc.binary_length(self.b_bytes).to_numpy().astype(np.int64)[b])
        both, i, j = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        text_ends = np.cumsum(sizes)
        n_links = np.diff(np.searchsorted(both, text_ends, side="right"), prepend=0)
        # groups in writing: those of a, then those of b; a token stands behind all of the other side's that come before it
        a_group, b_group = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        b_before, a_upto = np.concatenate(([0], j + 1)), i + 1
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_before[a_group]] = a + np.where(np.isin(np.arange(len(a)), i, assume_unique=True), self.n[0], 0)
        order[np.arange(len(b)) + a_upto[b_group]] = 2 * self.n[0] + b + np.where(np.isin(np.arange(len(b)), j, assume_unique=True), self.n[1], 0)
        written = self.written.take(pa.array(order))
        reached = np.concatenate(([0], np.cumsum(pc.binary_length(written).to_numpy().astype(np.int64))))
        groups = _cut(_joined(written), np.concatenate(([0], reached[np.cumsum(n_a + n_b)])))
        return Aligned(n_a, n_b, n_links, (a[i] << 32) | b[j], groups, good)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


_PAIRS_OF: dict[tuple[str, str], Pair] = {}


def word_starts(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where texts may be cut without a change of tokens: at a space that follows no white space.

    The byte side's words take at most one space and only in front, and no piece of the other side has
    a space after anything else. A last byte that white space beyond ASCII may end cuts nothing.
    """
    low, two, three = (np.concatenate((np.full(k, 0x20, np.uint8), body[:-k] if k < len(body) else body[:0]))[: len(body)] for k in (1, 2, 3))
    broad = ((two == 0xC2) & ((low == 0x85) | (low == 0xA0))) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81)))
    broad |= ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))
    cut = (body == 0x20) & (low > 0x20) & (low != 0x7F) & ~broad
    cut[starts[starts < len(body)]] = True
    return np.flatnonzero(cut)


def _strings(body: np.ndarray, bounds: np.ndarray) -> pa.Array:
    kind = pa.large_string() if bounds[-1] >= 1 << 31 else pa.string()
    offsets = bounds.astype(np.int64 if kind == pa.large_string() else np.int32)
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])


def align_block(pair: Pair, texts: pa.Array, times: np.ndarray) -> tuple[dict[str, np.ndarray | list], dict[str, np.ndarray]]:
    """The measures of each text and its words' numbers; and the block's pairs: counts, and those of each word.

    Every distinct word of the block is encoded at most once. A text with a word that does not come back byte
    by byte is encoded as a whole, as one word.
    """
    spaced = pc.binary_join_element_wise("", texts, " ")
    sizes = pc.binary_length(spaced).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    body = np.frombuffer("".join(spaced.to_pylist()).encode(), np.uint8)
    cuts = word_starts(body, ends - sizes)
    coded = _strings(body, np.append(cuts, len(body))).dictionary_encode()
    number, found = coded.indices.to_numpy().astype(np.int64), pair.words(coded.dictionary)
    owner = np.searchsorted(ends, cuts, side="right")
    whole = np.unique(owner[~found.good[number]])
    if len(whole):
        again = pair.encode(spaced.take(pa.array(whole)))
        kept = ~np.isin(owner, whole)
        owner, number = np.append(owner[kept], whole), np.append(number[kept], len(found.good) + np.arange(len(whole)))
        order = np.argsort(owner, kind="stable")
        owner, number, found = owner[order], number[order], together([found, again])
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    measures = {name: _by_text(getattr(found, name)[number], starts) for name in ("n_a", "n_b", "n_links")}
    measures["n_groups"] = measures["n_links"]
    measures["groups_sha256"] = _digests(found.groups, number, starts)
    measures["words"] = [number[low:high].astype("<u4").tobytes() for low, high in zip(starts, starts[1:])]
    pairs, place = np.unique(found.links, return_inverse=True)
    weight, n = np.zeros(len(found.good), np.int64), np.zeros(len(pairs), np.int64)
    np.add.at(weight, number, times[owner])
    np.add.at(n, place, np.repeat(weight, found.n_links))
    return measures, {"a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "n": n, "ends": np.cumsum(found.n_links), "pair": place}


def _digests(groups: pa.Array, number: np.ndarray, starts: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups without the last semicolon; empty without groups."""
    out = []
    for low in range(0, len(starts) - 1, 256):  # so that long lines of ids do not stand in memory together
        here = starts[low : low + 257]
        some = groups.take(pa.array(number[here[0] : here[-1]]))
        bounds = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1] if len(some) else np.zeros(1, np.int64)
        data = memoryview(some.buffers()[2]) if len(some) and some.buffers()[2] is not None else memoryview(b"")
        for a, b in zip(bounds[here[:-1] - here[0]].tolist(), bounds[here[1:] - here[0]].tolist()):
            out.append(hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "")
    return out


def _by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    totals = np.concatenate(([0], np.cumsum(values)))
    return totals[starts[1:]] - totals[starts[:-1]]


ALIGNED = (
    "block long, text_key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, "
    "pairs struct<a: array<int>, b: array<int>, n: array<long>, ends: array<int>, pair: array<int>>"
)
_PAIRS = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("pair", pa.list_(pa.int32()))])
_LONGS = ("n_a", "n_b", "n_groups", "n_links")


def _align(byte_path: str | None, piece_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each text, and one for each block with its pairs."""
        paths = byte_path, piece_path
        if None in paths:
            import public_tokenizers

            paths = byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
        if paths not in _PAIRS_OF:
            _PAIRS_OF[paths] = Pair(*paths)
        block = TaskContext.get().partitionId() << 32
        for batch in by_rows(batches, "text", BLOCK):
            texts, keys = batch.column(0), batch.column(1)
            measures, pairs = align_block(_PAIRS_OF[paths], texts, batch.column(2).to_numpy())
            n = batch.num_rows
            columns = [pa.array(np.full(n, block)), keys, *[pa.array(measures[name]) for name in _LONGS], pa.array(measures["groups_sha256"], pa.string()), pa.array(measures["words"], pa.binary()), pa.nulls(n, _PAIRS)]
            yield pa.record_batch(columns, ["block", "text_key", *_LONGS, "groups_sha256", "words", "pairs"])
            row = pa.StructArray.from_arrays([pa.array([pairs[f.name]], f.type) for f in _PAIRS], fields=list(_PAIRS))
            none = [pa.nulls(1, kind) for kind in (pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary())]
            yield pa.record_batch([pa.array([block]), *none, row], ["block", "text_key", *_LONGS, "groups_sha256", "words", "pairs"])
            block += 1

    return run


def _list(row: pa.StructArray, name: str) -> np.ndarray:
    """The numbers of a list field of a struct array of one row."""
    return pc.struct_field(row, name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _measure(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's texts from its pairs' counts over the corpus."""
    kept = ["text_key", *_LONGS, "groups_sha256"]
    best, total = np.zeros(texts.num_rows, np.int64), np.zeros(texts.num_rows, np.int64)
    if texts.num_rows and pairs.num_rows:
        rows = pairs.sort_by("at")
        counts = np.zeros((int(rows["at"][-1].as_py()) + 1, 2), np.int64)
        counts[rows["at"].to_numpy()] = np.column_stack((rows["is_best"].to_numpy(), rows["count"].to_numpy()))
        head = texts["pairs"].combine_chunks().drop_null()  # the block's own row
        ends = np.concatenate(([0], _list(head, "ends")))
        sums = np.vstack((np.zeros((1, 2), np.int64), np.cumsum(counts[_list(head, "pair")], axis=0)))
        by_word = sums[ends[1:]] - sums[ends[:-1]]
        words = texts["words"].combine_chunks()
        starts = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(words), 0)) // 4)))
        used = by_word[_joined(words).view("<u4")]
        best, total = _by_text(used[:, 0], starts), _by_text(used[:, 1], starts)
    out = texts.select(kept).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))
    return out.filter(pc.is_valid(out["text_key"]))


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Measures of each document's alignment of two tokenizers, and the corpus-wide counts (a, b, count, is_best).

    Texts are grouped by their whole text, and each distinct one is encoded and aligned once: space +
    text by the byte-level vocabulary at ``byte_path`` and text by the piece model at ``piece_path``
    (files that every executor can read, by default those of ``public_tokenizers``), without special
    tokens. Offsets at which tokens of both sides end cut a text into groups; the tokens that end there
    are linked. The count of an id pair is how many links hold it, each text as often as it stands in
    the corpus. What is aligned lies in a table in the shared folder, in blocks of texts; a block's
    distinct pairs are counted, summed by pair, and looked up once for all its texts.

    Measures: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their
    b), count_sum (over links), groups_sha256. Texts that are null, empty or do not come back byte by
    byte from either side have no tokens: zeros and an empty string. Every row of ``docs`` gives one
    row, also with a null or repeated doc_id; other columns are ignored; an empty table gives empty ones.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    folder = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    texts.select("text", key.alias("text_key"), "times").mapInArrow(_align(byte_path, piece_path), ALIGNED).write.parquet(folder)
    aligned = spark.read.schema(ALIGNED).parquet(folder)
    pairs = aligned.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs.a", "pairs.b", "pairs.n")).alias("at", "pair"))
    pairs = pairs.select("block", "at", "pair.a", "pair.b", "pair.n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = counts.groupBy("b").agg(F.max("count").alias("most"))
    counts = counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("is_best"))
    held = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "at", "count", F.col("is_best").cast("int").alias("is_best"))
    kind = "text_key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    measures = aligned.groupBy("block").cogroup(held.groupBy("of_block")).applyInArrow(_measure, kind)
    # rows without a text look for a key that none has, each its own
    own = F.when(F.col("text") != "", key).otherwise(F.encode(F.concat(F.lit("-"), F.uuid()), "utf-8"))
    wanted = rows.select("doc_id", own.alias("text_key"))
    joined = wanted.join(measures, "text_key", "left")
    longs = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in (*_LONGS, "n_best", "count_sum")]
    return joined.select("doc_id", *longs, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), counts
