"""Packing token streams into fixed windows by order-preserving dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ruleweave.llm.common import by_rows, ship

WINDOW, END = 4096, 2
#: Cost, in tokens of padding, of cutting a document at the end of a sentence and inside one.
AT_SENTENCE, INSIDE = 4, 12
#: Longest stretch without a place to cut; longer sentences get places inside.
STRETCH = 64
#: Bytes of text that are cut together; each run ends in windows of its own.
RUN = 8 << 20
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 600_000


#: Punctuation that is looked up apart from a word that it ends, if the word itself ends in a letter.
TAIL = ".,!?;:#$%&*|"


class Words:
    """Ids of words. White space never lies inside a pre-token, so a text's ids are its words' ids in turn.

    Nor does a pre-token hold both a letter and the punctuation after it (save for apostrophes, and
    the special tokens in angle brackets), so a word's tail is looked up by itself; and the vocabulary
    is lower case, so words in ASCII are looked up in lower case.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(words.values()) + 1, bool)
        self.closes[[at for text, at in words.items() if text.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def numbers(self, parts: pa.Array) -> np.ndarray:
        """Places of the distinct strings among those remembered; new ones are encoded."""
        coded = parts.dictionary_encode()
        found = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        fresh = np.flatnonzero(found < 0)
        letters = pc.match_substring_regex(coded.dictionary.take(pa.array(fresh)), "^[a-z]+$").to_numpy(zero_copy_only=False) if len(fresh) else fresh
        for places, encode in ((fresh[letters], self.single), (fresh[~letters], self.several)) if len(fresh) else ():
            found[places] = len(self.known) + np.arange(len(places))
            some = coded.dictionary.take(pa.array(places))
            self.known = pa.concat_arrays([self.known, some])
            for start in range(0, len(some), 20_000):
                flat, counts = encode(some.slice(start, 20_000).to_pylist())
                self.flat, self.counts = np.concatenate((self.flat, flat)), np.concatenate((self.counts, counts))
        return found[coded.indices.to_numpy()]

    def single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, each one pre-token, which its last id closes: encoded in one text."""
        flat = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.int32)
        return flat, np.diff(np.flatnonzero(self.closes[flat]), prepend=-1).astype(np.int32)

    def several(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(word, add_special_tokens=False).ids for word in words]
        return np.array([x for part in ids for x in part], np.int32), np.array([len(part) for part in ids], np.int32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by END; places after sentences; places after documents."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        cores = pc.utf8_rtrim(words, characters=TAIL)
        plain = pc.and_(pc.match_substring_regex(cores, "[A-Za-zÀ-ÖØ-öø-ÿ]$"), pc.invert(pc.match_substring(words, "<")))
        cores = pc.if_else(plain, cores, words)
        tails = _after(words, cores)
        low = pc.and_(plain, pc.string_is_ascii(cores))
        places = self.numbers(pa.concat_arrays([pc.if_else(low, pc.ascii_lower(cores), cores), tails]))
        pairs = np.stack((places[: len(words)], places[len(words) :]), axis=1)
        counts, flat = self.counts.astype(np.int64), self.flat
        starts = np.cumsum(counts) - counts
        numbers = pairs[at].ravel()
        lengths = counts[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        body = flat[np.repeat(starts[numbers] - (ends - lengths), lengths) + np.arange(total)]
        reached = np.concatenate(([0], ends[1::2]))  # ids up to and with each word
        stops = reached[np.cumsum(sizes)]
        ids = np.insert(body, stops, END).astype("<u4")
        ending = np.flatnonzero(pc.match_substring_regex(words, "[.!?]$").to_numpy(zero_copy_only=False)[at]) if len(at) else at
        document = np.repeat(np.arange(len(sizes)), sizes)
        return ids, reached[ending + 1] + document[ending], stops + np.arange(1, len(sizes) + 1)


def _after(words: pa.Array, cores: pa.Array) -> pa.Array:
    """What is left of each word after its core."""
    data = words.buffers()[2]
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + 1 + len(words)].astype(np.int64)
    sizes = pc.binary_length(words).to_numpy().astype(np.int64) - pc.binary_length(cores).to_numpy()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    body = raw[np.repeat(ends - sizes - bounds[:-1], sizes) + np.arange(bounds[-1])]
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body.tobytes())])


_WORDS: dict[str, Words] = {}


def places(sentences: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end, and what ending there costs; no gap is longer than STRETCH."""
    points = np.sort(np.concatenate((sentences, documents)), kind="stable")  # two rising runs
    points = points[np.diff(points, prepend=0) > 0]
    gaps = np.diff(points, prepend=0)
    extra = (gaps - 1) // STRETCH
    wide = np.flatnonzero(extra)
    if len(wide):
        base = np.repeat(points[wide] - gaps[wide], extra[wide])
        step = np.arange(len(base)) - np.repeat(np.cumsum(extra[wide]) - extra[wide], extra[wide]) + 1
        points = np.sort(np.concatenate((points, base + step * STRETCH)), kind="stable")
    costs = np.full(len(points), INSIDE, np.int64)
    costs[np.searchsorted(points, sentences[sentences > 0])] = AT_SENTENCE
    costs[np.searchsorted(points, documents)] = 0
    return points, costs


def cuts(points: list[int], costs: list[int], window: int = WINDOW) -> list[int]:
    """Ends of the windows, at ``points``, that minimise padding and cutting costs.

    f(p) = cost(p) + min over q in [p - window, p) of f(q) + window - (p - q): with g(q) = f(q) + q the
    minimum slides over a monotone queue, so every place enters and leaves it once. The last window
    need not be filled: a remainder can be cut into powers of two, which are not padded.
    """
    if not points:
        return []
    at, g, back = [0, *points], [0] * (len(points) + 1), [0] * (len(points) + 1)
    queue = deque([0])
    push, pop, left = queue.append, queue.pop, queue.popleft
    for i in range(1, len(at)):
        p = at[i]
        low = p - window
        while at[queue[0]] < low:
            left()
        best = queue[0]
        back[i] = best
        value = costs[i - 1] + window + g[best]  # f(p) + p
        g[i] = value
        while queue and g[queue[-1]] >= value:
            pop()
        push(i)
    end, last = len(at) - 1, at[-1]
    f = [(g[i] - at[i] + _rest(last - at[i], window), -at[i], i) for i in range(end, -1, -1) if last - at[i] <= window]
    _, _, i = min(f)
    ends = _split(at[i], last, window) if i < end else []
    while i:
        ends.append(at[i])
        i = back[i]
    return sorted(ends)


def _rest(size: int, window: int) -> int:
    """What the remainder costs: padded, or cut into powers of two."""
    return min(window - size, INSIDE * (size.bit_count() - 1)) if size else 0


def _split(start: int, end: int, window: int) -> list[int]:
    size = end - start
    if window - size <= INSIDE * (size.bit_count() - 1):
        return [end]
    ends = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        ends.append(start)
    return ends


def _pieces(bounds: np.ndarray, documents: np.ndarray) -> dict[str, np.ndarray]:
    """Each window's parts of documents: document number, start in it, length, window number, offset there."""
    stops = np.union1d(bounds, documents)
    starts = np.concatenate(([0], stops[:-1]))
    owner = np.searchsorted(documents, starts, side="right")
    inside = np.searchsorted(bounds, starts, side="right")
    firsts = np.concatenate(([0], documents[:-1]))
    heads = np.concatenate(([0], bounds[:-1]))
    return {"owner": owner, "begin": starts, "start": starts - firsts[owner], "length": stops - starts, "window": inside, "offset": starts - heads[inside], "size": documents[owner] - firsts[owner]}


def _pack(tokenizer_path: str | None, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if path not in _WORDS:
            _WORDS[path] = Words(path)
        words = _WORDS[path]
        number = TaskContext.get().partitionId() << 36
        for batch in by_rows(batches, "text", RUN):
            ids, sentences, documents = words.ids(batch.column(1))
            points, costs = places(sentences, documents)
            bounds = np.array(cuts(points.tolist(), costs.tolist(), window))
            part = _pieces(bounds, documents)
            offsets = np.concatenate((part["begin"], part["begin"][-1:] + part["length"][-1:])) * 4
            for low in range(0, len(part["owner"]), 20_000):
                here = slice(low, low + 20_000)
                local = offsets[low : low + 20_001] - offsets[low]
                body = ids[offsets[low] // 4 : offsets[low] // 4 + local[-1] // 4].tobytes()
                blobs = pa.Array.from_buffers(pa.binary(), len(local) - 1, [None, pa.py_buffer(local.astype(np.int32)), pa.py_buffer(body)])
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(part["owner"][here])), *[pa.array(part[k][here]) for k in ("start", "length", "size")],
                     pa.array(number + part["window"][here]), pa.array(part["offset"][here]), blobs],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            number += len(bounds)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, order_by: Column | str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    Documents are cut into windows of at most ``window`` ids in the order in which they are stored
    (or by ``order_by``); a document's ids end with END, and each id lies in one piece. Windows end
    at documents or sentences where that is cheap. Each run of ``RUN`` bytes of text is cut by itself
    and ends in powers of two, so memory is bounded and nothing is shuffled. A null or empty text is
    END alone; a null doc_id stays null; repeated rows are packed each by itself; other columns are
    ignored; an empty table gives an empty table. ``tokenizer_path`` is a file that every executor
    can read, by default the 49k word vocabulary of ``public_tokenizers``.
    """
    ship(docs.sparkSession)
    rows = docs if order_by is None else docs.repartitionByRange(order_by).sortWithinPartitions(order_by)
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return texts.mapInArrow(_pack(tokenizer_path, window), schema)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
