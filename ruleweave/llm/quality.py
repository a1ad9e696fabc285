"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ruleweave.llm.common import ship

#: Most labelled rows that the model is fitted on: those with the smallest hash of doc_id, spread over all sources.
SAMPLE = 20_000
#: Shrinkage of a class covariance towards the pooled one, and of both towards a multiple of the identity.
POOLED, ROUND = 0.1, 0.02
FEATURES = 16
#: Bytes of ordinary text that a text's byte classes are blended with, so that very short texts say little.
BLEND = 60.0


def _table(characters: bytes) -> np.ndarray:
    chosen = np.zeros(256)
    chosen[list(characters)] = 1
    return chosen


CLASSES = np.stack([
    _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table(b"abcdefghijklmnopqrstuvwxyz"), _table(b"0123456789"), _table(b"#$%&*@^~"),
    _table(b"!?"), _table(b"|<>{}[]()\\/_=+"), _table(b".,;:'\"-"), _table(b"\n"), _table(bytes(range(128, 256))),
])
#: Share of each class in ordinary text, roughly; only the blend uses it.
USUAL = np.array([0.02, 0.77, 0.002, 0.0005, 0.0005, 0.0005, 0.02, 0.003, 0.02])


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text; a null text counts as empty."""
    body = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    words, lines = body.split(), [line for line in body.split(b"\n") if line]
    size, tokens = max(1, len(body)), max(1, len(words))
    shares = np.log((CLASSES @ counts + BLEND * USUAL) / (size + BLEND))
    doubled = sum(map(eq, words, islice(words, 1, None)))
    used = counts[counts > 0] / size
    letters = sum(map(len, words))
    return np.array([
        *shares, np.log(1 + len(words)), np.log((letters + 50) / (tokens + 10)), np.log((len(set(words)) + 10) / (len(words) + 10)), np.log((doubled + 0.1) / (len(words) + 10)),
        -(used * np.log(used)).sum(), np.log((len(set(lines)) + 3) / (len(lines) + 3)), np.log(1 + len(body) / (1 + len(lines))),
    ])


@dataclass(frozen=True)
class Quadratic:
    """Two Gaussian classes; the Cholesky factors are computed once and travel with the model."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Quadratic:
        """From (count, sum, sum of outer products) by class; a class without rows takes the other's shape."""
        empty = (0.0, np.zeros(FEATURES), np.zeros((FEATURES, FEATURES)))
        each = [moments.get(k, empty) for k in (0, 1)]
        total = [sum(part[i] for part in each) for i in range(3)]
        mean = total[1] / max(1.0, total[0])
        pooled = np.zeros((FEATURES, FEATURES))
        means, covariances = [], []
        for count, first, second in each:
            centre = first / count if count else mean
            scatter = second - count * np.outer(centre, centre)
            pooled += scatter
            means.append(centre)
            covariances.append(scatter / count if count > FEATURES else None)
        pooled = pooled / max(1.0, total[0]) + 1e-6 * np.eye(FEATURES)
        scale = np.sqrt(np.diag(pooled))
        factors, offsets = [], []
        for (count, _, _), covariance in zip(each, covariances):
            shape = pooled if covariance is None else (1 - POOLED) * covariance + POOLED * pooled
            shape = (1 - ROUND) * shape + ROUND * np.diag(scale**2)
            factor = np.linalg.cholesky(shape)
            factors.append(np.linalg.inv(factor))
            offsets.append(np.log((count + 1) / (total[0] + 2)) - np.log(np.diag(factor)).sum())
        return cls(np.stack(means), np.stack(factors), np.array(offsets))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of the log densities and priors."""
        away = [((rows - mean) @ factor.T) for mean, factor in zip(self.means, self.factors)]
        logs = [offset - 0.5 * (z * z).sum(axis=1) for offset, z in zip(self.offsets, away)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = statistics(text.as_py())
            row = np.concatenate(([1.0], x, np.outer(x, x).ravel()))
            sums[label] = sums.get(label, 0) + row
    if sums:
        values = pa.array([v for row in sums.values() for v in row])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * (1 + FEATURES + FEATURES**2), pa.int32()), values)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), lists], ["label", "sums"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Quadratic:
    """Fit on at most ``sample`` labelled rows that are not held out.

    Labels that are null or neither 0 nor 1 are left out, and so are labels that contradict each
    other for one doc_id; repeated labels count once. The sample's ids are the only thing that is
    broadcast (16 bytes a row, bounded by ``sample``); each task returns one row of moments per class.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    known = known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").select("label", "text").mapInArrow(_moments, "label int, sums array<double>")
    width = 1 + FEATURES + FEATURES**2
    totals = rows.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    by: dict[int, np.ndarray] = {}
    for label, at, value in totals.collect():  # two classes of fixed width
        by.setdefault(label, np.zeros(width))[at] = value
    moments = {k: (v[0], v[1 : 1 + FEATURES], v[1 + FEATURES :].reshape(FEATURES, FEATURES)) for k, v in by.items()}
    return Quadratic.fit(moments)


def scored(docs: DataFrame, model: Quadratic, keep: str) -> DataFrame:
    """(keep, score) for every row of ``docs``; ``keep`` names one column that passes through."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.stack([statistics(text.as_py()) for text in batch.column(1)])
                yield pa.record_batch([batch.column(0), pa.array(model.score(rows))], [keep, "score"])

    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(F.col(keep), F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{keep}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``, in one narrow pass after the fit.

    Only the text is an input of the score. Null and empty texts get the score of an empty text. A
    null doc_id stays null and is not held out; repeated rows stay. Without usable labels every
    score is 0.5. Other columns of either table are ignored.
    """
    model = fit(docs, labels, sample)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = scored(ids, model, "doc_id")
    return result.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier predicts to be good, columns unchanged, in one narrow pass."""
    model = fit(docs, labels, sample)
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.stack([statistics(text.as_py()) for text in batch.column(at)])
                yield batch.filter(pa.array(model.score(rows) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
