import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ruleweave.llm import packing

TEXTS = [
    None, "", " ", "Hello, world! It's fine. Don't...stop", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>,", "é é İ ǅ ſ x y\tz\x0bq's 't I'LL", "Σας ΣΑΣ, naïve.",
    "x" * 9000, "a b " * 6000, "J̌ J̌x,  nbsp em word.) (word,", "é, É. ñ", "word,,, word. , .word ,word 12,5 99.",
]


def test_pieces(spark, make):
    rows = [(i, text) for i, text in enumerate(TEXTS)] + [(None, "no id here")]
    pieces = packing.pack(make(rows)).collect()
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in rows:
        want = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        parts = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == want, i
        assert [p.start for p in parts] == [0, *itertools.accumulate(p.length for p in parts)][:-1] and {p.doc_tokens for p in parts} == {len(want)}
    for _, window in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        window = list(window)
        assert [p.offset for p in window] == [0, *itertools.accumulate(p.length for p in window)][:-1]
        assert sum(p.length for p in window) <= packing.WINDOW
    assert packing.pack(make([])).count() == 0


def cost(ends, prices, window):
    total, start = 0, 0
    for n, end in enumerate(ends):
        last = n == len(ends) - 1
        total += prices.get(end, packing.INSIDE) * (not last) + window - (end - start)
        start = end
    return total


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    window, points = 16, sorted(rng.sample(range(1, 60), rng.randrange(8, 14)))
    while any(b - a > window for a, b in zip([0, *points], points)):
        points = sorted({*points, rng.randrange(1, 60)})
    costs = [rng.choice([0, 4, 12]) for _ in points]
    prices = dict(zip(points, costs))
    got = packing.cuts(points, costs, window)
    assert got[-1] == points[-1] and all(b - a <= window for a, b in zip([0, *got], got))
    best = min(
        cost((*inner, points[-1]), prices, window)
        for n in range(len(points)) for inner in itertools.combinations(points[:-1], n)
        if all(b - a <= window for a, b in zip((0, *inner), (*inner, points[-1])))
    )
    spent = sum(0 if (b - a) & (b - a - 1) == 0 else window - (b - a) for a, b in zip([0, *got], got))
    spent += sum(prices.get(end, packing.INSIDE) for end in got[:-1])
    assert spent <= best


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = [r[0] for r in packing.pack(docs).groupBy("sequence_id").sum("length").select("sum(length)").collect()]
    assert sum(packing.WINDOW - n for n in sizes if n & (n - 1)) < 0.01 * sum(sizes)
