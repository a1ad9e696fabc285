import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ruleweave.llm import repeats


def slow(rows):
    first = {}
    for i, text in rows:
        body = (text or "").encode()
        for p in range(len(body) - 49):
            key = body[p : p + 50]
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        body = (text or "").encode()
        gone = np.zeros(len(body) + 1, bool)
        for p in range(len(body) - 49):
            if first[body[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = int((gone[:-1] < gone[1:]).sum() + gone[0]) if len(body) else 0
        out.append((i, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randrange(9, 40))) for _ in range(12)]
    rows = []
    for i in rng.sample(range(1000), 90):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))]
        text = " ".join(parts)
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1]
            cut = rng.randrange(len(text) + 1)
            text = text[:cut] + rng.choice(["", "x", word(), word() * 9]) + text[cut + rng.randrange(3) :]
        rows.append((i, text))
    rows += [(2000, "a" * 300), (2001, "a" * 120), (2002, "ab" * 80), (1999, "ab" * 70), (2003, ""), (2004, "z" * 49), (2005, "z" * 50), (2006, "z" * 50)]
    return rows


@pytest.mark.parametrize("seed,buckets,hot", [(1, 5, 4096), (2, 1, 4096), (3, 7, 1)])
def test_against_brute_force(spark, make, seed, buckets, hot):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in repeats.digest(repeats.without_repeats(make(rows), buckets, hot)).collect())
    assert got == slow(rows)


def test_edges(spark, make):
    assert repeats.without_repeats(make([]), 2).count() == 0
    long = " ".join(random.Random(5).choices(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"], k=250_000))
    some = "x" * 20 + " some words that are long enough to be found again, surely"
    rows = [(3, None), (1, some), (1, some), (1, some + " and"), (None, some), (4, long), (5, "new " + long + " end"), (2, some[:49])]
    got = sorted((r.doc_id, r.n_bytes, r.kept, tuple(map(tuple, r.spans))) for r in repeats.without_repeats(make(rows), 3).collect())
    size = len(long)
    assert [g for g in got if g[0] < 4] == sorted([(1, len(some), some.encode(), ())] * 2 + [(1, len(some) + 4, (some + " and").encode(), ()), (2, 49, some[:49].encode(), ()), (3, 0, b"", ())])
    assert [g for g in got if g[0] > 3] == [(4, size, long.encode(), ()), (5, size + 8, b"new  end", ((4, size + 4),))]


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 4000)
    data[1000:1200] = data[3000:3200]
    starts = np.arange(len(data) - 50)
    group = starts % 3
    order, new = repeats.Suffixes(data, starts, group.astype(np.uint64)).runs()
    body = data.tobytes()
    keys = [(int(group[at]), body[at : at + 50]) for at in order]
    assert keys == sorted(keys)
    assert new.tolist() == [True] + [a != b for a, b in zip(keys, keys[1:])]


def test_hot_windows_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(repeats, "short", lambda x: np.zeros_like(x))
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(50)).encode() for _ in range(2)]
    texts.append(texts[0])
    doc = np.arange(3)
    docs = pa.table({"doc": doc, "text_key": doc, "size": [50] * 3, "body": [pa.compress(text, codec="zstd", asbytes=True) for text in texts]})
    one = np.ones(3, np.int64)
    places = repeats.Rows(doc, doc, key=one, at=0 * one, size=50 * one, hot=one).pack(repeats.PLACES)
    found = repeats._fetch(1)(docs, pa.table({"body": pa.array([places], pa.binary())})).to_pylist()
    ranges, _ = repeats.Rows.unpack(repeats.RANGES, [r["body"] for r in found if r["kind"] == repeats.RANGES])
    sent, tails = repeats.Rows.unpack(repeats.CONTEXTS, [r["body"] for r in found if r["kind"] == repeats.CONTEXTS])
    assert ranges.doc.tolist() == [2] and sent.doc.tolist() == [0, 1] and b"".join(tails) == texts[0] + texts[1]
