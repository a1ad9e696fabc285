import itertools
import random

import numpy as np
import xxhash
from conftest import roots

from ruleweave.llm import simhash


def slow(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n", "One", "one two", "One two THREE", "one two three", "a b a b a b c", "ÀÉ é x   y É", "x " * 40_000, "İI ſ K"]


def test_fingerprint():
    for text in [*TEXTS, " ".join(random.Random(4).choices("abcdefg", k=500))]:
        assert simhash.fingerprint(text) == slow(text), text


def test_masks_cover_every_pair():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        assert any(not any(mask >> bit & 1 for bit in bits) for mask in masks)


def test_documents(spark, make):
    rows = [(i + 1, text) for i, text in enumerate(TEXTS)] + [(3, "other words than those"), (None, "one"), (90, "one two three")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(make(rows)).collect()}
    known = {(i, slow(text)) for i, text in rows if i is not None}
    fps = sorted({fp for _, fp in known})
    least = {fp: min(i for i, other in known if other == fp) for fp in fps}
    pairs = [(least[a], least[b]) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    want = roots(set(least.values()), pairs)
    assert got == {(i, f"{fp:016x}"): want[least[fp]] for i, fp in known}
    assert simhash.near_duplicates(make([])).count() == 0


def test_large_buckets_are_covered_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(1)
    fps = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(60):
            at ^= 1 << rng.randrange(64) if rng.random() < 0.8 else sum(1 << rng.randrange(64) for _ in range(6))
            fps.add(at & (1 << 64) - 1)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    found = simhash.components(simhash.links(points)).collect()
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = roots(range(len(fps)), pairs)
    assert {r.node: r.component for r in found} == {i: want[i] for pair in pairs for i in pair}


def test_one_of_a_group_stays(spark, make):
    rows = [(5, "a b c d"), (2, "a b c d"), (9, "z y x w v"), (2, "a b c d"), (None, "a b c d"), (7, None), (None, ""), (None, "only here now"), (None, "only here now"), (2, "a B c d")]
    kept = simhash.keep_one(make(rows))
    assert kept.columns == make(rows).columns
    got = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert [i for i, _ in got] == ["2", "7", "9", "None"] and got[0][1].lower() == "a b c d" and got[3][1] == "only here now"
    assert simhash.keep_one(make([])).count() == 0


def test_keeping_one_takes_any_columns(spark):
    rows = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "a b c", 4, 5, 6)], "doc_id long, text string, text_key int, DOC_KEY int, component int")
    assert [tuple(r) for r in simhash.keep_one(rows).collect()] == [(1, "a b c", 1, 2, 3)]
