import random

from ruleweave.llm import licenses


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_common_and_rises():
    rng = random.Random(1)
    for _ in range(200):
        notice = rng.choices("abcdefghijklmnop", k=rng.randrange(12))
        text = [w for w in notice if rng.random() < 0.8] + rng.choices("abcxyz", k=rng.randrange(6))
        pairs = licenses.align(text, notice)
        assert all(text[i] == notice[j] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest(text, notice)
        if len(set(notice)) == len(notice) and len(set(text)) == len(text):
            assert len(pairs) == longest(text, notice)


def test_scan(make):
    mit, apache = licenses.NOTICES["mit"], licenses.NOTICES["apache-2.0"]
    broken = " ".join(w for i, w in enumerate(mit.split()) if i % 7)
    rows = [
        (1, "text before. Released under the MIT License. after"), (2, f"x {apache} y {apache}"), (3, broken), (4, None), (5, ""), (None, "MIT"),
        (6, "mit der und mit license " * 300), (7, "filler " * 100_000 + "licensed under CC-BY-NC 4.0!"), (7, "Licensed under CC BY 4.0."),
    ]
    got = {(r.doc_id, k): [(h.license, h.first_word, h.end_word) for h in r.licenses] for k, r in enumerate(licenses.scan(make(rows)).coalesce(1).collect())}
    by = sorted(((str(i), hits) for (i, _), hits in got.items()), key=str)
    size = len(licenses.words_of(apache))
    assert by == sorted([
        ("1", [("mit-line", 2, 7)]), ("2", [("apache-2.0", 1, 1 + size), ("apache-2.0", 2 + size, 2 + 2 * size)]), ("3", got[3, 2]), ("4", []), ("5", []),
        ("None", []), ("6", []), ("7", [("cc-by-nc-line", 100_000, 100_007)]), ("7", [("cc-by-line", 0, 6)]),
    ], key=str)
    assert [hit[0] for hit in got[3, 2]] == ["mit"]
    assert licenses.digest(licenses.scan(make([]))).count() == 0
