import hashlib
from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ruleweave.llm import alignment


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def symbols():
    """Byte of each visible character, spelled out byte by byte."""
    table, n = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            table[chr(byte)] = byte
        else:
            table[chr(256 + n)] = byte
            n += 1
    return table


def slow(tokenizers, rows):
    """The contract, text by text and byte by byte."""
    a, b = tokenizers
    words, signs, held, counts = {i: w for w, i in a.get_vocab().items()}, symbols(), [], Counter()
    for doc, text in rows:
        links, groups, left, right = [], [], [], []
        if text:
            left = a.encode(" " + text, add_special_tokens=False).ids
            right = b.encode(text)
            la = [bytes(signs[c] for c in words[i]) for i in left]
            rb = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(b.id_to_piece, right)]
            if b"".join(la) != (" " + text).encode() or b"".join(rb) != (" " + text).encode():
                left, right = [], []
            ends = {}
            at = 0
            for i, part in zip(left, la):
                at += len(part)
                ends.setdefault(at, ([], []))[0].append(i)
            at = 0
            for i, part in zip(right, rb):
                at += len(part)
                ends.setdefault(at, ([], []))[1].append(i)
            ga, gb = [], []
            for at in sorted(ends):
                ga += ends[at][0]
                gb += ends[at][1]
                links += [(x, y) for x in ends[at][0] for y in ends[at][1]]
                if ends[at][0] and ends[at][1]:
                    groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                    ga, gb = [], []
        counts.update(links)
        held.append((doc, len(left), len(right), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for doc, n_a, n_b, groups, links in held
    ]


TEXTS = [
    None, "", " ", "  two  spaces ", "plain words, with commas. And a sentence!", "tabs\tand\nlines \n  mixed\r\n", "Grüße aus München, außerdem über Öl",
    "привет мир это текст", "日本語の文章 と 空白", "é combining é ﬁ ligature ①", "non breaking  wide　 ideographic  line", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "emoji 😀 👩‍👩‍👧 done", "▁ low line ▁word x▁y", "nul \x00 and \x1f unit\x85next", "don't we're I'll 123 4567 3.14", "a" * 5000, "it is " * 400, "x", "‘quoted’ “words” – dash … end", "trail   ",
]


@pytest.mark.parametrize("block", [1 << 23, 64])
def test_measures(spark, make, tokenizers, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    for name in ("WORDS", "REMEMBERED", "LONGEST"):
        monkeypatch.setattr(alignment, name, 7)
    rows = [(i, text) for i, text in enumerate(TEXTS)] + [(100 + i, TEXTS[4]) for i in range(30)] + [(None, TEXTS[6]), (3, TEXTS[7]), (3, TEXTS[7])]
    measures, counts = alignment.align(make(rows).repartition(3))
    kept = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    got = sorted((tuple(r[c] for c in kept) for r in measures.collect()), key=str)
    assert got == sorted(slow(tokenizers, rows), key=str)
    assert sum(r["count"] for r in counts.collect()) == sum(r[4] for r in got)


def test_no_documents(spark, make):
    measures, counts = alignment.align(make([]))
    assert measures.count() == 0 and counts.count() == 0


def test_words_give_the_ids_of_the_whole_text(tokenizers):
    """Cutting texts into words changes no id, whatever stands around the spaces."""
    import random

    pair = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    random.seed(5)
    letters = ["a", "The", " ", "  ", "\n", "\t", "é", "ж", "語", "'s", "'", "1", "23", ".", ",", " ", " ", "’", "　", "\x1c", "▁", "😀", "ing", "<s>"]
    texts = ["".join(random.choices(letters, k=random.randint(1, 25))) for _ in range(3000)]
    import numpy as np

    measures, _ = alignment.align_block(pair, pa.array(texts), np.ones(len(texts), np.int64))
    whole = pair.encode(pa.array([" " + text for text in texts]))
    for i, groups in enumerate(whole.groups.to_pylist()):
        assert measures["groups_sha256"][i] == (hashlib.sha256(groups[:-1]).hexdigest() if groups else ""), texts[i]
        assert (measures["n_a"][i], measures["n_b"][i], measures["n_links"][i]) == (whole.n_a[i], whole.n_b[i], whole.n_links[i])
