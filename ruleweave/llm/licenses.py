"""License scan by patience alignment of texts with license notices."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ruleweave.llm.common import by_rows, ship

# The usual wordings of public licenses' notices.
NOTICES = {
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-line": "Licensed under CC BY-ND 4.0.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
#: Least share of a notice's words that must align.
COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(text: Sequence[str], notice: Sequence[str]) -> list[tuple[int, int]]:
    """Aligned (place in text, place in notice) pairs, rising in both.

    Equal words at either end are aligned; in what is left, words that are unique in both sides are
    anchors, the longest run of them that rises in both is kept, and the gaps between are aligned in
    the same way. The gaps are kept on a list of their own, so long texts need no deep recursion.
    """
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(notice))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == notice[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(notice[c:d])
        place = {word: at for at, word in enumerate(text[a:b], a) if here[word] == 1}
        anchors = [(place[word], at) for at, word in enumerate(notice[c:d], c) if there[word] == 1 and word in place]
        low_a, low_c = a, c
        for x, y in rising(anchors):
            gaps.append((low_a, x, low_c, y))
            pairs.append((x, y))
            low_a, low_c = x + 1, y + 1
        if low_a > a:
            gaps.append((low_a, b, low_c, d))
    return sorted(pairs)


def rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence whose text places rise, by piles of patience; anchors come in notice order."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(anchors)
    for at, (x, _) in enumerate(anchors):
        pile = bisect_left(tops, x)
        back[at] = last[pile - 1] if pile else -1
        tops[pile : pile + 1], last[pile : pile + 1] = [x], [at]
    chain, at = [], last[-1] if last else -1
    while at >= 0:
        chain.append(anchors[at])
        at = back[at]
    return chain[::-1]


class Scanner:
    """Notices ready for scanning."""

    def __init__(self, notices: Mapping[str, str], least: float) -> None:
        self.least = least
        self.notices = [(name, words) for name, text in sorted(notices.items()) if (words := words_of(text))]
        self.sets = [frozenset(words) for _, words in self.notices]
        self.missing = [int(len(words) * (1 - least) + 1e-9) for _, words in self.notices]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(name, coverage, first word, word after the last) of each place that covers a notice.

        A place with enough coverage lacks at most a bounded number of the notice's words, so one
        word more than that many, the rarest in this text, are sure to hold one of its words: around
        each of their occurrences a stretch little longer than the notice is aligned. Where places
        overlap, the one with the most aligned words stays, then the one better covered.
        """
        words = words_of(text)
        present = set(words)
        hits: list[tuple[int, float, int, int, int, str]] = []
        counts: Counter[str] | None = None
        for (name, notice), own, missing in zip(self.notices, self.sets, self.missing):
            if len(own - present) > missing:
                continue
            if counts is None:
                counts = Counter(words)
                places: dict[str, list[int]] = {}
                wanted = frozenset().union(*self.sets)
                for at, word in enumerate(words):
                    if word in wanted:
                        places.setdefault(word, []).append(at)
            rare = sorted(range(len(notice)), key=lambda i: (counts[notice[i]], i))[: missing + 1]
            slack = max(4, len(notice) // 4)
            seen: set[int] = set()
            for i in rare:
                for at in places.get(notice[i], ()):
                    start = max(0, at - i - slack)
                    if start in seen:
                        continue
                    seen.add(start)
                    pairs = align(words[start : at - i + len(notice) + slack], notice)
                    if len(pairs) >= self.least * len(notice) - 1e-9:
                        first, last = pairs[0][0], pairs[-1][0]
                        hits.append((-len(pairs), -round(len(pairs) / len(notice), 6), last - first, start + first, start + last + 1, name))
        starts: list[int] = []
        found: list[tuple[str, float, int, int]] = []
        for _, coverage, _, first, after, name in sorted(hits):
            at = bisect_left(starts, first)
            if (at == len(starts) or starts[at] >= after) and (at == 0 or found[at - 1][3] <= first):
                starts.insert(at, first)
                found.insert(at, (name, -coverage, first, after))
        return found


def _scan(notices: Mapping[str, str], least: float):
    schema = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, least)
        for batch in by_rows(batches, "text", 16 << 20):
            keys = ("license", "coverage", "first_word", "end_word")
            hits = [[dict(zip(keys, hit)) for hit in scanner.scan(text or "")] for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(hits, schema)], ["doc_id", "licenses"])

    return run


def scan(docs: DataFrame, notices: Mapping[str, str] = NOTICES, least: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id and licenses, an array of (license, coverage, first_word, end_word).

    A notice is found where at least ``least`` of its words align with the text; places are counted in
    words from 0. A null or empty text has none, a null doc_id stays null, repeated rows stay, other
    columns are ignored. One narrow pass over whole texts; ``notices`` travel with the job.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<license:string,coverage:double,first_word:bigint,end_word:bigint>>"
    return texts.mapInArrow(_scan(dict(notices), least), f"doc_id long, licenses {kind}")


def digest(scanned: DataFrame) -> DataFrame:
    """Per document: how many notices, their list, and the best covered one."""
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["coverage"].cast("string"), x["first_word"].cast("string"), x["end_word"].cast("string")))
    best = F.sort_array(F.transform("licenses", lambda x: F.struct((-x["coverage"]).alias("c"), x["first_word"].alias("w"), x["license"].alias("license"))))
    return scanned.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.try_element_at(best, F.lit(1))["license"].alias("license"), F.array_join(listed, ",").alias("licenses")
    )
