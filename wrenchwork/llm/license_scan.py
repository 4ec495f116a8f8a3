"""License notices in texts: winnowed fingerprints, then banded alignment.

Of the hashes of all runs of ``k`` tokens, winnowing keeps the smallest in every window of ``w``
neighbours. Two texts that share ``w + k - 1`` tokens in a row share a fingerprint. The templates'
fingerprints form an inverted index; texts that hold some of one template's on nearly the
same diagonal are aligned with it inside a band, which gives the share of the template
that the text has and where.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .decontaminate import tokens

# Public notices and licence texts, by their short names.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


@dataclass(frozen=True)
class Scan:
    k: int = 3
    w: int = 2
    band: int = 6  # tokens that may be put in or left out
    least_coverage: float = 0.8  # of a template's tokens


def winnowed(grams: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Places of the fingerprints: the last smallest of every ``w`` neighbours of one row.

    A row with fewer grams than ``w`` gives its smallest ones in the windows it has.
    """
    keep = np.zeros(len(grams), dtype=bool)
    for shift in range(w):
        best = np.ones(len(grams), dtype=bool)
        for other in range(-shift, w - shift):
            near = np.arange(len(grams)) + other
            inside = (near >= 0) & (near < len(grams))
            same = np.zeros(len(grams), dtype=bool)
            same[inside] = row[near[inside]] == row[inside]
            smaller = np.zeros(len(grams), dtype=bool)
            smaller[same] = (
                grams[near[same]] < grams[same] if other <= 0 else grams[near[same]] <= grams[same]
            )
            best &= ~smaller
        keep |= best
    return np.flatnonzero(keep)


class Templates:
    def __init__(self, texts: dict[str, str], scan: Scan) -> None:
        self.names = list(texts)
        self.tokens: list[np.ndarray] = []
        hashes, owners, places = [], [], []
        for a, b, words in tokens(pa.array([t.lower() for t in texts.values()], pa.string())):
            self.tokens += [words.hashes[words.first[i] : words.first[i + 1]] for i in range(b - a)]
            gram, row, place = _grams(words, scan.k)
            at = winnowed(gram, row, scan.w)
            hashes.append(gram[at])
            owners.append(row[at] + a)
            places.append(place[at])
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owners, self.places = np.concatenate(owners)[order], np.concatenate(places)[order]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.searchsorted(self.hashes, grams, "left")
        many = np.searchsorted(self.hashes, grams, "right") - low
        at = np.repeat(np.arange(len(grams)), many)
        entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(at))
        return at, entry


def _grams(words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams, row = words.grams(k), words.row_of_word()
    at = np.flatnonzero(row[: len(grams)] == row[k - 1 : k - 1 + len(grams)])
    return grams[at], row[at], at - words.first[row[at]]


def aligned(template: np.ndarray, text: np.ndarray, offset: int, band: int) -> tuple[int, int, int]:
    """(equal tokens, start, end in ``text``) of the best alignment of the whole template.

    Token i of the template may meet tokens i + offset - band to i + offset + band of the text.
    An equal token scores 1; skipping or substituting scores nothing but a little less, so
    that of equal scores the shortest stretch wins.
    """
    n, width = len(template), 2 * band + 1
    cost = 1e-3
    score = np.zeros(width)
    begin = np.full(width, -1)
    last = np.full(width, -1)
    lanes = np.arange(width)
    for i in range(n):
        at = i + offset - band + lanes
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[at[inside]] == template[i]
        met = score + np.where(same, 1.0, -cost)
        met_begin = np.where(same & (begin < 0), at, begin)
        met_last = np.where(same, at, last)
        # The template's token has no partner: one lane up.
        over = np.append(score[1:] - cost, -1.0)
        take = over > met
        score = np.where(take, over, met)
        begin = np.where(take, np.append(begin[1:], -1), met_begin)
        last = np.where(take, np.append(last[1:], -1), met_last)
        # Tokens of the text without partner: from the lanes below.
        for lane in range(1, width):
            if score[lane - 1] - cost > score[lane]:
                score[lane], begin[lane], last[lane] = score[lane - 1] - cost, begin[lane - 1], last[lane - 1]
    best = int(score.argmax())
    equal = int(np.ceil(score[best] - 0.5 * cost)) if score[best] > 0 else 0
    return equal, int(begin[best]), int(last[best]) + 1


def license_notices(docs: DataFrame, templates: dict[str, str] | None = None, scan: Scan = Scan()) -> DataFrame:
    """One row per notice found: ``doc_id, license, coverage, n_matched, span_start, span_end``.

    ``coverage`` is the share of the template's tokens found, at least ``least_coverage``; the
    span is in tokens of the text (lower-case words without punctuation). A text with a notice
    several times has a row for each, however close; of notices over the same words that with
    most is given. Null and empty texts have none; a template of fewer than ``k`` tokens cannot be found. Templates are a short list, given by the caller or built in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(shared.value, scan)
        for batch in batches:
            for a, _, words in tokens(batch.column(1)):
                rows = list(_notices(words, known, scan))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    ids = batch.column(0).take(pa.array([a + r for r in columns[0]], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()),
                         *[pa.array(c, pa.int64()) for c in columns[3:]]],
                        ["doc_id", "license", "coverage", "n_matched", "span_start", "span_end"],
                    )

    low = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    return low.mapInArrow(
        read,
        "doc_id bigint, license string, coverage double, n_matched bigint, span_start bigint, span_end bigint",
    )


def _notices(words, known: Templates, scan: Scan) -> Iterator[tuple]:
    grams, row, place = _grams(words, scan.k)
    prints = winnowed(grams, row, scan.w)
    at, entry = known.hits(grams[prints])
    at = prints[at]
    found = np.stack((row[at], known.owners[entry], place[at] - known.places[entry]))
    found = np.unique(found, axis=1)
    cut = np.any(found[:2, 1:] != found[:2, :-1], axis=0)
    notices = []
    for pair in np.split(found, np.flatnonzero(cut) + 1, axis=1) if found.shape[1] else []:
        r, owner = int(pair[0, 0]), int(pair[1, 0])
        text = words.hashes[words.first[r] : words.first[r + 1]]
        template = known.tokens[owner]
        for same, start, end in _aligned_each(template, text, pair[2], scan):
            notices.append((r, known.names[owner], same / len(template), same, start, end))
    # Of notices over the same words the one with most of them counts: not its parts or look-alikes.
    notices.sort(key=lambda x: (x[0], -x[3], -x[2], x[5] - x[4], x[1], x[4]))
    taken: list[tuple[int, int]] = []  # in the order of the text, without overlaps
    for i, notice in enumerate(notices):
        if i and notices[i - 1][0] != notice[0]:
            taken.clear()
        start, end = notice[4:]
        at = bisect_left(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            insort(taken, (start, end))
            yield notice


def _aligned_each(
    template: np.ndarray, text: np.ndarray, diagonals: np.ndarray, scan: Scan
) -> list[tuple[int, int, int]]:
    """(equal tokens, start, end) of alignments near the diagonals, given in order, with enough tokens.

    Neighbouring diagonals belong to one notice, over no more than half of the template. A
    notice repeated closely is kept from meeting the words of those beside it; only where
    that gives fewer equal tokens in all is it aligned over them.
    """
    spread = min(scan.band, len(template) // 2)
    groups: list[list[int]] = []
    for d in diagonals.tolist():
        if groups and d - groups[-1][0] <= spread:
            groups[-1].append(d)
        else:
            groups.append([d])
    low = np.array([g[0] for g in groups])
    high = np.array([g[-1] for g in groups])
    # The notices before and after are at least so far away.
    apart = max(1, int(np.ceil(scan.least_coverage * len(template) - 1e-9)))
    before = np.searchsorted(high, high - apart, "right") - 1
    after = np.searchsorted(low, low + apart, "left")
    offsets = [int(np.median(g)) for g in groups]

    def enough(found: tuple[int, int, int]) -> bool:
        return found[0] / len(template) >= scan.least_coverage

    alone, wide = [], []
    for g, offset in enumerate(offsets):
        a, b = 0, len(text)
        if before[g] >= 0:
            a = max(0, int(high[before[g]]) + apart)
        if after[g] < len(groups):
            b = int(low[after[g]])
        near = max(0, offset - scan.band), offset + len(template) + scan.band
        same, start, end = aligned(template, text[a:b], offset - a, scan.band)
        alone.append((same, start + a, end + a))
        wide.append(near[0] < a or b < min(near[1], len(text)))
    out = [x for x in alone if enough(x)]
    for g in np.flatnonzero(wide).tolist():
        found = aligned(template, text, offsets[g], scan.band)
        beside = range(*np.searchsorted(low, [low[g] - found[2] + found[1] - spread, low[g] + found[2] - found[1] + spread + 1]))
        others = sum(alone[i][0] for i in beside if enough(alone[i]) and alone[i][1] < found[2] and found[1] < alone[i][2])
        if enough(found) and found[0] > others:
            out.append(found)
    return out
