"""License scans: winnowed fingerprints pick candidates, banded alignment decides.

Texts and templates are sequences of lower-cased words. Of every ``WINDOW``
consecutive word ``GRAM``-grams the least hash is a fingerprint, and an inverted
index from fingerprints to (template, place) gives diagonals. Besides, a match of
the least coverage can miss so many words of its template and no more, so of one
word more than that at least one is in it: each place of such a word (the rarest,
by length) is a hit too, if enough of the template's words are around. Hits on
near diagonals are one candidate, and the template is aligned with the words
around it inside a band (insertions, deletions and other words allowed); after a
match the words before and behind it are aligned again. Coverage is the share of
the template's words that the alignment matches; the span runs from the first to
the last matched word. Of overlapping matches, one that another beats in coverage
with no fewer words is left out.

The index holds the templates, a parameter bounded by ``MAX_TEMPLATE_WORDS``;
documents are scanned where they lie, without a shuffle.

Defined results: null and empty texts give no rows; a template that stands in a
text several times gives a row each time; equal rows give equal rows; a null id
is kept; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.llm.text import blocks

GRAM = 3
WINDOW = 3
BAND = 12
MAX_TEMPLATE_WORDS = 1_000_000
#: Words that stand everywhere: the last ones to be looked up.
_COMMON = frozenset(b"a an and any are as at by for following from in is it may not of on or that the this to under version with without work you".split())
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")

# Public notices of common licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, '
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(data: bytes) -> list[bytes]:
    return _WORD.findall(data.lower())


def _gram_hashes(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the rightmost least hash of every window (of all, if there are fewer)."""
    if len(hashes) == 0:
        return np.empty(0, np.intp)
    if len(hashes) < WINDOW:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(view)) + WINDOW - 1 - view[:, ::-1].argmin(axis=1))


class Index:
    """Templates, their vocabulary and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], least: float = 0.8):
        split = {name: words(text.encode()) for name, text in templates.items()}
        if sum(map(len, split.values())) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words")
        self.names = sorted(n for n, w in split.items() if w)
        vocabulary = sorted({w for ws in split.values() for w in ws})
        self.word_id = {w: k + 1 for k, w in enumerate(vocabulary)}  # 0: no template's word
        self.hash_of = np.array([0] + [xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
        self.templates = [np.array([self.word_id[w] for w in split[n]], np.int32) for n in self.names]
        places = defaultdict(list)
        for t, ids in enumerate(self.templates):
            hashes = _gram_hashes(self.hash_of[ids])
            for p in winnow(hashes).tolist():
                places[int(hashes[p])].append((t, p))
            if not len(hashes):  # shorter than a gram: found by its first word
                places[int(self.hash_of[ids[0]])].append((t, 0))
        self.places = dict(places)
        self.keys = np.array(sorted(places), np.uint64)
        # the least number of matched words, and words of which every match holds one: (template, place) by word
        self.least = [next(k for k in range(len(ids) + 1) if k and k / len(ids) >= least or k == len(ids)) for ids in self.templates]
        rarest = lambda w: (w in _COMMON, -len(w), w)
        self.rare = defaultdict(list)
        for t, (ids, k) in enumerate(zip(self.templates, self.least)):
            for q in sorted(range(len(ids)), key=lambda q: (rarest(vocabulary[ids[q] - 1]), q))[: len(ids) - k + 1]:
                self.rare[int(ids[q])].append((t, q))
        self.is_rare = np.isin(np.arange(len(vocabulary) + 1), list(self.rare))
        self.holds = [np.isin(np.arange(len(vocabulary) + 1), ids) for ids in self.templates]
        self.short = [t for t, ids in enumerate(self.templates) if len(ids) < GRAM]

    def ids(self, data: bytes) -> np.ndarray:
        get = self.word_id.get
        parts = [np.fromiter((get(w, 0) for w in ws), np.int32, len(ws)) for ws in map(words, blocks(data))]
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, least, largest diagonal) of hits close to each other."""
        hits = defaultdict(list)
        hashes = _gram_hashes(self.hash_of[ids])
        if len(hashes):
            at = winnow(hashes)
            near = np.searchsorted(self.keys, hashes[at])
            found = at[self.keys[np.minimum(near, len(self.keys) - 1)] == hashes[at]] if len(self.keys) else at[:0]
            for p in found.tolist():
                for t, q in self.places[int(hashes[p])]:
                    hits[t].append(p - q)
        for t in self.short:
            hits[t] += np.flatnonzero(ids == self.templates[t][0]).tolist()
        for p in np.flatnonzero(self.is_rare[ids]).tolist():
            for t, q in self.rare[int(ids[p])]:
                hits[t].append(p - q)
        out = []
        for t, diagonals in sorted(hits.items()):
            diagonals.sort()
            first = last = diagonals[0]
            for d in diagonals[1:]:
                # beyond the band it is another copy
                if d - first > BAND:
                    out.append((t, first, last))
                    first = d
                last = d
            out.append((t, first, last))
        return out

    def matches(self, ids: np.ndarray, t: int, first: int, last: int) -> list[tuple[int, int, int]]:
        """Matched words, first and last place of all matches of a candidate that do not overlap."""
        out, size = [], len(self.templates[t])
        rest = [(max(0, first - BAND), min(len(ids), last + BAND + size))]
        while rest:
            a, b = rest.pop()
            if b <= a or np.count_nonzero(self.holds[t][ids[a:b]]) < self.least[t]:
                continue
            found = self.align(ids, t, first, last, a, b)
            if found[0] >= self.least[t]:
                out.append(found)
                rest += [(a, found[1]), (found[2] + 1, b)]
        return out

    def align(self, ids: np.ndarray, t: int, first: int, last: int, begin: int = 0, n: int | None = None) -> tuple[int, int, int]:
        """Matched words, and the first and last matched place in the text (-1: none), between ``begin`` and ``n``."""
        template, n = self.templates[t].tolist(), len(ids) if n is None else n
        low, high = first - BAND, last + BAND
        # a state is (matches, start, -end); place k of row i: i template words against the text before low + i + k
        width = high - low + 1
        none = (0, -1, 1)
        row = [none] * (width + 1)
        for i, word in enumerate(template):
            now = [none] * (width + 1)
            for k in range(width):
                j = low + i + k
                best = row[k + 1]  # the template's word is missing in the text
                if k and now[k - 1] > best:  # the text's word is additional
                    best = now[k - 1]
                diagonal = row[k]
                if begin <= j < n and ids[j] == word:
                    diagonal = (diagonal[0] + 1, diagonal[1] if diagonal[0] else j, -j)
                if diagonal > best:
                    best = diagonal
                now[k] = best
            now[width] = none
            row = now
        matches, start, end = max(row)
        return matches, start, -end


def scan_text(index: Index, data: bytes, least: float) -> list[tuple[str, int, float, int, int, int, int]]:
    """template, matched words, coverage, first and last word (end exclusive), start and end code point."""
    ids = index.ids(data)
    out, offsets, characters = [], None, None
    for t, first, last in index.candidates(ids):
        for matched, a, b in index.matches(ids, t, first, last):
            coverage = matched / len(index.templates[t])
            if coverage < least:
                continue
            if offsets is None:
                offsets = _offsets(data)
                # code points before each byte: those that begin there
                characters = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
            out.append((index.names[t], matched, coverage, a, b + 1, int(characters[offsets[a][0]]), int(characters[offsets[b][1]])))
    # where templates are alike, the one that covers more of itself with no fewer words speaks for the span
    out = sorted(set(out))
    by_start = sorted(out, key=lambda m: m[3])
    starts, longest = [m[3] for m in by_start], max((m[4] - m[3] for m in out), default=0)

    def near(m):
        """The matches that overlap one: they begin before its end, and no earlier than the longest is long."""
        return (o for o in by_start[bisect_right(starts, m[3] - longest) : bisect_left(starts, m[4])] if m[3] < o[4])

    return [m for m in out if not any(o[2] > m[2] and o[1] >= m[1] for o in near(m))]


def _offsets(data: bytes) -> list[tuple[int, int]]:
    at, out = 0, []
    for block in blocks(data):
        out += [(at + m.start(), at + m.end()) for m in _WORD.finditer(block.lower())]
        at += len(block)
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, template, matched_words, coverage, first_word, end_word, start_char, end_char."""
    given = TEMPLATES if templates is None else templates

    def run(batches):
        index = Index(given, least)
        for batch in batches:
            rows = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in scan_text(index, text.as_py() or b"", least)]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    kinds = {"doc_id": pa.int64(), "template": pa.string(), "matched_words": pa.int32(), "coverage": pa.float64(), "first_word": pa.int64(), "end_word": pa.int64(), "start_char": pa.int64(), "end_char": pa.int64()}
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, template string, matched_words int, coverage double, first_word long, end_word long, start_char long, end_char long")
