"""License scans: MinHash bands over overlapping text windows retrieve templates, shingles verify them.

Words are lower-cased, without punctuation at their ends; shingles are five words. A template of s
shingles belongs to the level whose half window h is the next power of two. Windows of 2h
shingles start at every h-th shingle, so any run of h shingles lies within one window, and the
window's similarity to a template it contains is at least s / 2h, above 1/4. Each of the BANDS
bands is one minimum, so a window misses a template that it contains with a probability below
(3/4) ** BANDS, about 1e-4, and one that holds four fifths of it with one below 1e-3. Retrieved
pairs are verified: in the window widened by half a window on both sides, at least ``percent`` of the template's
shingles must occur within a span of about its length (a quarter more at 80 percent). Each such span is a match of its own,
from left to right without overlap. Of templates that share half of their shingles (versions of one license) only the one
contained best is reported where their spans overlap; notices that merely stand within a longer text are reported beside it.

The templates given here are short notices. Whole license texts, one file each, are read with ``read_templates``.

Odd input: null or empty text, or fewer than five words: no match. Null doc_id: the matches are
returned with a null doc_id. Repeated rows: each has its matches. Very long texts are scanned in
pieces of CHUNK shingles with an overlap of one widened window. Empty table: empty result. Other
columns are ignored. A template under five words is an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import SHINGLE, combine, mix

BANDS = 32
CHUNK = 1 << 15

#: Notices of widespread public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_ENDS = "\"'`.,:;!?()[]{}<>*#|"


def normal_words(text: str) -> list[str]:
    return [w for w in (x.strip(_ENDS) for x in text.lower().split()) if w]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = 1469598103934665603
        for b in word.encode():
            h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        if len(self) > 300_000:
            self.clear()
        self[word] = h
        return h


def _shingles(words: list[str], hashes: _Hashes) -> np.ndarray:
    return combine(mix(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))), SHINGLE)


_FACTORS = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """(BANDS x n) hash values whose minimum over a window is a band."""
    return ((shingles[None, :] * _FACTORS[:, None]) >> np.uint64(32)).astype(np.uint32)


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name to text of the templates in a folder of text files, read by Spark (any file system it knows)."""
    rows = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()  # as many as licenses
    return {r.name: r.value for r in rows}


def span_length(n: int, percent: int) -> int:
    """Longest span, in shingles, in which a template of n shingles is looked for."""
    return -(-100 * n // percent) + 4


class Templates:
    """Templates by level, with a table of the low bits of their minima for each band."""

    def __init__(self, texts: dict[str, str]) -> None:
        hashes = _Hashes()
        self.names = sorted(texts)
        self.sets = [np.unique(_shingles(normal_words(texts[name]), hashes)) for name in self.names]
        if short := [n for n, s in zip(self.names, self.sets, strict=True) if not len(s)]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.levels: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.levels.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        # versions of one license: templates that share half of the smaller one's shingles, neither twice the other
        self.rivals: dict[int, set[int]] = {i: set() for i in range(len(self.sets))}
        for i, x in enumerate(self.sets):
            for j, y in enumerate(self.sets[:i]):
                if max(len(x), len(y)) <= 2 * min(len(x), len(y)) and 2 * len(np.intersect1d(x, y)) >= min(len(x), len(y)):
                    self.rivals[i].add(j)
                    self.rivals[j].add(i)
        self.minima = [_minima(s).min(axis=1) for s in self.sets]
        self.maybe = {}
        for half, members in self.levels.items():
            table = np.zeros((BANDS, 1 << 16), bool)
            for i in members:
                table[np.arange(BANDS), self.minima[i] & 0xFFFF] = True
            self.maybe[half] = table

    def candidates(self, shingles: np.ndarray):
        """(template, first, end) of the windows that share a band with a template of their level."""
        top = max(self.levels)
        blocks = _minima(shingles)
        half = 1
        while True:
            if half in self.levels:
                after = np.concatenate([blocks[:, 1:], blocks[:, -1:]], axis=1)
                windows = np.minimum(blocks, after)
                hit = np.zeros(windows.shape[1], bool)
                table = self.maybe[half]
                for band in range(BANDS):
                    hit |= table[band][windows[band] & 0xFFFF]
                for w in np.flatnonzero(hit).tolist():
                    for i in self.levels[half]:
                        if (windows[:, w] == self.minima[i]).any():
                            yield i, w * half, min((w + 2) * half, len(shingles))
            if half >= top:
                return
            if blocks.shape[1] % 2:
                blocks = np.concatenate([blocks, blocks[:, -1:]], axis=1)
            blocks = np.minimum(blocks[:, ::2], blocks[:, 1::2])
            half *= 2

    def scan(self, shingles: np.ndarray, bounds: np.ndarray, percent: int):
        """(text, template, first shingle, last shingle, containment in percent) of the verified matches.

        ``shingles`` holds those of several texts one after another, ``bounds`` where each begins
        and the last ends; a window over a border proposes the same templates, the check is by text.
        """
        reach = 3 * max(self.levels)
        spans: dict[int, list[tuple[int, int]]] = {}
        for at in range(0, len(shingles), CHUNK):
            for i, a, b in self.candidates(shingles[at : at + CHUNK + reach]):
                half = max(1, (b - a) // 2)
                a, b = max(0, at + a - half), min(len(shingles), at + b + half)
                rows = spans.setdefault(i, [])
                # windows of one occurrence overlap: look at them as one
                if rows and a <= rows[-1][1]:
                    rows[-1] = (min(a, rows[-1][0]), max(b, rows[-1][1]))
                else:
                    rows.append((a, b))
        for i, rows in spans.items():
            for a, b in rows:
                for text in range(np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left")):
                    low, high = max(a, int(bounds[text])), min(b, int(bounds[text + 1]))
                    base = int(bounds[text])
                    for first, last, found in self.occurrences(shingles[low:high], i, percent):
                        yield text, i, low + first - base, low + last - base, 100.0 * found / len(self.sets[i])

    def occurrences(self, shingles: np.ndarray, i: int, percent: int):
        """(first, last, number of different shingles) of the spans that hold template i, from left to right."""
        need, reach = -(-percent * len(self.sets[i]) // 100), span_length(len(self.sets[i]), percent)
        places = np.flatnonzero(np.isin(shingles, self.sets[i])).tolist()
        what = shingles[places].tolist() if places else []
        times: dict[int, int] = {}
        left = 0
        k = 0
        while k < len(places):
            times[what[k]] = times.get(what[k], 0) + 1
            while places[k] - places[left] >= reach:
                times[what[left]] -= 1
                if not times[what[left]]:
                    del times[what[left]]
                left += 1
            if len(times) >= need:
                # the rest of this occurrence: up to the last shingle in reach that it hasn't had yet
                end = k
                for j in range(k + 1, len(places)):
                    if places[j] - places[left] >= reach:
                        break
                    if what[j] not in times:
                        times.update({w: times.get(w, 0) + 1 for w in what[end + 1 : j + 1]})
                        end = j
                while times[what[left]] > 1:  # what came before the occurrence
                    times[what[left]] -= 1
                    left += 1
                yield places[left], places[end], len(times)
                times, left, k = {}, end + 1, end
            k += 1

    def best(self, shingles: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple]:
        """The matches of ``scan``, rivals told apart: the best contained one stands, and what a rival of it would share
        of its span is looked for beside it again."""
        out, todo = [], [(-m[4], m[1], m[0], m[2], m[3]) for m in self.scan(shingles, bounds, percent)]
        heapq.heapify(todo)
        taken: dict[int, list[tuple[int, int, int]]] = {}
        while todo:
            share, i, text, first, last = heapq.heappop(todo)
            over = {j for j, a, b in taken.get(text, ()) if (j == i or j in self.rivals[i]) and a <= last and first <= b}
            if i in over:  # found again
                continue
            if not over:
                out.append((text, i, first, last, -share))
                taken.setdefault(text, []).append((i, first, last))
                continue
            # as far as the template could reach on both sides, without what is taken
            base, reach = int(bounds[text]), span_length(len(self.sets[i]), percent)
            spans = sorted((a, b) for j, a, b in taken[text] if j == i or j in self.rivals[i])
            low, top = max(0, first - reach), min(int(bounds[text + 1]) - base, last + 1 + reach)
            for a, b in [*spans, (top, top)]:
                if a - low >= 1:
                    for x, y, found in self.occurrences(shingles[base + low : base + min(a, top)], i, percent):
                        one = (-100.0 * found / len(self.sets[i]), i, text, low + x, low + y)
                        if one not in todo:
                            heapq.heappush(todo, one)
                low = max(low, b + 1)
        return sorted(out)


_MATCH = "doc_id long, license string, first_word long, last_word long, containment double"


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = 80) -> DataFrame:
    """(doc_id, license, first_word, last_word, containment): passages that hold a template; its words as normalised."""
    known = Templates(templates)

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            rows, held, docs_held, size = [], [], [], 0

            def flush(rows=rows, held=held, docs_held=docs_held):
                if held:
                    bounds = np.cumsum([0, *map(len, held)])
                    for text, i, a, b, share in known.best(np.concatenate(held), bounds, percent):
                        rows.append((docs_held[text], known.names[i], a, b + SHINGLE - 1, share))
                held.clear()
                docs_held.clear()

            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = normal_words(text.as_py() or "")
                if len(words) >= SHINGLE:
                    held.append(_shingles(words, hashes))
                    docs_held.append(doc)
                    size += len(words)
                    if size >= CHUNK:
                        flush()
                        size = 0
            flush()
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                ["doc_id", "license", "first_word", "last_word", "containment"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _MATCH)
