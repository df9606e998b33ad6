"""Periodic runs of words, from the maximal pairs of each text's LCP-interval tree.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(LEAST_LENGTH, 2 * q)`` that no neighbouring word extends keeping that period.

Two places i < j of a text whose next l words agree, whose word l later differs (or is the text's end)
and whose words before them differ (or i is the text's start) are a maximal pair. With q = j - i and
l >= q its words repeat without a gap, so i .. j + l is already a stretch of period q that neither side
extends: the maximal pairs with ``l >= max(q, LEAST_LENGTH - q)`` are exactly the runs, each with its
period's multiples too, of which the smallest period stays.

The pairs come from the suffixes of a text in sorted order and the lengths of common prefixes (LCP) of
neighbours. Uniting neighbours by falling LCP walks the tree of LCP intervals bottom-up: two places that
come together at l agree in exactly l words. Each interval keeps its places in order, together with the
class of the word on their left; the smaller one is merged into the larger, and places that become
neighbours and are of different classes are maximal pairs. Pairs that are no neighbours aren't looked at:
a place between i and j, where the same words start, cuts the period q into two, so that (l >= q) the stretch
has a smaller one. So a text of n words costs O(n log n) merges, however often its words repeat.

Only places that share LEAST_LENGTH / 2 words with another one of their text can be in a pair (l >= q and
l >= LEAST_LENGTH - q), so the tree is built above that depth. Texts never meet each other; the work is
one pass over the table without a shuffle, some texts at a time.

Odd input: null, empty or blank text: no words, no runs. Null doc_id: scored like any other row. Repeated
rows are scored one by one. Empty table: empty result. Other columns are not read or returned.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices

LEAST_LENGTH = 12
#: Bytes of text whose suffixes are sorted at once; a longer text stands alone.
SLICE_BYTES = 1 << 20


def _firsts(sorted_key: np.ndarray) -> np.ndarray:
    """For each entry the position of the first one equal to it."""
    step = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    return np.flatnonzero(step)[np.cumsum(step) - 1]


def suffix_neighbours(codes: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, next place, LCP) of neighbours in the order of the suffixes, for LCPs of at least ``least`` words.

    ``codes`` are the words of several texts, no code in two texts; ``ends`` is the end of each word's text.
    A place's rank by its first 1, 2, 4, ... words is 1 + the number of places before its equals; who is
    alone in its rank has its position and is sorted no more.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _firsts(codes[order]) + 1 if n else 0
    levels, width, open_ = [rank], 1, order
    while True:
        group = rank[open_]
        open_ = open_[np.bincount(group, minlength=1)[group] > 1]
        if not len(open_):
            break
        after = open_ + width
        tail = np.where(after < ends[open_], rank[np.minimum(after, n - 1)], 0)
        key = rank[open_] * (n + 2) + tail
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        group = rank[open_]
        rank = rank.copy()
        rank[open_] = group + _firsts(key) - _firsts(group)
        levels.append(rank)
        width *= 2
    top = least.bit_length() - 1
    if top >= len(levels):
        return (np.zeros(0, np.int64),) * 3
    order = np.empty(n, np.int64)
    order[rank - 1] = np.arange(n)
    i, j = order[:-1], order[1:]
    near = levels[top][i] == levels[top][j]
    i, j = i[near], j[near]
    lcp = np.zeros(len(i), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        inside = (a < ends[i]) & (b < ends[j])
        same = inside & (levels[depth][np.minimum(a, n - 1)] == levels[depth][np.minimum(b, n - 1)])
        lcp += np.where(same, 1 << depth, 0)
    deep = lcp >= least
    return i[deep], j[deep], lcp[deep]


def runs(codes: np.ndarray, ends: np.ndarray, least_length: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of the texts, by start and period."""
    i, j, lcp = suffix_neighbours(codes, ends, (least_length + 1) // 2)
    if not len(i):
        return []
    starts = np.r_[True, ends[1:] != ends[:-1]]  # a text's first word has no word before it
    left = np.r_[-1, codes[:-1]]
    left[starts] = -1 - np.flatnonzero(starts)
    down = np.argsort(-lcp, kind="stable")
    used = np.unique(np.r_[i, j])
    owner = {}
    places: list[list[int]] = []
    for place in used.tolist():
        owner[place] = len(places)
        places.append([place])
    parent = list(range(len(places)))
    before = dict(zip(used.tolist(), left[used].tolist(), strict=True))
    best: dict[tuple[int, int], int] = {}

    def pair(a: int, b: int, common: int) -> None:
        gap = b - a
        if common >= gap and common + gap >= least_length and before[a] != before[b]:
            key = (a, gap + common)
            if gap < best.get(key, gap + 1):
                best[key] = gap

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, common in zip(i[down].tolist(), j[down].tolist(), lcp[down].tolist(), strict=True):
        x, y = root(owner[a]), root(owner[b])
        if len(places[x]) < len(places[y]):
            x, y = y, x
        large, small = places[x], places[y]
        # all neighbours first, then the merge: places of one child are never paired with each other
        spots = []
        for k, place in enumerate(small):
            at = bisect_left(large, place)
            spots.append(at)
            if at and (k == 0 or small[k - 1] < large[at - 1]):
                pair(large[at - 1], place, common)
            if at < len(large) and (k + 1 == len(small) or large[at] < small[k + 1]):
                pair(place, large[at], common)
        if len(small) < 64:
            for at, place in zip(reversed(spots), reversed(small), strict=True):
                large.insert(at, place)
        else:
            large += small
            large.sort()
        places[y] = []
        parent[y] = x
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def unrolled(words: list[bytes], h: int) -> list[bytes]:
    """The words of a document whose checksum is h: for one in ten, from some word on the first few repeat."""
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // p + 1))[: n - a]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64())]
    + [(c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))]
)


def _describe(doc: int | None, words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, n, q in found:
            drop[s + q] += 1
            drop[s + n] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return (
        doc, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found],
    )


def _scan(unroll: bool):
    def run(batches):
        for batch in slices(batches, SLICE_BYTES):
            texts, sizes, number = [], [], count()
            vocabulary: dict[bytes, int] = {}
            codes = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                if unroll and doc is not None:
                    words = unrolled(words, zlib.crc32(str(doc).encode()))
                # one code for each different word of this text; another text's words have other codes
                vocabulary.clear()
                codes.append(np.fromiter(map(vocabulary.setdefault, words, number), np.int64, len(words)))
                texts.append((doc, words))
                sizes.append(len(words))
            off = np.cumsum([0, *sizes])
            found = runs(np.concatenate(codes), np.repeat(off[1:], sizes))
            by_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for (s, n, q), k in zip(found, (np.searchsorted(off, [r[0] for r in found], "right") - 1).tolist(), strict=True):
                by_text[k].append((s - int(off[k]), n, q))
            rows = [_describe(doc, words, own) for (doc, words), own in zip(texts, by_text, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def periodic_runs(docs: DataFrame, unroll: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_runs, the longest run (ties: smallest start, then period) as start, length, period
    and exponent_milli, digests of all runs and of the text without what repeats, and the runs themselves (start, length, period).

    The collapsed text drops each word that a run holds after its first period. With ``unroll`` the documents whose crc32
    of the id is a multiple of ten are first made periodic from some word on (planted runs, for tests and audits).
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    return narrow.mapInArrow(_scan(unroll), schema + "runs array<struct<start:long,length:long,period:long>>")
