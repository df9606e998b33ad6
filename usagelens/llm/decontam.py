"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are the lower-cased runs of letters and digits. Every n-gram of every test item is looked up in all
documents. How common an n-gram is in the language shows in the words REACH places before and after it: around
a turn of phrase they are many different ones, around a passage of a test item one side at least has the same word
nearly always, however many documents hold a copy. The smaller of the two counts of different words (a sketch
over the corpus) is the n-gram's rank, and the KEPT rarest found n-grams of every stretch of STRETCH, ties included, are seeds:
no stretch of an item that occurs anywhere is without a seed, and a phrase of many documents seeds none
unless nothing rarer lies around it.

A seed joins a document to an item at a diagonal; around it, words are aligned with the item (match +1,
mismatch and gap -1), and the score is the best local alignment over the item's length. A document
is contaminated if a score reaches ``least``, and in an item under MIN_WORDS words if besides all words but two match
(four at least). Windows that hold too few of the item's words to reach it are not aligned; that bound is exact.
Items under MIN_WORDS words have n-grams of three words; items of two and three words are found by their whole
sequence only, with score 1. A single word is no evidence of a copy: items of one word are left out.

Documents are read once for each block of items and never shuffled whole: of the documents, only those with
a seed are read again to be aligned. A block is sent to the tasks and bounded (about BLOCK_GRAMS words); a larger
benchmark takes more passes, never a larger block.

Odd input: null or wordless texts have no hits. Null doc_id or item_id: the row is left out.
Repeated doc_ids: every text is looked at, the id's best hit counts; repeated item_ids: one text, the greatest.
Empty tables: no hits. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sent, discard, join_ids, stored, text_by_id
from .textops import combine, mix

GRAM = 4
SHORT_GRAM = 3
MIN_WORDS = 8
LEAST_SCORE = 0.5
#: Distance of the words by which an n-gram's neighbourhoods are told apart: wider than common phrases, narrower than items.
REACH = 4
#: Of each run of STRETCH n-grams of an item the KEPT rarest are seeds.
STRETCH, KEPT = 8, 4
BLOCK_GRAMS = 1_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """Stable 64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        h = len(raw)
        for i in range(0, len(raw), 7):
            h = (h * 0x9E3779B97F4A7C15 + int.from_bytes(raw[i : i + 7], "little") + 1) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        if len(self) > 300_000:
            self.clear()
        self[word] = h
        return h


def _hashed(text: str | None, hashes: _Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words_of(text)), np.uint64)


def _item_words(batches):
    hashes = _Hashes()
    for batch in batches:
        words = [_hashed(x, hashes) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {"item_id": batch.column("item_id"), "words": pa.array([w.tobytes() for w in words], pa.binary()), "n_words": pa.array([len(w) for w in words], pa.int64())}
        )


def gram_size(n_words: int) -> int:
    """Words of the n-grams of an item of that many words."""
    return GRAM if n_words >= MIN_WORDS else min(SHORT_GRAM, n_words)


def needed(n_words: int, least: float) -> int:
    """Smallest alignment score that makes a copy of an item of that many words."""
    most = -(-round(least * n_words * 1000) // 1000)
    return max(most, min(n_words, max(GRAM, n_words - 2))) if n_words < MIN_WORDS else most


@dataclass
class Items:
    """A block of test items: their words, and for each size of n-gram the sorted n-grams with item and place."""

    ids: list[int]
    words: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def index_items(ids: list[int], words: list[np.ndarray]) -> Items:
    grams = {}
    for size in sorted({gram_size(len(w)) for w in words if len(w) > 1}):
        mine = [i for i, w in enumerate(words) if len(w) > 1 and gram_size(len(w)) == size]
        runs = [combine(mix(words[i]), size).view(np.int64) for i in mine]
        key, at = np.concatenate(runs), np.concatenate([np.arange(len(r)) for r in runs])
        item = np.repeat(np.array(mine, np.int64), [len(r) for r in runs])
        order = np.argsort(key, kind="stable")
        grams[size] = key[order], item[order], at[order]
    return Items(ids, words, grams)


def seeds_of(items: Items, rank: dict[int, int]) -> Items:
    """The items with those n-grams only that are seeds; ``rank`` has the found n-grams with their number of neighbours."""
    out = {}
    for size, (key, item, at) in items.grams.items():
        if size < SHORT_GRAM:  # whole sequences
            out[size] = key, item, at
            continue
        found = np.array([rank.get(k, -1) for k in key.tolist()], np.int64)
        seed = np.zeros(len(key), bool)
        order = np.lexsort((at, item))
        order = order[found[order] >= 0]
        cuts = np.r_[0, np.flatnonzero(np.diff(item[order])) + 1, len(order)] if len(order) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            one = order[a:b]
            where, how = at[one], found[one]
            for first in range(int(where[0]), max(int(where[0]), int(where[-1]) - STRETCH + 1) + 1):
                low, high = np.searchsorted(where, (first, first + STRETCH))
                if high > low:
                    limit = np.sort(how[low:high])[min(KEPT, high - low) - 1]
                    seed[one[low:high][how[low:high] <= limit]] = True
        out[size] = key[seed], item[seed], at[seed]
    return Items(items.ids, items.words, out)


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``wanted``, index in the sorted ``keys``) of all equal pairs."""
    low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
    n = high - low
    which = np.repeat(np.arange(len(wanted)), n)
    return which, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(which))


def alignment(item: np.ndarray, text: np.ndarray) -> int:
    """Best local alignment (Smith-Waterman) of two word sequences: match 1, mismatch -1, gap -1."""
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best = 0
    for word in item:
        new = np.maximum(0, row - 1)
        np.maximum(new[1:], row[:-1] + np.where(text == word, 1, -1), out=new[1:])
        # a gap in the item: the best value to the left, less the distance
        row = np.maximum.accumulate(new + step) - step
        best = max(best, int(row.max()))
    return best


def _best(item: np.ndarray, words: np.ndarray, starts: np.ndarray, most: int) -> tuple[int, int, int]:
    """(matched, first word, last word) of the best alignment around sorted ``starts``; (0, 0, 0) if none can reach ``most``."""
    # a start says where the item would begin; overlapping windows are one
    half = len(item) // 2
    cut = np.flatnonzero(np.diff(starts) > len(item) + 2 * half)
    best = (0, 0, 0)
    for a, b in zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist(), strict=True):
        low, high = max(0, a - half), min(b + len(item) + half, len(words))
        part = words[low:high]
        present = set(part.tolist())
        if sum(w in present for w in item.tolist()) >= most:
            best = max(best, (alignment(item, part), low, high))
    return best


_BITS = 22
_MATCHED = "doc_id long, text_hash long, size int, grams binary, before binary, after binary"
_FOUND = "doc_id long, item_id long, matched long, n_words long, first_word long, last_word long"


def _matches(sent, batches):
    """(doc_id, text_hash, text) to the item n-grams in each text, each with the words REACH places before and after it (0 beyond the text)."""
    items = sent.value
    # a table of low bits answers for most n-grams, a sorted search for the rest
    keys = {size: np.unique(key) for size, (key, _, _) in items.grams.items()}
    maybe = {size: np.bincount(key & ((1 << _BITS) - 1), minlength=1 << _BITS) > 0 for size, key in keys.items()}
    hashes = _Hashes()
    for batch in batches:
        rows = []
        for doc, name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), strict=True):
            words = _hashed(text.as_py(), hashes)
            mixed = mix(words)
            none = np.zeros(REACH, np.uint64)
            around = np.r_[none, words, none].view(np.int64)
            for size, key in keys.items():
                g = combine(mixed, size).view(np.int64)
                at = np.flatnonzero(maybe[size][g & ((1 << _BITS) - 1)])
                if len(at):
                    at = at[key[np.minimum(np.searchsorted(key, g[at]), len(key) - 1)] == g[at]]
                if len(at):
                    # a text that repeats an n-gram between the same words says nothing new
                    one = np.unique(np.c_[g[at], around[at], around[at + size + 2 * REACH - 1]], axis=0)
                    rows.append((doc, name, size, *[np.ascontiguousarray(one[:, k]).tobytes() for k in range(3)]))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in _MATCHED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _neighbours(batches):
    """Matched n-grams to (gram, side, word), each once in a batch."""
    for batch in batches:
        gram, before, after = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("grams", "before", "after"))
        both = [np.unique(np.c_[gram, word], axis=0) for word in (before, after)]
        one = np.concatenate(both)
        side = np.repeat([0, 1], [len(x) for x in both]).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"gram": one[:, 0].copy(), "side": side, "word": one[:, 1].copy()})


def _with_seed(sent, batches):
    """Matched texts to (doc_id, text_hash) of those that hold a seed."""
    keys = {size: np.unique(key) for size, (key, _, _) in sent.value.grams.items()}
    for batch in batches:
        size = batch.column("size").to_pylist()
        hold = [bool(np.isin(np.frombuffer(g, np.int64), keys[n]).any()) for n, g in zip(size, batch.column("grams").to_pylist(), strict=True)]
        yield batch.select(["doc_id", "text_hash"]).filter(pa.array(hold, pa.bool_()))


def _align(sent, least, batches):
    """(doc_id, text) to the best score of each item that a seed joins and that can reach ``least``."""
    items = sent.value
    hashes = _Hashes()
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = _hashed(text.as_py(), hashes)
            mixed = mix(words)
            for size, (key, of_item, of_at) in items.grams.items():
                which, spot = _places(key, combine(mixed, size).view(np.int64))
                item, start = of_item[spot], which - of_at[spot]
                order = np.lexsort((start, item))
                item, start = item[order], start[order]
                cuts = np.r_[0, np.flatnonzero(np.diff(item)) + 1, len(item)] if len(item) else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    i = int(item[a])
                    n = len(items.words[i])
                    best = (n, int(start[a]), int(start[a]) + n) if n == size else _best(items.words[i], words, start[a:b], needed(n, least))
                    if best[0] >= needed(n, least):
                        rows.append((doc, items.ids[i], best[0], n, best[1], best[2]))
        names = [c.split()[0] for c in _FOUND.split(", ")]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)})


def _of_block(texts: DataFrame, items: Items, least: float) -> DataFrame:
    """Hits of one block of items in all texts."""
    spark = texts.sparkSession
    sent = Sent(spark, items)
    matched = stored(texts.mapInArrow(lambda b: _matches(sent, b), _MATCHED), "test-matches")
    words = matched.select("grams", "before", "after").mapInArrow(_neighbours, "gram long, side int, word long")
    ranks = words.groupBy("gram", "side").agg(F.approx_count_distinct("word", 0.05).alias("n")).groupBy("gram").agg(F.min("n").alias("n"))
    seeds = seeds_of(items, {r.gram: r.n for r in ranks.collect()})  # n-grams of this block, about BLOCK_GRAMS at most
    sent_seeds = Sent(spark, seeds)
    chosen = matched.select("doc_id", "text_hash", "size", "grams").mapInArrow(lambda b: _with_seed(sent_seeds, b), "doc_id long, text_hash long").distinct()
    chosen = stored(chosen, "test-documents")
    again = join_ids(texts, chosen, ["doc_id", "text_hash"], "inner", chosen.count())
    out = stored(again.select("doc_id", "text").mapInArrow(lambda b: _align(sent_seeds, least, b), _FOUND), "test-found")
    discard(matched, chosen)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): documents with a copy of a test item, edited or not.

    ``first_word`` and ``last_word`` bound the words in which the alignment was found.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    items = text_by_id(benchmark.select(F.col("item_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item_id")
    items = stored(items.mapInArrow(_item_words, "item_id long, words binary, n_words long").where("n_words > 1"), "test-items")
    n_blocks = max(1, -(-(items.agg(F.sum("n_words")).first()[0] or 0) // BLOCK_GRAMS))
    found = None
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()  # about BLOCK_GRAMS words
        some = _of_block(texts, index_items([r.item_id for r in part], [np.frombuffer(r.words, np.uint64) for r in part]), least)
        found = some if found is None else found.unionByName(some)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "n_words", "first_word", "last_word")).alias("best"))
    return best.select("doc_id", "item_id", (F.col("best.matched") / F.col("best.n_words")).alias("score"), "best.first_word", "best.last_word")
