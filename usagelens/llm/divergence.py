"""Source divergence audit: how far the words of each source depart from the rest of its language.

Terms are runs of letters: ASCII letters, lower-cased, and all characters outside ASCII. Each language keeps the
terms found in at least ``least_docs`` of its documents. A group (language and source) and the language
itself give each of the V kept terms the share p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), N the sum of counts of kept terms.
Two sources of a language differ by the sum of abs(p - q) over all kept terms; a term stands out in a source by p - q, q the
language's share.

The counts come from sorted pointers: the starts of all terms in an Arrow buffer are sorted by what they point at, eight
bytes at a time, as multikey quicksort does with single characters: a pass sorts by the next eight bytes, and only runs of
equals that have more bytes left go on to the next. In the end each run of equals is a term of this slice, its length
the occurrences, its different rows the documents; by source they are one row each, and Spark adds the rows of all slices.

Sums over pairs of sources are taken in blocks: (shard of terms) x (two blocks of sources) is one bounded group; a term that
no source of both blocks has adds the same each time and is not sent. The result has a row for each ordered pair of
sources of a language, as asked for; all before it is bounded by block.

Odd input: null text, lang and source count as ''; a group without terms is still compared. Repeated rows and ids are documents
of their own. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_ids, stored
from .textops import slices, text_buffer

LEAST_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
UNIT = 1_000_000_000
#: Bytes of text whose term starts are sorted at once; a longer text stands alone.
SLICE_BYTES = 1 << 22
#: Terms in a shard and sources in a block, about; a group of the pair sums holds at most their product twice.
SHARD_TERMS, BLOCK_SOURCES = 1024, 64
#: Parts in which the terms of a group are ranked before the best of all parts are.
RANK_PARTS = 32

_COUNTS = "lang string, source string, term string, docs long, times long"


def term_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the terms in a buffer of texts that begin at ``off``."""
    letter = (raw >= 0x80) | ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    inner = off[(off > 0) & (off < len(raw))]
    first[inner] = letter[inner]
    last[inner - 1] = letter[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def sorted_runs(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pointers by the bytes they point at, number of the run of equals of each ordered pointer)."""
    padded = np.r_[folded, np.zeros(8, np.uint8)]
    window = np.lib.stride_tricks.sliding_window_view(padded, 8)
    keep = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)

    def block(which: np.ndarray, depth: int) -> np.ndarray:
        at = start[which] + depth
        left = np.clip(end[which] - at, 0, 8)
        return window[np.minimum(at, len(folded))].view(">u8").ravel().astype(np.uint64) & keep[left]

    n = len(start)
    order = np.arange(n)
    run = np.zeros(n, np.int64)  # position at which the run of each ordered pointer starts
    live, depth = np.arange(n), 0  # positions in runs of several that fill all bytes so far
    while len(live):
        who = order[live]
        key = block(who, depth)
        by = np.lexsort((key, run[live]))
        who, key, group = who[by], key[by], run[live][by]
        order[live] = who
        step = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        run[live] = live[np.flatnonzero(step)[np.cumsum(step) - 1]]
        depth += 8
        size = np.diff(np.r_[np.flatnonzero(step), len(step)])[np.cumsum(step) - 1]
        live = live[(size > 1) & (key & np.uint64(0xFF) > 0)]  # a term that ends here sorts first in the next pass
    return order, run


def _taken(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of the buffer as strings."""
    off = np.cumsum(np.r_[0, end - start])
    spot = np.repeat(start - off[:-1], end - start) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw[spot])]).cast(pa.string())


def _count(batches):
    """(lang, source, text) to counts by source and term of each slice, and a row with the term '' for each source."""
    for batch in slices(batches, SLICE_BYTES):
        pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        groups = {pair: k for k, pair in enumerate(dict.fromkeys(pairs))}
        group = np.array([groups[p] for p in pairs], np.int64)
        raw, off = text_buffer(batch.column("text"))
        start, end = term_spans(raw, off)
        folded = np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw).astype(np.uint8)
        order, run = sorted_runs(folded, start, end)
        row = np.searchsorted(off, start[order], "right") - 1
        # equal runs: occurrences by row, then rows and occurrences by source
        cell, times = np.unique(run * batch.num_rows + row, return_counts=True)
        run, row = np.divmod(cell, batch.num_rows)
        key, spot, docs = np.unique(run * len(groups) + group[row], return_inverse=True, return_counts=True)
        total = np.bincount(spot, times, len(key)).astype(np.int64)
        run, which = np.divmod(key, len(groups))
        terms = _taken(folded, start[order[run]], end[order[run]])
        names = list(groups)
        lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        out = [lang.take(pa.array(which)), source.take(pa.array(which)), terms, pa.array(docs.astype(np.int64)), pa.array(total)]
        nothing = pa.array([0] * len(names), pa.int64())
        yield pa.RecordBatch.from_arrays(out, names=["lang", "source", "term", "docs", "times"])
        yield pa.RecordBatch.from_arrays([lang, source, pa.array([""] * len(names)), nothing, nothing], names=["lang", "source", "term", "docs", "times"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, times): documents that hold the term and its occurrences, by source; term '' names each source."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))


def _share(count: Column, total: str, kept: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (N + 5 * V)) in whole numbers, beyond 64 bits on the way."""
    wide = lambda c: c.cast("decimal(28,0)")
    over = F.lit(UNIT).cast("decimal(10,0)") * wide(count + F.lit(SMOOTH))
    return F.call_function("div", over, wide(F.col(total) + SMOOTH * F.col(kept))) + 1


def _pair_sums(part: pd.DataFrame) -> pd.DataFrame:
    """Cells of one shard of terms and two blocks of sources to the sums of each pair of sources, one from each block."""
    x, y = part["x"].iloc[0], part["y"].iloc[0]
    who, source = pd.factorize(part["source"])
    term = pd.factorize(part["term"])[0]  # -1: a row that only names its source
    width = int(term.max()) + 1
    none, block = np.zeros(len(source), np.int64), np.zeros(len(source), np.int64)
    none[who], block[who] = part["p_none"], part["block"]
    share = np.repeat(none[:, None], width, axis=1)
    some = term >= 0
    share[who[some], term[some]] = part["p"].to_numpy()[some]
    out = []
    for i in np.flatnonzero(block == x):
        others = np.flatnonzero(block == y)
        others = others[others > i] if x == y else others
        apart = np.abs(share[others] - share[i]).sum(axis=1)
        out += [(min(source[i], source[j]), max(source[i], source[j]), d) for j, d in zip(others, apart.tolist(), strict=True)]
    found = pd.DataFrame(out, columns=["a", "b", "apart"]).assign(lang=part["lang"].iloc[0], covered=width)
    return found[["lang", "a", "b", "apart", "covered"]]


def _apart(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of each ordered pair of sources of a language."""
    size = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES).alias("blocks"), F.ceil(F.max("kept") / SHARD_TERMS).alias("shards"))
    mine = cells.join(size, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards"))
    # every source stands in every shard, so that a shard's terms count for pairs of which one or none has them
    named = groups.where("kept > 0").join(size, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    columns = ["lang", "source", "p_none", "blocks", "shard"]
    mine = mine.select(*columns, "term", "p").unionByName(named.select(*columns, F.lit(None).cast("string").alias("term"), F.col("p_none").alias("p")))
    mine = mine.withColumn("block", F.pmod(F.xxhash64("source"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    mine = mine.select("lang", "source", "term", "p", "p_none", "block", "shard", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    parts = mine.groupBy("lang", "shard", "x", "y").applyInPandas(_pair_sums, "lang string, a string, b string, apart long, covered long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("apart").alias("apart"), F.sum("covered").alias("covered"))
    one = groups.select("lang", "source", "kept", "p_none")
    two = groups.select("lang", F.col("source").alias("item"), F.col("p_none").alias("q_none"))
    pairs = one.join(two, "lang").where("source <> item").withColumn("a", F.least("source", "item")).withColumn("b", F.greatest("source", "item"))
    rest = (F.col("kept") - F.coalesce("covered", F.lit(0))) * F.abs(F.col("p_none") - F.col("q_none"))
    value = F.when(F.col("kept") > 0, F.coalesce("apart", F.lit(0)) + rest).otherwise(0).cast("long")
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", value.alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language with the summed difference, part
    ``term`` the ``top`` terms that stand out in the source; ranks from 1, the largest value first, ties by item."""
    counts = stored(term_counts(docs), "divergence-counts")
    terms = counts.where("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("all_times")).where(F.col("docs") >= least_docs)
    kept = stored(kept.select("lang", "term", "all_times"), "divergence-kept")
    cells = stored(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "times", "all_times"), "divergence-cells")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_times").alias("all_n"))
    groups = counts.where("term = ''").select("lang", "source").join(size, "lang", "left")
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("times").alias("n")), ["lang", "source"], "left").fillna(0, ["kept", "all_n", "n"])
    groups = stored(groups.withColumn("p_none", F.when(F.col("kept") > 0, _share(F.lit(0), "n", "kept"))), "divergence-groups")
    cells = join_ids(cells, groups, ["lang", "source"], "inner", groups.count())
    cells = stored(cells.withColumn("p", _share(F.col("times"), "n", "kept")).withColumn("q", _share(F.col("all_times"), "all_n", "kept")), "divergence-shares")
    apart = _apart(cells, groups)
    ranked = apart.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    over = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # the best of each part first, so that no task holds all terms of a large source
    over = over.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS)))
    by = [F.desc("value"), F.col("item")]
    over = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*by))).where(F.col("rank") <= top)
    over = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by))).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(ranked, "pair").unionByName(columns(over, "term"))
