"""Fuzzy line dedup: MinHash bands, exact Jaccard verification, one line kept for each component.

Lines are the parts of a text between newlines. A line's form is its lower-cased words joined by
one space; every line with a word has one, however short. Equal forms are one line from the start;
of the distinct forms, character shingles are hashed into bins whose minima make the MinHash
signature, bands of it name candidates, candidates are verified on their exact shingle sets, and
linked forms unite. A form shorter than a shingle equals only itself and needs no bands.
Of each component the first line (smallest doc_id, then line number) stays, the others go.

Two forms are near if the Jaccard similarity of their shingle sets reaches ``percent``. Shingles have SHORT characters
between forms under WIDE characters, where one changed character must not break too many, and LONG
characters between forms of LONG_FROM and more, where short ones are common to all of a language; forms of
LONG_FROM to WIDE characters are compared both ways, so that no pair falls between the two.

The bands miss a pair of similarity 0.8 with a probability of under 1 %, one of 0.85 of 0.2 % (BANDS bands of
ROWS minima). What they propose is compared without caps (see ``pairs``).

Odd input: null or empty text: unchanged, no lines. Null doc_id: the row keeps all its lines, as
its place among others is undefined. Repeated doc_id: equal lines at the same place count as one
and stay in all these rows; a place that goes, goes in all of them. Empty table: empty result.
Other columns are kept.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .pairs import SEGMENT, bucket_links
from .shared import discard, free_name, join_ids, stored, text_by_id
from .textops import mix, slices

#: Characters of the shingles of short and of long forms: at 80 % a line of 40 characters with one changed character
#: still meets its original by shingles of 4.
SHORT, LONG = 4, 8
LONG_FROM, WIDE = 128, 160
BANDS, ROWS = 12, 5
BINS = BANDS * ROWS
#: Hubs that a bucket's lines are compared with before those still apart are compared with each other: many lines near the
#: threshold meet in large buckets, which one hub leaves in many components.
HUB_ROUNDS = 2
#: In buckets of at most so many lines all pairs are compared at once: at most (ALL_PAIRS - 1) / 2 pairs a member.
ALL_PAIRS = 16
#: Band keys of a part that is sorted at once, the least number of parts, lines whose keys are dealt to the parts together, and pairs compared together.
PART_KEYS, LEAST_PARTS, DEALT_LINES, PAIRS = 1 << 18, 256, 1 << 14, 256
#: For each bin the order in which an empty one asks the others; neighbours ask independently, so that the minima of a
#: band do not all come from one shingle of a short line.
_DONORS = np.random.default_rng(5).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def line_form(line: str) -> str | None:
    return " ".join(line.lower().split()) or None


def sizes(form: str) -> list[int]:
    """The sizes of shingles by which a form is compared, the main one first."""
    if len(form) < LONG_FROM:
        return [SHORT]
    return [LONG, SHORT] if len(form) < WIDE else [LONG]


def _line_id(form: str) -> int:
    """An even number; the next one stands for the form as it is compared by its second size of shingles."""
    return int.from_bytes(hashlib.blake2b(form.encode(), digest_size=8).digest(), "little", signed=True) & ~1


def _shingles(forms: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all character shingles, n+1 offsets of the forms); a shorter form is one shingle. ``k`` is a power of two."""
    joined = "".join([f.ljust(k, "\0") for f in forms])
    value = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    width, power = 1, 0x9E3779B97F4A7C15
    while width < k:  # a polynomial of twice as many characters from two halves
        value = value[:-width] * np.uint64(power) + value[width:]
        width, power = 2 * width, power * power % (1 << 64)
    length = np.array([max(len(f), k) for f in forms], np.int64)
    start = np.cumsum(length) - length
    count = length - k + 1
    off = np.r_[0, np.cumsum(count)]
    inside = np.ones(len(value), bool)  # not across two forms
    for i in range(1, k):
        inside[start[1:] - i] = False
    return mix(value[inside]), off


def _portions(items: list[tuple[int, str]], chars: int):
    """``items`` (row, form) in runs of about so many characters, of which the arrays stay in the processor's cache."""
    part, size = [], 0
    for item in items:
        part.append(item)
        size += len(item[1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _signatures(forms: list[str], k: int) -> np.ndarray:
    """(forms x BANDS) band keys: each bin's smallest hash, an empty bin taking over from the first of its donors that has any."""
    hashes, off = _shingles(forms, k)
    spot = (hashes >> np.uint64(40)).astype(np.uint32)
    spot -= spot // np.uint32(BINS) * np.uint32(BINS)
    spot = spot + np.repeat(np.arange(len(forms)) * BINS, np.diff(off))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full(len(forms) * BINS, top, np.uint64)
    np.minimum.at(low, spot, hashes * np.uint64(0xD6E8FEB86659FD93))
    low = low.reshape(-1, BINS)
    filled = low.copy()
    row, spot = np.nonzero(low == top)
    for step in range(BINS):
        if not len(row):
            break
        found = low[row, _DONORS[spot, step]]
        filled[row, spot] = found
        row, spot = row[found == top], spot[found == top]
    keys = np.zeros((len(forms), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + filled.reshape(-1, BANDS, ROWS)[:, :, r])
    return mix(keys + np.arange(BANDS, dtype=np.uint64) + np.uint64(k << 20)).view(np.int64)


_LINE = "doc_id long, line long, line_id long, bands binary"
#: Characters of lines that are hashed at once.
CHUNK_CHARS = 1 << 20
#: Characters whose shingles are hashed together.
PORTION = 1 << 18


def _lines(batches):
    """(doc_id, text) to its lines; the first of equal lines of a slice carries the bands, of its main size of shingles first."""
    for batch in slices(batches, CHUNK_CHARS):
        docs, numbers, ids, long, short = [], [], [], [], []
        seen: set[int] = set()
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for no, line in enumerate((text.as_py() or "").lower().split("\n")):
                form = " ".join(line.split())  # line_form
                if not form:
                    continue
                line_id = _line_id(form)
                if line_id not in seen and (n := len(form)) >= SHORT:
                    seen.add(line_id)
                    if n >= LONG_FROM:
                        long.append((len(ids), form))
                    if n < WIDE:
                        short.append((len(ids), form))
                docs.append(doc)
                numbers.append(no)
                ids.append(line_id)
        bands: list[bytes | None] = [None] * len(ids)
        for k, mine in ((LONG, long), (SHORT, short)):  # a form compared both ways has LONG as its main size
            for part in _portions(mine, PORTION):
                for (row, _), keys in zip(part, _signatures([f for _, f in part], k), strict=True):
                    bands[row] = (bands[row] or b"") + keys.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()), pa.array(bands, pa.binary())], names=["doc_id", "line", "line_id", "bands"]
        )


def _dealt(parts: int):
    """(line_id, bands) to rows (part, grams, line_ids) of packed numbers; equal grams have the same of ``parts`` parts."""

    def cut(blobs: list[bytes], lines: list[int]) -> pa.RecordBatch:
        times = np.array([len(b) // 8 for b in blobs], np.int64)
        grams = np.frombuffer(b"".join(blobs), np.int64)
        place = np.arange(len(grams)) - np.repeat(np.cumsum(times) - times, times)
        ids = np.repeat(np.array(lines, np.int64), times) + (place >= BANDS)
        part = (((grams.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, grams, ids = part[order], grams[order], ids[order]
        begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[begin[1:], len(part)]
        packed = ([x[a:b].tobytes() for a, b in zip(begin, ends, strict=True)] for x in (grams, ids))
        return pa.RecordBatch.from_arrays([pa.array(part[begin]), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "grams", "line_ids"])

    def run(batches):
        blobs, lines = [], []
        for batch in batches:
            blobs += batch.column("bands").to_pylist()
            lines += batch.column("line_id").to_pylist()
            if len(blobs) >= DEALT_LINES:
                yield cut(blobs, lines)
                blobs, lines = [], []
        if blobs:
            yield cut(blobs, lines)

    return run


def _shared(batches):
    """Rows (gram, line_id) in this order to those whose gram several different lines have, each once."""
    gram, lines = None, []  # the last run of equal grams may go on in the next batch

    def part(grams: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        step = np.r_[True, (grams[1:] != grams[:-1]) | (ids[1:] != ids[:-1])][: len(grams)]
        grams, ids = grams[step], ids[step]
        begin = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
        several = np.repeat(np.diff(np.r_[begin, len(grams)]) > 1, np.diff(np.r_[begin, len(grams)]))
        return pa.RecordBatch.from_pydict({"line_id": ids[several], "gram": grams[several]})

    for batch in batches:
        grams, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("gram", "line_id"))
        if not len(grams):
            continue
        if gram is not None:
            grams, ids = np.r_[np.full(len(lines), gram), grams], np.r_[lines, ids]
        cut = int(np.searchsorted(grams, grams[-1], "left"))
        gram, lines = grams[-1], np.unique(ids[cut:])
        yield part(grams[:cut], ids[:cut])
    if gram is not None:
        yield part(np.full(len(lines), gram), lines)


def _meetings(batches):
    """Rows (part, grams, line_ids) in the order of parts to rows (a, b) of all pairs in small buckets and rows (a, gram) of the members of large ones."""

    def met(part: list[tuple[bytes, bytes]]):
        grams, ids = (np.frombuffer(b"".join(x), np.int64) for x in zip(*part, strict=True))
        order = np.lexsort((ids, grams))
        for found in _shared(iter([pa.RecordBatch.from_pydict({"line_id": ids[order], "gram": grams[order]})])):
            grams, ids = found.column("gram").to_numpy(), found.column("line_id").to_numpy()
            begin = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
            size = np.diff(np.r_[begin, len(grams)])
            pairs = []
            for n in range(2, ALL_PAIRS + 1):
                x, y = np.triu_indices(n, 1)
                first = begin[size == n][:, None]
                pairs.append(np.stack([ids[first + x].ravel(), ids[first + y].ravel()]))
            a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "gram"])
            large = np.repeat(size > ALL_PAIRS, size)
            yield pa.RecordBatch.from_arrays([pa.array(ids[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(grams[large])], names=["a", "b", "gram"])

    now, part = None, []
    for batch in batches:
        for no, grams, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "grams", "line_ids")), strict=True):
            if no != now and part:
                yield from met(part)
                part = []
            now = no
            part.append((grams, ids))
    if part:
        yield from met(part)


def _form_sets(forms: list[bytes]) -> list[np.ndarray]:
    """The shingle sets of forms, each led by a byte that gives the size of its shingles."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(forms)
    for k in (SHORT, LONG):
        mine = [(i, f[1:].decode()) for i, f in enumerate(forms) if f[0] == k]
        for part in _portions(mine, PORTION):
            hashes, off = _shingles([f for _, f in part], k)
            for (i, _), a, b in zip(part, off[:-1], off[1:], strict=True):
                out[i] = np.unique(hashes[a:b])
    return out


def _numbered_sets(forms: list[str], k: int) -> np.ndarray:
    """The shingles of forms, sorted by the number of their form and each once: the number in the upper 16 bits, 48 bits of the hash below."""
    hashes, off = _shingles(forms, k)
    number = np.repeat(np.arange(len(forms), dtype=np.uint64) << np.uint64(48), np.diff(off))
    keys = np.sort(number | (hashes >> np.uint64(16)))
    return keys[np.r_[True, keys[1:] != keys[:-1]]]


def _near(percent: int):
    """Rows with two forms to (a, b) of those whose shingle sets are near."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            left, right = (batch.column(c).to_pylist() for c in ("form_a", "form_b"))
            ok = np.zeros(len(a), bool)
            for k in (SHORT, LONG):
                mine = [(i, (x[1:].decode(), y[1:].decode())) for i, (x, y) in enumerate(zip(left, right, strict=True)) if x[0] == k and y[0] == k]
                for at in range(0, len(mine), PAIRS):
                    rows, (x, y) = [i for i, _ in mine[at : at + PAIRS]], (list(f) for f in zip(*(p for _, p in mine[at : at + PAIRS]), strict=True))
                    x, y = _numbered_sets(x, k), _numbered_sets(y, k)
                    both = np.sort(np.concatenate([x, y]))
                    n_x, n_y, n = (np.bincount((v >> np.uint64(48)).astype(np.int64), minlength=len(rows)) for v in (x, y, both[1:][both[1:] == both[:-1]]))
                    ok[rows] = 100 * n >= percent * (n_x + n_y - n)
            yield pa.RecordBatch.from_pydict({"a": a[ok], "b": b[ok]})

    return run


def _forms(batches):
    """(text, at), the numbers and ids of lines of the text, to the forms of these lines, each led by the size of its shingles:
    the set is made where it is needed, a form is an eighth of its hashes. A form that is compared both ways gives two rows."""
    for batch in slices(batches, CHUNK_CHARS):
        at = batch.column("at")
        times = np.diff(at.offsets.to_numpy()).tolist()
        wanted = zip(*(at.flatten().field(c).to_pylist() for c in ("line", "line_id")), strict=True)
        ids, forms = [], []
        for text, n in zip(batch.column("text"), times, strict=True):
            lines = text.as_py().split("\n")
            for no, line_id in islice(wanted, n):
                form = line_form(lines[no]) or ""
                for second, k in enumerate(sizes(form)):
                    ids.append(line_id + second)
                    forms.append(bytes([k]) + form.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.binary())], names=["line_id", "form"])


def _line_sets(batches):
    """(line_id, form) to segments with the size of the form's shingle set."""
    for batch in batches:
        forms = batch.column("form").to_pylist()
        yield pa.RecordBatch.from_pydict(
            {
                "fragment": pa.array([0] * len(forms), pa.int64()),
                "doc_id": batch.column("line_id"),
                "n": pa.array([len(s) for s in _form_sets(forms)], pa.int64()),
                "grams": pa.array(forms, pa.binary()),
            }
        )


def _plain(c: str) -> Column:
    """The line's id, whichever way it was compared."""
    return F.col(c).bitwiseAND(F.lit(-2).cast("long"))


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, lines): the numbers of those lines (from 0) of each document that repeat an earlier line."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    lines = stored(texts.mapInArrow(_lines, _LINE), "lines")
    place = F.struct("doc_id", "line")
    distinct = stored(lines.groupBy("line_id").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("times")), "lines-distinct")
    keys = lines.where(F.col("bands").isNotNull()).select("line_id", "bands")
    dealt = keys.mapInArrow(_dealt(LEAST_PARTS + lines.count() * BANDS // PART_KEYS), "part long, grams binary, line_ids binary")
    # a line that stands in several batches has its bands as often; a bucket matters if different lines are in it
    met = stored(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_meetings, "a long, b long, gram long"), "lines-met")
    pairs = met.where(F.col("b").isNotNull()).select("a", "b")
    large = met.where(F.col("b").isNull()).select(F.col("a").alias("line_id"), "gram")
    # texts of the candidate lines, each read where it first stands
    named = pairs.select(F.explode(F.array("a", "b")).alias("line_id")).unionByName(large.select("line_id"))
    named = named.select(_plain("line_id").alias("line_id")).distinct()
    wanted = stored(distinct.select("line_id", "place.doc_id", "place.line").join(named, "line_id"), "lines-wanted")
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "line_id")).alias("at"))
    per_doc = stored(per_doc, "lines-documents")
    found = join_ids(text_by_id(docs).where(F.col("text").isNotNull()), per_doc, "doc_id", "inner", wanted.count())
    forms = stored(found.select("text", "at").mapInArrow(_forms, "line_id long, form binary"), "lines-forms")
    done = [met, wanted, per_doc, forms]
    left, right = (forms.select(F.col("line_id").alias(c), F.col("form").alias(f"form_{c}")) for c in ("a", "b"))
    both = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "form_a", "form_b")
    edges = both.mapInArrow(_near(percent), "a long, b long")
    if large.limit(1).count():
        members = stored(large, "lines-members")
        shared = stored(members.groupBy("line_id").agg(F.count(F.lit(1)).alias("shared")), "lines-shared")
        sets = stored(forms.join(shared.select("line_id"), "line_id").mapInArrow(_line_sets, SEGMENT), "lines-sets")
        buckets = members.join(shared, "line_id").join(sets.select(F.col("doc_id").alias("line_id"), "n"), "line_id")
        buckets = buckets.select(F.col("line_id").alias("doc_id"), "n", "shared", "gram")
        links, read = bucket_links(sets, buckets, percent, _form_sets, HUB_ROUNDS)
        done += [members, shared, sets, *read]
        edges = edges.unionByName(links.select("a", "b"))
    # a line that is compared both ways is one line
    edges = stored(edges.select(_plain("a").alias("a"), _plain("b").alias("b")), "lines-edges")
    linked = stored(components(edges).select(F.col("id").alias("line_id"), "component"), "lines-linked")
    discard(edges, *done)
    # the first place of each component stays
    united = stored(join_ids(distinct.select("line_id", "place"), linked, "line_id", "inner", linked.count()), "lines-united")
    best = stored(united.groupBy("component").agg(F.min("place").alias("best")), "lines-best")
    moved = stored(united.join(best, "component").where("place <> best").select("line_id", "best"), "lines-moved")
    # a line that stands once and is no other's copy can't go
    first = join_ids(distinct, moved, "line_id", "left", moved.count()).where((F.col("times") > 1) | F.col("best").isNotNull())
    first = first.select("line_id", F.coalesce("best", "place").alias("keep"))
    first = stored(first, "lines-first")
    again = lines.select("doc_id", "line", "line_id").join(first, "line_id").where(place != F.col("keep"))
    gone = stored(again.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")), "lines-gone")
    discard(lines, distinct, linked, united, best, moved, first)
    return gone


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with ``text`` lacking its repeated lines, and the long columns n_lines and n_dropped (replaced, if there already)."""
    gone = repeated_lines(docs, percent)
    n_gone = gone.agg(F.sum(F.size("lines"))).first()[0] or 0
    id_, drop = free_name("gone_id", docs.columns), free_name("gone", docs.columns)
    gone = gone.select(F.col("doc_id").alias(id_), F.col("lines").alias(drop))
    parts = F.split("text", "\n")
    kept = F.filter(F.arrays_zip(parts.alias("part"), F.sequence(F.lit(0), F.size(parts) - 1).alias("no")), lambda x: ~F.array_contains(drop, x["no"].cast("long")))
    joined = join_ids(docs.withColumn(id_, F.col("doc_id").cast("long")), gone, id_, "left", n_gone)
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["part"]), "\n"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in others],
        F.when(F.col("text").isNull() | (F.col("text") == ""), F.lit(0)).otherwise(breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )
