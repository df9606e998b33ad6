"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams (by their hash) is cut into fragments. Each fragment counts
overlaps of its own n-grams only, and the partial counts are summed:

1. Every text sends each of its n-grams once to the n-gram's fragment. A fragment counts, per
   document, the n-grams that occur in some other document too; the sums bound the overlap that
   the document can have with any other. Who stays below 80 % of its set has no link.
   N-grams met twice within one Arrow batch are shared for sure and go out once for the batch,
   so a frequent n-gram costs one entry for each batch, not for each document.
2. Documents with equal sets form classes; one representative of each goes on.
3. Fragments count the frequencies among representatives; the rarest n-grams of each (the
   prefix that any linked pair must share) name its candidate buckets.
4. In each bucket all members are paired with one hub, the member with the most shared n-grams;
   members that this leaves in different components are then paired with each other if length
   and a parity bitmap (a lower bound of the symmetric difference) allow a link.
5. Each pair's overlap is counted by fragment and summed; the exact test follows, then components.

Nothing is capped or sampled: a pair is left out only if a bound shows that it can't link, or if
both already lie in one component.

Results for odd input: null or wordless text: empty set, own component. Fewer than five words: the
whole sequence is the only n-gram. Null doc_id: the row is left out, nothing can name it. Repeated doc_id: one document,
the greatest of its texts. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import SEGMENT, bucket_components
from .shared import join_ids, stored, text_by_id
from .textops import WordHasher, least_overlap, mix, shingle_sets, slices

#: Bytes of text for each fragment of the first count: about 2 million n-grams.
FRAGMENT_BYTES = 12_000_000
#: Least number of fragments. Each fragment reports a document once at most, so below this number the
#: reports of a document would grow with the number of fragments, and all reports faster than the input.
MIN_FRAGMENTS = 64
#: Bytes of text that are hashed and sorted at once.
SLICE_BYTES = 2 << 20
#: Fragments of the counts among representatives.
PAIR_FRAGMENTS = 8


def _fragment(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _packed(x: np.ndarray, dtype) -> bytes:
    return np.ascontiguousarray(x, dtype).tobytes()


_SENT = "fragment long, docs binary, runs binary, grams binary, shared binary, sizes binary"


def _send(n_fragments: int):
    """Arrow batches of (doc_id, text) to one row for each fragment of each batch."""

    def send(batches):
        hasher = WordHasher()
        for batch in slices(batches, SLICE_BYTES):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            sets = shingle_sets(*hasher.words(batch.column("text")))
            size = np.array([len(s) for s in sets], np.int64)
            grams = np.concatenate(sets)
            owner = np.repeat(np.arange(len(ids)), size)
            order = np.argsort(grams, kind="stable")
            ranked = grams[order]
            same = np.zeros(len(grams) + 1, bool)
            same[1:-1] = ranked[1:] == ranked[:-1]
            twice = np.zeros(len(grams), bool)
            twice[order] = same[1:] | same[:-1]
            local = np.bincount(owner[twice], minlength=len(ids))
            shared = ranked[same[1:] & ~same[:-1]]  # the first of each equal run
            fp1 = np.zeros(len(ids), np.uint64)
            fp2 = np.zeros(len(ids), np.uint64)
            np.add.at(fp1, owner, mix(grams))
            np.add.at(fp2, owner, mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            stats = np.stack([ids, size, local, fp1.view(np.int64), fp2.view(np.int64)], axis=1)
            grams, owner = grams[~twice], owner[~twice]
            at = _fragment(grams, n_fragments).astype(np.uint16 if n_fragments < 65536 else np.uint64)
            order = np.argsort(at, kind="stable")
            grams, owner = grams[order].astype(np.uint32), owner[order]
            cut = np.searchsorted(at[order], np.arange(n_fragments + 1))
            cut_shared = np.searchsorted(_fragment(shared, n_fragments), np.arange(n_fragments + 1))
            shared = shared.astype(np.uint32)
            home = int(ids[0]) % n_fragments
            rows = {k: [] for k in ("fragment", "docs", "runs", "grams", "shared", "sizes")}
            for f in range(n_fragments):
                a, b, c, d = cut[f], cut[f + 1], cut_shared[f], cut_shared[f + 1]
                if a == b and c == d and f != home:
                    continue
                who = owner[a:b]
                start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if b > a else np.zeros(0, np.int64)
                rows["fragment"].append(f)
                rows["docs"].append(_packed(ids[who[start]], np.int64))
                rows["runs"].append(_packed(np.diff(np.r_[start, b - a]), np.int32))
                rows["grams"].append(_packed(grams[a:b], np.uint32))
                rows["shared"].append(_packed(shared[c:d], np.uint32))
                rows["sizes"].append(_packed(stats, np.int64) if f == home else b"")
            yield pa.RecordBatch.from_pydict(
                rows, schema=pa.schema([("fragment", pa.int64())] + [(k, pa.binary()) for k in list(rows)[1:]])
            )

    return send


_COUNTED = "doc_id long, n long, part long, fp1 long, fp2 long"


def _count_shared(table: pa.Table) -> pa.Table:
    """One fragment: for each document the number of its n-grams that another sender has too."""

    def joined(name, dtype):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)

    docs, runs = joined("docs", np.int64), joined("runs", np.int32)
    grams, shared = joined("grams", np.uint32), joined("shared", np.uint32)
    both = np.sort(np.concatenate([grams, shared]))
    often = np.unique(both[1:][both[1:] == both[:-1]])
    spot = np.searchsorted(often, grams)
    hit = often[np.minimum(spot, len(often) - 1)] == grams if len(often) else np.zeros(len(grams), bool)
    part = np.bincount(np.repeat(np.arange(len(docs)), runs)[hit], minlength=len(docs))
    keep = (part > 0) & (2 * part >= runs)  # see jaccard_components
    stats = joined("sizes", np.int64).reshape(-1, 5)
    zero = np.zeros(int(keep.sum()), np.int64)
    return pa.table(
        {
            "doc_id": np.concatenate([docs[keep], stats[:, 0]]),
            "n": np.concatenate([zero, stats[:, 1]]),
            "part": np.concatenate([part[keep], stats[:, 2]]),
            "fp1": np.concatenate([zero, stats[:, 3]]),
            "fp2": np.concatenate([zero, stats[:, 4]]),
        }
    )


def _segments(n_fragments: int):
    """(doc_id, text) to the fragments of each set, as sorted 64-bit hashes."""

    def cut(batches):
        hasher = WordHasher()
        for batch in slices(batches, SLICE_BYTES):
            ids = batch.column("doc_id").to_pylist()
            rows = {"fragment": [], "doc_id": [], "n": [], "grams": []}
            for i, s in zip(ids, shingle_sets(*hasher.words(batch.column("text"))), strict=True):
                at = np.searchsorted(_fragment(s, n_fragments), np.arange(n_fragments + 1))
                for f in range(n_fragments):
                    rows["fragment"].append(f)
                    rows["doc_id"].append(i)
                    rows["n"].append(len(s))
                    rows["grams"].append(_packed(s[at[f] : at[f + 1]], np.uint64))
            yield pa.RecordBatch.from_pydict(
                rows, schema=pa.schema([("fragment", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])
            )

    return cut


def _batch_grams(batches):
    """Segments to (gram, times) pre-aggregated within each Arrow batch."""
    for batch in batches:
        grams, times = np.unique(np.frombuffer(b"".join(batch.column("grams").to_pylist()), np.int64), return_counts=True)
        yield pa.RecordBatch.from_pydict({"gram": grams, "times": times.astype(np.int64)})


def _prefix(percent: int):
    """One document's n-grams that others have too, rarest first, cut to the prefix that a linked pair must share."""

    def cut(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        doc = table.column("doc_id")[0].as_py()
        times = table.column("times").to_numpy()
        gram = table.column("gram").to_numpy()
        alone = n - len(gram)
        length = max(0, n - int(least_overlap(n, percent)) + 1 - alone)
        if length < len(gram):
            gram = gram[np.lexsort((gram, times))[:length]]
        return pa.table({"doc_id": np.full(len(gram), doc), "n": np.full(len(gram), n), "shared": np.full(len(gram), n - alone), "gram": gram})

    return cut


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document; see the module text.

    class_id is the smallest doc_id with an equal set, component_id the smallest doc_id that links
    reach. ``percent`` is the least Jaccard similarity, in percent.
    """
    texts = text_by_id(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_fragments = max(MIN_FRAGMENTS, size // FRAGMENT_BYTES + 1)
    counted = (
        texts.mapInArrow(_send(n_fragments), _SENT)
        .groupBy("fragment")
        .applyInArrow(_count_shared, _COUNTED)
        .groupBy("doc_id")
        .agg(F.max("n").alias("n"), F.sum("part").alias("part"), F.sum("fp1").alias("fp1"), F.sum("fp2").alias("fp2"))
    )
    counted = stored(counted, "join-sizes")
    # A document with a link has at most 100 - percent of its set to itself. A fragment in which more than
    # half of its n-grams are its own sends no count; such fragments hide fewer shared n-grams than own ones.
    may = counted.where((F.col("n") > 0) & (100 * F.col("part") >= (2 * percent - 100) * F.col("n")))
    # equal sets: a class each
    heads = may.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("class_id"))
    classes = stored(may.join(stored(heads, "join-heads"), ["n", "fp1", "fp2"]).select("doc_id", "class_id"), "join-classes")
    heads = classes.where("doc_id = class_id").select("doc_id")
    n_heads = heads.count()
    segments = stored(
        join_ids(texts, heads, "doc_id", "left_semi", n_heads).mapInArrow(_segments(PAIR_FRAGMENTS), SEGMENT),
        "join-segments",
    )
    found = bucket_components(segments, _prefixes(segments, percent), percent)
    own = F.coalesce("component", "class_id", "doc_id")
    return (
        counted.select("doc_id", F.col("n").alias("n_shingles"))
        .join(classes, "doc_id", "left")
        .join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), own.alias("component_id"))
    )


def _exploded(batches):
    """Segments to one row for each n-gram."""
    for batch in batches:
        size = np.array([len(x) // 8 for x in batch.column("grams").to_pylist()], np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": np.repeat(batch.column("doc_id").to_numpy(), size),
                "n": np.repeat(batch.column("n").to_numpy(), size),
                "gram": np.frombuffer(b"".join(batch.column("grams").to_pylist()), np.int64),
            }
        )


def _prefixes(segments: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, shared, gram): the n-grams by which a representative meets its candidates."""
    counts = segments.select("grams").mapInArrow(_batch_grams, "gram long, times long")
    often = stored(counts.groupBy("gram").agg(F.sum("times").alias("times")).where("times > 1"), "join-often")
    rows = segments.mapInArrow(_exploded, "doc_id long, n long, gram long").join(often, "gram")
    return rows.groupBy("doc_id").applyInArrow(_prefix(percent), "doc_id long, n long, shared long, gram long")
