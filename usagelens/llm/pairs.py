"""Links between sets that meet in buckets, without all pairs of a bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, stored
from .textops import mix

PARITY_WORDS = 16
#: Pairs whose sets a task holds at once.
PAIRS_AT_ONCE = 256
#: A set cut into fragments: sorted 64-bit hashes, n of them in the whole set.
SEGMENT = "fragment long, doc_id long, n long, grams binary"


def packed_hashes(blobs: list[bytes]) -> list[np.ndarray]:
    """The sets of segments that hold their sorted hashes."""
    return [np.frombuffer(x, np.uint64) for x in blobs]


def _parity(sets_of):
    """Segments to a bitmap of 64 * PARITY_WORDS bits, one flipped for each element."""

    def run(batches):
        bits = 64 * PARITY_WORDS
        for batch in batches:
            out = []
            blobs = batch.column("grams")
            for elements in (e for at in range(0, len(blobs), PAIRS_AT_ONCE) for e in sets_of(blobs.slice(at, PAIRS_AT_ONCE).to_pylist())):
                spot = mix(elements) % np.uint64(bits)
                odd = (np.bincount(spot.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
                out.append(np.packbits(odd, bitorder="little").view(np.int64))
            out = np.array(out, np.int64).reshape(-1, PARITY_WORDS)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n": batch.column("n"), **{f"p{i}": out[:, i].copy() for i in range(PARITY_WORDS)}}
            )

    return run


def _overlap(sets_of):
    """Rows with two segments to the size of their intersection."""

    def run(batches):
        for batch in batches:
            both = []
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(at, PAIRS_AT_ONCE)
                left, right = (sets_of(part.column(c).to_pylist()) for c in ("grams_a", "grams_b"))
                both += [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"a": batch.column("a"), "b": batch.column("b"), "n_a": batch.column("n_a"), "n_b": batch.column("n_b"), "part": pa.array(both, pa.int64())}
            )

    return run


def links(pairs: DataFrame, segments: DataFrame, percent: int, sets_of=packed_hashes) -> DataFrame:
    """(a, b) of those pairs whose overlap, counted by fragment and summed, reaches the threshold."""
    left = segments.select(F.col("doc_id").alias("a"), "fragment", F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    right = segments.select(F.col("doc_id").alias("b"), "fragment", F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    met = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", "grams_a", "grams_b")
    parts = met.mapInArrow(_overlap(sets_of), "a long, b long, n_a long, n_b long, part long")
    total = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("both"))
    return total.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _near_length(x: str, y: str, percent: int):
    return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))


def bucket_components(
    segments: DataFrame, buckets: DataFrame, percent: int, sets_of=packed_hashes, hub_rounds: int = 1, given: DataFrame | None = None
) -> DataFrame:
    """(id, component) of those sets that :func:`bucket_links` connects."""
    edges, done = bucket_links(segments, buckets, percent, sets_of, hub_rounds, given)
    label = components(edges)
    discard(*done)
    return label


def bucket_links(
    segments: DataFrame, buckets: DataFrame, percent: int, sets_of=packed_hashes, hub_rounds: int = 1, given: DataFrame | None = None
) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) of links that connect all sets that have one, among pairs that share a bucket, and the tables to discard once they are read.

    ``segments`` (fragment, doc_id, n, grams) holds each set of n hashes cut into fragments, in a
    form that ``sets_of`` turns into sorted arrays;
    ``buckets`` (doc_id, n, shared, gram) the buckets ``gram`` of each set; ``shared`` ranks hubs.
    All members of a bucket are compared with its hub. While that leaves members in different
    components, the next hub is taken from components that had none in this bucket, ``hub_rounds`` times
    in all; who is then still apart is compared with each other, unless length or parity bitmap rule
    a link out. ``given`` are links (a, b) that are known already.
    """
    done: list[DataFrame] = []  # tables that the result does not read

    def kept(df: DataFrame, name: str) -> DataFrame:
        done.append(stored(df, name))
        return done[-1]

    prefixes = stored(buckets, "join-prefix")
    often = prefixes.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("gram")
    often = stored(often, "join-often")
    members = kept(prefixes.join(often, "gram").withColumn("component", F.col("doc_id")), "join-members")
    discard(prefixes, often)
    edges = label = hubs = tested = None
    for _ in range(hub_rounds):
        if label is not None:
            members = kept(_still_mixed(members.drop("component"), label, kept), "join-members")
            if members.limit(1).count() == 0:
                return edges, done
        free = members if hubs is None else members.join(_components_of(hubs, label), ["gram", "component"], "left_anti")
        # the member with the largest share of elements that others have too
        rank = F.struct((F.col("shared") / F.col("n")).alias("share"), (-F.col("doc_id")).alias("minus"), "n", "component")
        found = free.groupBy("gram").agg(F.max(rank).alias("top"))
        found = kept(
            found.select("gram", (-F.col("top.minus")).alias("hub"), F.col("top.n").alias("hub_n"), F.col("top.component").alias("hub_component")),
            "join-hubs",
        )
        star = (
            members.join(found, "gram")
            .where((F.col("component") != F.col("hub_component")) & _near_length("n", "hub_n", percent))
            .select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))
            .distinct()
        )
        star = kept(star, "join-star")
        linked = kept(links(star, segments, percent, sets_of), "join-links")
        linked = linked if edges is not None or given is None else linked.unionByName(given)
        edges = linked if edges is None else edges.unionByName(linked)
        tested = star if tested is None else tested.unionByName(star)
        hubs = found.select("gram", "hub") if hubs is None else hubs.unionByName(found.select("gram", "hub"))
        label = components(edges)
    # what the hubs leave in different components
    mixed = kept(_still_mixed(members.drop("component"), label, kept), "join-members")
    if mixed.limit(1).count() == 0:
        return edges, done
    bitmap = (
        segments.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi")
        .select("fragment", "doc_id", "n", "grams")
        .mapInArrow(_parity(sets_of), "doc_id long, n long, " + ", ".join(f"p{i} long" for i in range(PARITY_WORDS)))
        .groupBy("doc_id")
        .agg(*[F.expr(f"bit_xor(p{i})").alias(f"p{i}") for i in range(PARITY_WORDS)])
    )
    members = kept(mixed.join(bitmap, "doc_id"), "join-members")
    x, y = members.alias("x"), members.alias("y")
    flips = sum((F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
    total = F.col("x.n") + F.col("y.n")
    # overlap >= percent * total / (100 + percent), so at most this many elements differ
    allowed = total - 2 * F.ceil(percent * total / (100 + percent))
    rest = (
        x.join(
            y,
            (F.col("x.gram") == F.col("y.gram"))
            & (F.col("x.doc_id") < F.col("y.doc_id"))
            & (F.col("x.component") != F.col("y.component"))
            & _near_length("x.n", "y.n", percent)
            & (flips <= allowed),
        )
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    last = kept(links(kept(rest, "join-rest"), segments, percent, sets_of), "join-links")
    return edges.unionByName(last), done


def _still_mixed(members: DataFrame, label: DataFrame, kept) -> DataFrame:
    """Members with their component, of those buckets that hold several components."""
    own = members.join(label.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    own = kept(own, "join-labelled")
    mixed = own.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
    return own.join(kept(mixed, "join-mixed"), "gram")


def _components_of(hubs: DataFrame, label: DataFrame) -> DataFrame:
    """(gram, component) of the hubs so far."""
    named = hubs.join(label.select(F.col("id").alias("hub"), "component"), "hub", "left")
    return named.select("gram", F.coalesce("component", "hub").alias("component")).distinct()
