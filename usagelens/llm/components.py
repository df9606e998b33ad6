"""Connected components of a distributed edge list (alternating large and small stars)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def _lowest(edges: DataFrame, with_self: bool) -> DataFrame:
    """Lowest neighbour (or the node itself) of each node u; stored, so that a join on a hub can be split."""
    low = F.min("v") if not with_self else F.least(F.min("v"), F.col("u"))
    return stored(edges.groupBy("u").agg(low.alias("m")), "cc-low")


#: Edges whose components a task finds by itself before the rounds.
AT_ONCE = 1 << 17


def _contracted(batches):
    """Rows (u, v) to stars about the smallest node of what connects within a bounded run of rows, so that the rounds find short paths."""

    def stars(above: dict[int, int]) -> pa.RecordBatch:
        found = {u: _root(above, u) for u in list(above)}
        u = [x for x, low in found.items() if x != low]
        return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array([found[x] for x in u], pa.int64())})

    above: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = _root(above, u), _root(above, v)
            if x != y:
                above[max(x, y)] = min(x, y)
        if len(above) > AT_ONCE:
            yield stars(above)
            above = {}
    yield stars(above)


def _root(above: dict[int, int], x: int) -> int:
    while (up := above.setdefault(x, x)) != x:
        above[x] = above.setdefault(up, up)  # halves the path
        x = up
    return x


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    ``edges`` has long columns a and b; nulls and self loops are ignored, repeats are harmless,
    an empty table gives an empty result. Each round is two grouped minima (combined before the
    shuffle) and two joins; the rounds grow with the logarithm of the longest path. Before them each
    task replaces its edges by stars.
    """
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    directed = clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(directed.mapInArrow(_contracted, "u long, v long"), "cc-edges")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component"))
            ).distinct()
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _lowest(both, True)
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "cc-large")
        low = _lowest(large, False)
        linked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stored(linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        discard(last, least, large, low)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
