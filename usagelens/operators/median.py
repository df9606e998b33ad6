"""Sums and the exact median per key, without a buffer of a group's values (A10).

Rows are dealt by key and by a bucket that is monotone in the value, so a hot key is spread over
its buckets; values that many rows share (zero, NULL) are spread over several buckets that hold nothing else.
Each bucket is summed where its rows are. One row per key then merges its buckets' sums and finds, from their counts
in order, which bucket holds the middle ranks. Often that settles the median already (the ranks are a
bucket's ends, or the bucket has one value); else the rows of that one bucket, which are still
where they were dealt, are ranked. The rows cross one shuffle, which both passes read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each factor of two of the value.
PER_OCTAVE = 64
_LEAST = 1100 * PER_OCTAVE  # above the exponent range of doubles, so buckets of positive values are positive
#: Buckets over which rows of value zero are spread, and as many for rows without a value.
SPREAD = 32


def value_bucket(value: Column, spread: Column | None = None) -> Column:
    """A long that never falls when the value rises. ``spread`` (a long) deals zeros over ``SPREAD`` buckets,
    and NULLs over others below all values."""
    size = F.lit(_LEAST) + F.floor(F.log2(F.abs(value)) * PER_OCTAVE)
    slot = F.lit(0) if spread is None else F.pmod(spread, F.lit(SPREAD))
    bucket = F.when(value == 0, slot).when(value > 0, size).when(value < 0, -size).otherwise(F.lit(-3 * _LEAST) - slot)
    return F.coalesce(bucket.cast("long"), F.lit(0).cast("long"))  # never NULL, and known not to be


def _middle(buckets: Column, total: Column) -> Column:
    """The struct (low, high, bucket, before) of the buckets (bucket, n, least, most) in order: values of the two middle
    ranks where the buckets' ends tell them, else the bucket that holds both and the count before it."""
    low_rank, high_rank = F.floor((total - 1) / 2), F.floor(total / 2)
    none, nothing = F.lit(None).cast("double"), F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("seen"), none.alias("low"), none.alias("high"), nothing.alias("bucket"), nothing.alias("before"))

    def step(acc: Column, x: Column) -> Column:
        after = acc["seen"] + x["n"]
        has_low = (acc["seen"] <= low_rank) & (low_rank < after)
        has_high = (acc["seen"] <= high_rank) & (high_rank < after)
        open_ = has_low & has_high & (x["least"] < x["most"])
        return F.struct(
            after.alias("seen"),
            F.when(has_low & ~open_, x["most"]).otherwise(acc["low"]).alias("low"),
            F.when(has_high & ~open_, x["least"]).otherwise(acc["high"]).alias("high"),
            F.when(open_, x["bucket"]).otherwise(acc["bucket"]).alias("bucket"),
            F.when(open_, acc["seen"]).otherwise(acc["before"]).alias("before"),
        )

    return F.aggregate(buckets, start, step)


def with_median(
    rows: DataFrame, keys: Sequence[str], value: str, name: str, sums: Mapping[str, Column], least: Mapping[str, Column], n_rows: str, n_values: str
) -> DataFrame:
    """A row per ``keys`` with the number of rows and of those with a ``value`` (as ``n_rows`` and ``n_values``), ``sums`` (columns
    added up), ``least`` (smallest value of each) and the exact median of the double ``value`` as ``name``. NULL values are
    ignored; a key without any has a NULL median."""
    keys = list(keys)
    parts = {f"_s{i}": c for i, c in enumerate(sums.values())} | {f"_m{i}": c for i, c in enumerate(least.values())}
    flat = rows.select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_v"), *[c.alias(a) for a, c in parts.items()])
    flat = flat.withColumn("_bucket", value_bucket(F.col("_v"), F.xxhash64(*flat.columns[1:])))
    dealt = flat.repartition("_key", "_bucket")
    # both passes take their columns out of one generated row, so that they need the same columns of the
    # shuffle and Spark runs it once for both
    dealt = dealt.select("_key", "_bucket", F.inline(F.array(F.struct("_v", *parts))))
    merged = [F.sum(a).alias(a) for a in parts if a[1] == "s"] + [F.min(a).alias(a) for a in parts if a[1] == "m"]
    buckets = dealt.groupBy("_key", "_bucket").agg(*merged, F.count(F.lit(1)).alias("_rows"), F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    one = F.struct(F.col("_bucket").alias("bucket"), F.col("_n").alias("n"), F.col("_least").alias("least"), F.col("_most").alias("most"))
    by_key = buckets.groupBy("_key").agg(*merged, F.sum("_rows").alias("_rows"), F.sum("_n").alias("_n"), F.sort_array(F.collect_list(F.when(F.col("_n") > 0, one))).alias("_all"))
    by_key = by_key.withColumn("_mid", _middle(F.col("_all"), F.col("_n")))
    by_key = by_key.select(
        "_key", *parts, "_rows", "_n", F.col("_mid.low").alias("_low"), F.col("_mid.high").alias("_high"),
        F.coalesce("_mid.bucket", F.lit(-4 * _LEAST)).cast("long").alias("_bucket"), F.col("_mid.before").alias("_before"),
    )
    ranked = by_key.join(dealt.select("_key", "_bucket", "_v"), ["_key", "_bucket"], "left")
    place = F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy("_v")) + F.col("_before") - 1
    ranked = ranked.withColumn("_at", place)

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_at") == rank, F.col("_v")))

    of_key = [*parts, "_rows", "_n", "_low", "_high"]
    out = ranked.groupBy("_key", "_bucket").agg(
        *[F.max(c).alias(c) for c in of_key],
        at(F.floor((F.col("_n") - 1) / 2)).alias("_l"), at(F.floor(F.col("_n") / 2)).alias("_h")
    )
    median = 0.5 * F.coalesce("_low", "_l") + 0.5 * F.coalesce("_high", "_h")
    named = [F.col(a).alias(n) for a, n in zip(parts, [*sums, *least], strict=True)]
    counts = [F.col("_rows").alias(n_rows), F.col("_n").alias(n_values)]
    return out.select(*[F.col("_key")[k].alias(k) for k in keys], *counts, *named, median.alias(name))
