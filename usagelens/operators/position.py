"""Row positions in a total order, without a window over all rows (O1-O3).

The rows are sorted as a report is: dealt by range, sorted within each range. That result is checkpointed, as two
sorts of the same rows need not cut their ranges alike. Each row then knows its range and its place in it; the
ranges' row counts (one row for each range) give the position at which each begins.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ID, _RANGE, _BEGIN = "_position_id", "_position_range", "_position_begin"
_PLACES = 33  # bits of monotonically_increasing_id that count within a partition


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there: the cluster's ``spark.checkpoint.dir``, or a temporary
    folder in a local session that names none."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
            folder = tempfile.mkdtemp(prefix="usagelens-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` in the order of ``order``, each row with its position in it, from 1. Rows equal in all of ``order`` follow each
    other in any order; with an order that ends in a unique key, a value that many rows share is cut into several ranges."""
    placed = checkpointed(df.orderBy(*order).withColumn(_ID, F.monotonically_increasing_id()))
    placed = placed.withColumn(_RANGE, F.shiftright(_ID, _PLACES))
    counts = placed.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col(_RANGE).alias("at"), F.col("n").alias("n")))).alias("all"))
    ahead = F.aggregate(F.filter("all", lambda x: x["at"] < F.col("one.at")), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    begins = counts.select("all", F.explode("all").alias("one")).select(F.col("one.at").alias(_RANGE), ahead.alias(_BEGIN))
    place = F.col(_ID) - F.shiftleft(F.col(_RANGE), _PLACES)
    return placed.join(begins, _RANGE).select(*df.columns, (F.col(_BEGIN) + place + 1).alias(name))
