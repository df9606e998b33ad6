"""Intermediate tables in the cluster's shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only in a session that names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = f"file://{tempfile.gettempdir()}/usagelens-shared"
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/usagelens/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more, each by its own path."""
    for table in tables:
        spark, jvm = table.sparkSession, table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or with underscores at its end until no column in ``taken`` has it (in any case of letters)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def text_by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row per non-null doc_id: of repeated ids the greatest text counts."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow = narrow.where(F.col("doc_id").isNotNull())
    twice = narrow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    return narrow.groupBy("doc_id").agg(F.max("text").alias("text")) if twice.count() else narrow


#: Most rows that are sent to every executor; beyond it, joins shuffle both sides.
BROADCAST_ROWS = 1_000_000


def join_ids(big: DataFrame, ids: DataFrame, key: str | list[str], how: str, n_ids: int) -> DataFrame:
    """Join with a table of narrow rows, broadcast only if its counted size is small."""
    return big.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, key, how)


class Sent:
    """A dataclass object sent to every executor once. What is broadcast are its plain fields, the class travels with the task's
    code, so that executors need no copy of this package to read it."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._kind = None if value is None else type(value)
        self._fields = spark.sparkContext.broadcast(None if value is None else vars(value))

    @property
    def value(self):
        return None if self._kind is None else self._kind(**self._fields.value)

    def unpersist(self) -> None:
        self._fields.unpersist()
