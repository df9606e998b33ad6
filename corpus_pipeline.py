"""Corpus pipeline: language filter, line dedup, near-duplicate removal, decontamination, tokens.

Counted as part of the subpackage ``usagelens.llm``. ``STAGES`` lists the stages in order; each
takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents.
Rows without doc_id pass the stages that compare documents, as nothing can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import langid
from usagelens.llm.decontam import contaminated
from usagelens.llm.line_dedup import dedup_lines
from usagelens.llm.ngram_join import jaccard_components
from usagelens.llm.queries import bpe_digests
from usagelens.llm.shared import free_name, join_ids, stored

#: What separates words of a line, as in ``line_form``; a line of these alone has no form and never goes.
BLANKS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that are like none of the learned languages (noise, other languages)."""
    model = langid.learn(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    # texts go to Python once and don't come back: what is rejected goes by a hash of id and text
    key = free_name("row_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = langid.predict(keyed.select(key, "text"), model, keep=[key])
    gone = stored(found.where((F.col("lang_pred") == "und") | (F.col("fit") < 0)).select(key).distinct(), "pipeline-languages")
    return join_ids(keyed, gone, key, "left_anti", gone.count()).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines out of the texts; a document of which nothing is left goes."""
    found = dedup_lines(docs)
    empty = (F.col("n_dropped") > 0) & ~F.col("text").rlike(rf"[^{BLANKS}]")
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(~empty).withColumn("n_chars", changed).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that near-duplicate links connect, the one with the smallest doc_id stays."""
    gone = stored(jaccard_components(docs).where("doc_id <> component_id").select("doc_id"), "pipeline-copies")
    return join_ids(docs, gone, "doc_id", "left_anti", gone.count()).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a copy of a benchmark item, edited or not."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    gone = stored(found.select("doc_id").distinct(), "pipeline-contaminated")
    return join_ids(docs, gone, "doc_id", "left_anti", gone.count()).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (little-endian unsigned 32-bit integers), and digests of ids and of the decoded text."""
    return bpe_digests(docs, with_ids=True)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", tokens),
]

#: No SQL expresses the stages (models, hashing, tokenizer); tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's output written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
