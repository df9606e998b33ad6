import zlib

import pytest
from brute import SMALL
from pyspark.sql import functions as F

from usagelens.llm import langid
from usagelens.llm.queries import op10_language_id

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.learn(spark.read.parquet(f"{MEDIUM}/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, 60)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = op10_language_id(spark, MEDIUM).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_families_group_related_languages(model):
    assert model.languages == ["de", "en", "es", "fr"] and len(set(model.family)) == 2
    assert {k for k, _, _ in model.machines} == {"family", "language"}


def test_odd_rows_and_extra_columns(spark, model):
    text = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("lang = 'en' AND n_chars > 500").first().text
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "12 $$ .", 0.5), (None, text, 0.5), (4, text * 800, 0.5), (5, text, None), (5, text, None), (6, "привет", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()]
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en")] and got[5:7] == [(5, "en")] * 2 and got[7][1] != "und"
    assert langid.predict(docs.limit(0), model).count() == 0
    none = langid.learn(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert none is None and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    one = langid.learn(docs.withColumn("lang", F.lit("xx")), F.lit(True))
    assert [(r.lang_pred, r.score) for r in langid.predict(docs.where("doc_id = 5"), one).collect()] == [("xx", 1.0)] * 2


FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
POLISH = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem "


def test_fit_tells_texts_of_no_learned_language(spark, model):
    import random

    rng = random.Random(3)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (60, 500, 5000)]
    strange = [*noise, FINNISH, FINNISH * 40, POLISH * 3, "Все люди рождаются свободными и равными " * 5, "人人生而自由" * 20]
    docs = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert all(r.fit < 0 for r in langid.predict(docs, model).collect())
    held = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    rows = langid.predict(held, model).where("lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r.fit >= 0 for r in rows) >= 0.995 * len(rows)


def test_the_sample_is_bounded_by_hash(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("lang"))
    seen = []
    plain = langid._families
    langid._families = lambda mean: seen.append(mean.shape) or plain(mean)
    try:
        assert langid.learn(docs, F.lit(True), 40).languages == ["a", "b"]
        same = docs.withColumn("doc_id", F.lit(7).cast("long")).withColumn("text", F.lit("one text"))
        assert langid.learn(same, F.lit(True), 40).languages == ["a", "b"]  # a repeated id counts once
    finally:
        langid._families = plain
    assert seen == [(2, langid.DIM)] * 2


def test_blocks_change_nothing(spark, model, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    monkeypatch.setattr(langid, "BLOCK", 1000)
    after = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert sum(before[k] != after[k] for k in before) <= 1  # n-grams over a block's end are read in both
