"""Held-out quality of the compression classifier, its calibration, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import compression as C
from usagelens.llm.queries import QUERIES

LARGE = "/root/testdata/sf0.1"


def may_learn():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def test_held_out_quality(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    rows = QUERIES["op13_quality_classifier"](spark, LARGE).collect()
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [x for x in held if x[0] == 1], [x for x in held if x[0] == 0]
    print("good kept", np.mean([x[2] for x in good]), "bad found", np.mean([1 - x[2] for x in bad]))
    assert np.mean([x[2] for x in good]) >= 0.97
    assert np.mean([1 - x[2] for x in bad]) >= 0.93
    # calibrated: the mean score is the share of label 1, and better than a constant by far
    assert abs(np.mean([x[1] for x in held]) - len(good) / len(held)) < 0.03
    share = len(good) / len(held)
    assert np.mean([(x[1] - x[0]) ** 2 for x in held]) < 0.25 * share * (1 - share)


def _tables(spark, n=60):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8)))
    rows = [(k, (" " if k % 2 else " | #$ ").join(word() for _ in range(80))) for k in range(n)]
    docs = spark.createDataFrame([(d, t, "u", 9) for d, t in rows], "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(0, n, 1) if k < n - 20], "doc_id long, quality int, text string")
    return docs, labels


def test_learned_from_few_rows(spark):
    docs, labels = _tables(spark)
    model = C.learn(docs, labels, F.lit(True))
    found = C.predict(docs, model)
    assert found.columns == ["doc_id", "text", "label", "score", "predicted"]
    rest = found.where("doc_id >= 40").collect()
    assert len(rest) == 20 and all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in rest)
    # a label that may not be learned from changes nothing
    other = labels.withColumn("quality", F.when(may_learn(), F.col("quality")).otherwise(1 - F.col("quality")))
    one, two = (C.learn(docs, x, may_learn()) for x in (labels, other))
    assert (one.good, one.bad, one.share) == (two.good, two.bad, two.share) and np.array_equal(one.weights, two.weights)


@pytest.mark.parametrize("kind", ["none", "one label", "contradictions", "no documents"])
def test_without_both_labels(spark, kind):
    docs, labels = _tables(spark)
    if kind == "none":
        labels = labels.limit(0)
    elif kind == "one label":
        labels = labels.where("quality = 1").unionByName(spark.createDataFrame([(None, 0, None), (3, None, None)], labels.schema))
    elif kind == "contradictions":
        labels = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    else:
        docs = docs.limit(0)
    model = C.learn(docs, labels, F.lit(True))
    assert model.weights is None and 0 < model.share < 1
    assert {r.score for r in C.predict(_tables(spark)[0], model).collect()} == {model.share}
    assert C.predict(docs.limit(0), model).count() == 0


def test_odd_rows(spark):
    docs, labels = _tables(spark)
    model = C.learn(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, None), (3, "x " * 3_000_000), (4, "é\U0001f600"), (4, "é\U0001f600")], "doc_id long, text string")
    rows = C.predict(odd, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.score) == r.score
