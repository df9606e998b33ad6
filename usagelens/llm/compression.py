"""Quality classifier by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from texts labelled good, one from texts labelled bad. A text is compressed with each, and
without any; per byte, the difference of the two sizes and the plain size are calibrated (logistic
regression) on labelled texts that no dictionary has seen, so that the score is the share of label 1 to be expected.

What is learned from is bounded: of each label the ``PER_LABEL`` learnable rows whose ids come first in the
order of a hash, and of those the texts of at most ``LONGEST`` bytes. Two thirds go to the dictionaries, one third to the
calibration. The counts of the labels are taken over all learnable rows. Ids are chosen on the narrow label table;
the corpus is read once for the texts chosen and once to be scored, without a shuffle.

Odd input: null and empty text: the score that the calibration gives at a difference and a size of zero. Labels that are null or
contradict each other for one id are not learned from; repeated ids learn and are scored row by row. Without both labels there
is no dictionary and every score is the (smoothed) share of label 1. Empty table: empty result. Other columns
are kept; columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .textops import slices

PER_LABEL = 1500
LONGEST = 32_768
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Bytes of the pieces that the dictionary builder looks for common parts in.
PIECE = 1024
#: Fewer bytes than this many dictionaries of text are the dictionary themselves.
LEAST_TEXT = 4
#: Bytes added to every length, so that a few bytes more or less decide little in short texts.
SMOOTH = 64
#: Score from which on a text counts as good.
GOOD = 0.7


@dataclass
class QualityModel:
    """Two dictionaries, the calibration (weights of difference, size and one), and the score without them."""

    good: bytes | None
    bad: bytes | None
    raw: tuple[bool, bool]
    weights: np.ndarray | None
    share: float


def _dictionary(texts: list[bytes], size: int) -> tuple[bytes, bool]:
    """(content, whether it is plain text): what the texts have in common, or, of little text, the text itself."""
    if sum(map(len, texts)) >= LEAST_TEXT * size:
        pieces = [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
        return zstandard.train_dictionary(size, [p for p in pieces if len(p) >= 8]).as_bytes(), False
    return b"\n".join(texts)[-size:], True


def _sizes(model: QualityModel):
    """A function from a text to (difference of the sizes per byte, plain size per byte)."""

    def packer(content: bytes | None, raw: bool):
        known = content and zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **({"dict_data": known} if known else {}))

    good, bad, plain = packer(model.good, model.raw[0]), packer(model.bad, model.raw[1]), packer(None, True)

    def features(text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        return (len(bad.compress(text)) - len(good.compress(text))) / (len(text) + SMOOTH), len(plain.compress(text)) / (len(text) + SMOOTH)

    return features


def _calibrated(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the columns of x and of one that fit the labels best (logistic regression by Newton's method, slightly shrunk)."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    shrink = 0.01 * len(x) ** 0.5
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + shrink * np.eye(len(w)), a.T @ (weight * (label - p)) - shrink * w)
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] / spread) @ mean]


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", per_label: int = PER_LABEL) -> QualityModel:
    """Fit on the rows of ``labels`` (doc_id, ``label`` 0 or 1) where ``may_learn``, a condition on doc_id, holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(may_learn)
    known = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = stored(known.where("label = other").select("doc_id", "label"), "quality-labels")
    times = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (times.get(1, 0) + 1) / (sum(times.values()) + 2)
    order = F.xxhash64("doc_id")
    first = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_label).collect() for k in (1, 0)]
    if not all(first):
        return QualityModel(None, None, (True, True), None, share)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.label) for part in first for r in part], "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where((F.octet_length("text") > 0) & (F.octet_length("text") <= LONGEST)).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "label").agg(F.max("text").alias("text")).orderBy("label", order, "doc_id").select("label", "text").toArrow()
    of = {k: [t.encode() for y, t in zip(rows["label"].to_pylist(), rows["text"].to_pylist(), strict=True) if y == k] for k in (1, 0)}
    if min(map(len, of.values())) < 3:
        return QualityModel(None, None, (True, True), None, share)
    cut = {k: 2 * len(x) // 3 for k, x in of.items()}
    built = {k: _dictionary(x[: cut[k]], DICTIONARY_BYTES) for k, x in of.items()}
    model = QualityModel(built[1][0], built[0][0], (built[1][1], built[0][1]), None, share)
    features = _sizes(model)
    rest = {k: x[cut[k] :] for k, x in of.items()}
    x = np.array([features(t) for k in (1, 0) for t in rest[k]])
    y = np.repeat([1.0, 0.0], [len(rest[1]), len(rest[0])])
    model.weights = _calibrated(x, y, np.where(y > 0, share / len(rest[1]), (1 - share) / len(rest[0])) * len(y))
    return model


def _score(model: QualityModel, names: list[str]):
    def run(batches):
        features = _sizes(model) if model.weights is not None else None
        for batch in slices(batches, 1 << 24):
            score = np.full(batch.num_rows, model.share)
            if features:
                x = np.array([features((t.as_py() or "").encode()) for t in batch.column("text")])
                score = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= GOOD).astype(np.int32))], [*names, "score", "predicted"])

    return run


def predict(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 from ``GOOD`` on) to every row; reads nothing but ``text``."""
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score(model, [f.name for f in fields]), schema)
