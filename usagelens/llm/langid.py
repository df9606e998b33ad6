"""Language identification by hierarchical discrimination.

Languages are grouped into families by the similarity of their n-gram profiles. Linear support
vector machines first predict the family (one-versus-one among families), then one-versus-one
machines within the family separate its languages. Features are hashed byte n-grams of the
letters (2 to 4 bytes, other characters count as one blank).

Beside the choice among the learned languages, each text gets its ``fit``: the mean log probability of its
n-grams under the profile of the predicted language, less the least that texts of that language can be expected to have
(MARGIN nats under the median that one half of the sample has by the other half's profile; a median, as some rows are
mislabelled). A text whose fit is below zero is like none of the learned languages, however the machines decide; whoever filters by language drops it.

Learning uses a bounded sample of labelled rows (``per_language`` of each language, those with the
smallest hash of doc_id); prediction reads every whole text, block by block.

Odd input: null text or no letter: ``und`` with score 0. Rows without lang are never learned
from, nor are rows without doc_id. Repeated rows are predicted alike. No labelled row at all:
everything is ``und``. One language only: it is predicted with score 1. Empty table: empty result.
Other columns are kept (the result columns replace ones of the same name).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Sent
from .textops import text_buffer

#: Labelled rows that are learned from, for each language.
PER_LANGUAGE = 300
BUCKET_BITS = 14
SIZES = (2, 3, 4)
#: Share of the n-grams that a profile has never seen, each.
UNSEEN = 1e-6
MARGIN = 3.0
BLOCK = 1 << 17


def _letter_codes() -> np.ndarray:
    """Bytes to feature bytes: A-Z folded, ASCII without letters to a blank, others as they are."""
    code = np.arange(256, dtype=np.uint64)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    code[:128][~ascii_letter[:128]] = 32
    code[65:91] += np.uint64(32)
    return code


def _buckets(part: np.ndarray, code: np.ndarray):
    """(n, bucket of the n-gram that starts at each byte) for each n; the last n - 1 bytes start none."""
    x = code[part]
    key = x
    for n in range(2, max(SIZES) + 1):
        key = key[:-1] | (x[n - 1 :] << np.uint64(8 * (n - 1))) if len(x) >= n else key[:0]
        if n in SIZES:
            spot = (key * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - BUCKET_BITS)
            yield n, spot.astype(np.int64) + ((n - SIZES[0]) << BUCKET_BITS)


DIM = len(SIZES) << BUCKET_BITS


def _profiles(batches):
    """(lang, text) to sparse n-gram frequencies of each text."""
    code = _letter_codes()
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        spots, values = [], []
        for a, b in zip(off[:-1], off[1:], strict=True):
            count = np.zeros(DIM, np.float32)
            for at in range(a, b, BLOCK):
                for _, spot in _buckets(raw[at : min(b, at + BLOCK + max(SIZES) - 1)], code):
                    count += np.bincount(spot, minlength=DIM)
            some = np.flatnonzero(count)
            spots.append(some.astype(np.int32).tobytes())
            values.append((count[some] / max(1.0, count.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "hash": batch.column("hash"), "spots": spots, "values": values})


@dataclass
class LanguageModel:
    """Families of languages and the machines between them; ``weights`` has a column for each machine, then one for the log
    probabilities of each language, whose texts have a mean of at least ``least``."""

    languages: list[str]
    family: list[int]
    machines: list[tuple[str, int, int]]  # ("family", x, y) or ("language", x, y): positive for x
    weights: np.ndarray
    bias: np.ndarray
    least: np.ndarray


def _families(mean: np.ndarray) -> list[int]:
    """Complete-linkage clusters of the mean profiles, about as many as the root of their number."""
    unit = mean / np.maximum(1e-12, np.linalg.norm(mean, axis=1, keepdims=True))
    near = unit @ unit.T
    groups = [[i] for i in range(len(mean))]
    while len(groups) > max(1, round(len(mean) ** 0.5)):
        pairs = [(min(near[i, j] for i in x for j in y), -p, -q) for p, x in enumerate(groups) for q, y in enumerate(groups) if p < q]
        _, p, q = max(pairs)
        groups[-p] += groups.pop(-q)
    family = [0] * len(mean)
    for k, group in enumerate(sorted(map(sorted, groups))):
        for i in group:
            family[i] = k
    return family


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, rounds: int = 12, reg: float = 1e-4):
    """Linear support vector machine by averaged subgradient steps on sparse rows (spots, values)."""
    w, total, b, total_b, step = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0, 0
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            step += 1
            rate = 1.0 / (reg * (step + 1 / reg))
            spots, values = rows[i]
            if sign[i] * (w[spots] @ values + b) < 1:
                w[spots] += rate * weight[i] * sign[i] * values
                b += 0.1 * rate * weight[i] * sign[i]
        w *= 0.98
        total += w
        total_b += b
    return total / rounds, total_b / rounds


def _least_fit(rows: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The median of the mean log probabilities that texts (sparse profiles) of a language have by each other's, less MARGIN."""
    fits = []
    for mine, other in ((rows[::2], rows[1::2]), (rows[1::2], rows[::2])):
        profile = np.zeros(DIM)
        for spots, values in other:
            profile[spots] += values / len(other)
        profile = np.log(profile + UNSEEN)
        fits += [float(values @ profile[spots]) / max(float(values.sum()), 1e-9) for spots, values in mine if other]
    return float(np.median(fits)) - MARGIN if fits else float(np.log(UNSEEN))


def learn(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit the model on at most ``per_language`` rows of each language among rows where ``may_learn`` holds."""
    labelled = docs.where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("lang", F.xxhash64("doc_id").alias("hash"), "text")
    times = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language, as the model has
    # rows under a bound of the hash, some more than wanted so that hardly ever fewer are left
    wanted = per_language + 4 * per_language**0.5 + 10
    bounds = [(r.lang, min((1 << 63) - 1, int(wanted / r.n * 2**64) - (1 << 63))) for r in times]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    labelled = labelled.withColumn("lang", F.col("lang").cast("string")).where(F.col("text").rlike(r"\p{L}"))

    def profiles(rows: DataFrame) -> list:
        rows = rows.groupBy("lang", "hash").agg(F.max("text").alias("text"))  # an id's rows count once
        return rows.mapInArrow(_profiles, "lang string, hash long, spots binary, values binary").collect()

    found = profiles(labelled.join(bounds, "lang").where(F.col("hash") <= F.col("bound")).select("lang", "hash", "text"))
    for lost in sorted({r.lang for r in times} - {r.lang for r in found}):  # few ids, repeated often, may all lie over the bound
        found += profiles(labelled.where(F.col("lang") == lost).orderBy("hash").limit(per_language))
    found = sorted(found, key=lambda r: (r.lang, r.hash))
    places = {}
    found = [r for r in found if places.setdefault(r.lang, []).append(1) or len(places[r.lang]) <= per_language]
    if not found:
        return None
    languages = sorted({r.lang for r in found})
    lang = np.array([languages.index(r.lang) for r in found])
    rows = [(np.frombuffer(r.spots, np.int32), np.frombuffer(r.values, np.float32).astype(float)) for r in found]
    mean = np.zeros((len(languages), DIM))
    for k, (spots, values) in zip(lang, rows, strict=True):
        mean[k, spots] += values / (lang == k).sum()
    least = np.array([_least_fit([r for r, y in zip(rows, lang, strict=True) if y == k]) for k in range(len(languages))])
    scale = 1 / np.sqrt(mean.mean(axis=0) + 1e-6)
    rows = [(spots, values * scale[spots]) for spots, values in rows]
    family = _families(mean * scale)
    own = np.array(family)[lang]
    tasks = [("family", x, y, own == x, own == y) for x in range(max(family) + 1) for y in range(x)]
    tasks += [("language", x, y, lang == x, lang == y) for x in range(len(languages)) for y in range(x) if family[x] == family[y]]
    weights, bias = np.zeros((DIM, len(tasks))), np.zeros(len(tasks))
    for k, (_, _, _, pos, neg) in enumerate(tasks):
        some = np.flatnonzero(pos | neg)
        w, bias[k] = _machine([rows[i] for i in some], np.where(pos[some], 1, -1))
        weights[:, k] = w * scale
    weights = np.concatenate([weights, np.log(mean + UNSEEN).T], axis=1)
    return LanguageModel(languages, family, [t[:3] for t in tasks], weights.astype(np.float32), bias, least)


def _decide(model: LanguageModel, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins (rows x machines) to (language, score): votes, then the sum of margins; the weakest win is the score."""

    def winner(kind: str, members: list[int], rows: np.ndarray):
        votes = np.zeros((len(rows), len(members)))
        sure = np.ones((len(rows), len(members)))
        for k, (what, x, y) in enumerate(model.machines):
            if what == kind and x in members and y in members:
                m = margin[rows, k]
                p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
                for who, value in ((x, p), (y, 1 - p)):
                    j = members.index(who)
                    votes[:, j] += (value > 0.5) + value / 1000
                    sure[:, j] = np.minimum(sure[:, j], value)
        best = votes.argmax(axis=1)
        return best, sure[np.arange(len(rows)), best]

    n = len(margin)
    fam, sure = winner("family", list(range(max(model.family) + 1)), np.arange(n))
    lang = np.zeros(n, np.int64)
    for f in range(max(model.family) + 1):
        rows = np.flatnonzero(fam == f)
        members = [i for i, x in enumerate(model.family) if x == f]
        best, within = winner("language", members, rows)
        lang[rows] = np.array(members)[best] if len(rows) else 0
        sure[rows] = np.minimum(sure[rows], within)
    return lang, sure


RESULT = ["lang_pred", "score", "fit"]


def _predict(model: LanguageModel | None, batches, keep: list[str] | None = None):
    code = _letter_codes()
    ascii_letter = code != 32
    ascii_letter[128:] = False
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        n = batch.num_rows
        raw, off = text_buffer(texts)
        # letters: an ASCII one in most texts, else ask Unicode
        seen = np.zeros(n, bool)
        for i in range(n):
            a, b = off[i], off[i + 1]
            seen[i] = b > a and (any(ascii_letter[raw[s : min(b, s + 4096)]].any() for s in range(a, b, 4096)) or any(ch.isalpha() for ch in texts[i].as_py()))
        pred, score, fit = np.full(n, "und", object), np.zeros(n), np.full(n, -np.inf)
        if model is not None and n:
            margin = np.zeros((n, model.weights.shape[1]))
            grams = np.zeros(n)
            for k in range(len(SIZES)):
                grams += np.maximum(0, np.diff(off) - SIZES[k] + 1)
            for at in range(0, len(raw), BLOCK):
                end = min(len(raw), at + BLOCK)
                for size, spot in _buckets(raw[at : min(len(raw), end + max(SIZES) - 1)], code):
                    spot = spot[: end - at]
                    gain = model.weights[spot]
                    first, last = np.searchsorted(off, at, "right") - 1, np.searchsorted(off, at + len(spot), "left")
                    for o in off[first + 1 : last + 1]:  # no n-gram spans two texts
                        gain[max(0, o - size + 1 - at) : max(0, o - at)] = 0
                    bounds = np.clip(off[first:last] - at, 0, len(spot))
                    some = np.flatnonzero(np.diff(np.r_[bounds, len(spot)]) > 0)
                    if len(some):
                        margin[first + some] += np.add.reduceat(gain, bounds[some], axis=0, dtype=np.float64)
            mean = margin / np.maximum(1, grams)[:, None]
            lang, sure = _decide(model, mean[:, : len(model.machines)] + model.bias)
            pred[seen] = np.array(model.languages, object)[lang[seen]]
            score[seen] = sure[seen]
            own = mean[np.arange(n), len(model.machines) + lang] - model.least[lang]
            fit[seen] = np.where(grams > 0, own, 0.0)[seen]  # a single byte has no n-gram to judge by
        kept = [(batch.schema.names[i], c) for i, c in enumerate(batch.columns) if batch.schema.names[i] not in RESULT and (keep is None or batch.schema.names[i] in keep)]
        yield pa.RecordBatch.from_arrays(
            [c for _, c in kept] + [pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())],
            [x for x, _ in kept] + RESULT,
        )


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and fit (below zero: like no learned language; minus infinity with ``und``) to every
    row; reads nothing but ``text``. ``keep`` names the columns to return beside these (default: all). The model's size is
    fixed by the number of languages, whatever the data."""
    sent = Sent(docs.sparkSession, model)
    fields = [f for f in docs.schema.fields if f.name not in RESULT and (keep is None or f.name in keep)]
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(RESULT, kinds, strict=True))])
    return docs.mapInArrow(lambda batches: _predict(sent.value, batches, keep), schema)
