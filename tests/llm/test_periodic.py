"""Periodic runs against a search of every period, planted runs, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from usagelens.llm import periodic as P
from usagelens.llm.queries import QUERIES


def every_period(words, least=12):
    """All runs by trying each period over the whole text."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        s = None
        for k in range(len(words) - q + 1):
            same = k < len(words) - q and words[k] == words[k + q]
            if same and s is None:
                s = k
            if not same and s is not None:
                if k - s + q >= max(least, 2 * q):
                    best.setdefault((s, k - s + q), q)
                s = None
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def expected(doc, text, unroll=True):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc).encode())
    if unroll and doc is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = every_period(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc, len(found), *top, top[1] and 1000 * top[1] // top[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()),
        digest(b" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def _runs(texts, least=12):
    codes = [[hash((k, w)) for w in t] for k, t in enumerate(texts)]
    sizes = [len(t) for t in texts]
    off = np.cumsum([0, *sizes])
    found = P.runs(np.array([c for t in codes for c in t], np.int64), np.repeat(off[1:], sizes), least)
    return [[(s - off[k], n, q) for s, n, q in found if off[k] <= s < off[k + 1]] for k in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_equal_every_period(texts, least):
    assert _runs(texts, least) == [every_period(t, least) for t in texts]


def test_runs_in_runs():
    rng = random.Random(3)
    for _ in range(60):
        text = []
        while len(text) < 300:
            piece = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
            text += piece * rng.randrange(1, 9)
            text += (text[-rng.randrange(1, 60) :]) * rng.randrange(3)
        assert _runs([text]) == [every_period(text)]


def test_one_word_many_times():
    assert _runs([[1] * 50_000]) == [[(0, 50_000, 1)]]
    assert _runs([[1, 2, 3] * 20_000 + [1]]) == [[(0, 60_001, 3)]]


def test_query_equals_every_period(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len((r.text or "").split()) < 1500}
    got = QUERIES["op12_periodic_runs"](spark, sf).drop("runs").collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got if r.doc_id in short} == {expected(d, t) for d, t in short.items()}
    assert any(r.n_runs for r in got) and any(not r.n_runs for r in got)


def test_odd_rows(spark):
    again = "a b c d " * 5
    ids = [k for k in range(500) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [
        (ids[0], "x", None), (ids[1], " ".join(f"w{k}" for k in range(200)), None), (ids[2], None, "n"), (ids[3], "", "n"), (None, again, "n"),
        (7, again + "e", "n"), (7, again + "e", "n"), (8, "É é\xa0é é " * 9 + "\x1c " * 40, "n"), (9, " \n\t\r\x0b\x0c ", "n"), (11, "one", "n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string").repartition(3)
    got = P.periodic_runs(docs, unroll=True).drop("runs").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(d, t) for d, t, _ in rows), key=repr)
    found = P.periodic_runs(docs.where("doc_id = 7")).select(F.explode("runs").alias("r")).select("r.*").distinct().collect()
    assert [tuple(r) for r in found] == [(0, 20, 4)]
    assert P.periodic_runs(docs.limit(0)).count() == 0
