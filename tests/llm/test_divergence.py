"""Source divergence against a dictionary count of whole texts, the pointer sort against plain sorting, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from usagelens.llm import divergence as D

FOLD = {k: k + 32 for k in range(65, 91)}


def expected(rows, least=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(FOLD))) for lang, source, text in rows]
    docs, count, group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for lang, source, terms in found:
        docs[lang].update(set(terms))
        count[lang].update(terms)
        group[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())
        share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
        p = {}
        for s in own:
            n = sum(group[lang, s][t] for t in kept)
            p[s] = [share(group[lang, s][t], n, len(kept)) for t in kept]
        n = sum(count[lang][t] for t in kept)
        q = [share(count[lang][t], n, len(kept)) for t in kept]
        for s in own:
            pairs = [(o, sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True))) for o in own if o != s]
            terms = [(t, x - y) for t, x, y in zip(kept, p[s], q, strict=True) if x > y and group[lang, s][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[: top if part == "term" else None])]
    return sorted(out)


def _result(spark, rows, **how):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    return sorted(map(tuple, D.source_divergence(docs, **how).collect()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\U0001f600-0zZ\n", max_size=60), max_size=6))
def test_pointers_sort_like_terms(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    start, end = D.term_spans(raw, off)
    terms = [bytes(raw[a:b]) for a, b in zip(start, end, strict=True)]
    assert terms == [m for t in texts for m in re.findall(rb"[A-Za-z\x80-\xff]+", t.encode())]
    order, run = D.sorted_runs(raw, start, end)
    assert [terms[i] for i in order] == sorted(terms)
    ranked = sorted(terms)
    assert run.tolist() == [ranked.index(t) for t in ranked]


def test_equals_counts_of_whole_texts(spark):
    rng = random.Random(1)
    words = ["a", "É", "é", "straße", "donaudampfschifffahrt", "donaudampfschiffe", "x" * 40, "x" * 41, "日本語", "B", "naïve", "it's", "a1b"]
    rows = [(rng.choice(["de", "en", None, ""]), rng.choice(["s1", "S1", "é", None, "s10"]), " ".join(rng.choices(words, weights=range(1, 14), k=rng.randrange(30)))) for _ in range(400)]
    rows += [("xx", "only", "one"), ("yy", "p", None), ("yy", "q", ""), ("de", "silent", "12 34")]
    assert _result(spark, rows) == expected(rows)
    assert _result(spark, rows, least_docs=1, top=2) == expected(rows, 1, 2)
    assert _result(spark, [rows[0]]) == expected([rows[0]]) == []
    assert _result(spark, []) == []


def test_blocks_of_sources_and_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_SOURCES", 3)
    monkeypatch.setattr(D, "SHARD_TERMS", 7)
    rng = random.Random(2)
    rows = [("l" + str(k % 2), f"s{rng.randrange(11)}", " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(4))}" for _ in range(12))) for k in range(300)]
    assert _result(spark, rows, least_docs=5) == expected(rows, 5)


def test_counts_beyond_64_bits_on_the_way(spark):
    wide = spark.sql("select 20000000000L as c, 40000000000L as n, 3L as v")
    from pyspark.sql import functions as F

    assert wide.select(D._share(F.col("c"), "n", "v")).first()[0] == 1 + 10**9 * (20_000_000_000 + 5) // (40_000_000_000 + 15)


def test_long_text_and_clashing_columns(spark):
    text = "word " * 200_000 + "é" * 100_000
    rows = [("en", "a", text), ("en", "b", text), ("en", "b", "word other")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, rank int")
    assert sorted(map(tuple, D.source_divergence(docs, least_docs=2).collect())) == expected(rows, 2)
