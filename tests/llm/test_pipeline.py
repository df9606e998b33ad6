import random

import pytest
from brute import SMALL, components, shingles, similar
from pyspark.sql import functions as F

import corpus_pipeline as P
from usagelens.llm import decontam


@pytest.fixture(scope="module")
def steps(spark):
    """(name, rows before, rows after) of each stage over the small table."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = P.stored(stage(spark, docs, SMALL), name)
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return {n: (b, a) for n, b, a in out}


def test_stages_keep_the_columns(steps):
    assert list(steps) == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    for name, (before, after) in steps.items():
        assert name == "byte_bpe" or after[0].asDict().keys() == before[0].asDict().keys()
        assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len({r.doc_id for r in after}) == len(after)


def test_language_rejects_only_what_has_no_language(steps):
    before, after = steps["language_id"]
    kept = {r.doc_id for r in after}
    assert all(r.doc_id in kept for r in before if sum(c.isalpha() for c in r.text) > 100)


def test_language_rejects_noise_and_unlearned_languages(spark):
    from test_langid import FINNISH

    rng = random.Random(5)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(800))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame([(10_000_001, noise, "en", "s", 800), (10_000_002, FINNISH * 9, None, "s", 999), (10_000_003, "12 34", "en", "s", 5)], docs.schema)
    kept = {r.doc_id for r in P.language(spark, docs.unionByName(more), SMALL).collect()}
    assert not kept & {10_000_001, 10_000_002, 10_000_003}
    assert len(kept) >= 0.99 * docs.where(F.col("text").rlike("[a-z]")).count()


def test_lines_go_once(steps):
    before, after = steps["line_dedup"]
    texts = {r.doc_id: r for r in before}
    from usagelens.llm.line_dedup import line_form

    forms = [f for r in after for x in r.text.split("\n") if (f := line_form(x))]
    assert len(forms) == len(set(forms))
    first = {f for r in before for x in r.text.split("\n") if (f := line_form(x))}
    assert len(forms) > 0.9 * len(first)
    assert all(r.n_chars == len(r.text) for r in after if r.text != texts[r.doc_id].text)


def test_one_document_of_each_group_stays(steps):
    before, after = steps["ngram_jaccard"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    own = components(sets, similar(sets))
    assert {r.doc_id for r in after} == {d for d, c in own.items() if d == c}


def test_copies_of_test_items_go(spark, steps):
    before, after = steps["decontamination"]
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in before if any(" ".join(i) in " ".join(decontam.words_of(r.text)) for i in items)}
    kept = {r.doc_id for r in after}
    assert whole and not whole & kept and len(kept) >= 0.9 * len(before)


def test_tokens_decode_to_the_text(steps):
    import hashlib

    before, after = steps["byte_bpe"]
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id: r.decoded_sha256 for r in after} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in after)


def test_odd_rows(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "of", "and", "thing", "other", "house"]) for _ in range(80))
    rows = [(1, None, "en", "s", 1), (2, "", "en", "s", 0), (3, text, None, None, None), (None, text, "en", "s", 5), (4, text, "en", "s", 5), (4, text, "en", "s", 5), (5, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in P.STAGES:
            now = P.stored(stage(spark, now, SMALL), "odd")
        got = {r.doc_id for r in now.collect()}
        assert got == ({None, 3} if table is docs else set())


def test_exact_copies_go_with_their_short_lines(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    short = F.concat(F.lit("Note "), F.col("doc_id").cast("string"), F.lit("\n\u3000\n"), "text", F.lit("\nThe end\n-"))
    planted = docs.withColumn("text", short)
    copies = planted.withColumn("doc_id", F.col("doc_id") + 10_000_000)
    now = planted.unionByName(copies).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    for _, stage in P.STAGES[:3]:
        now = P.stored(stage(spark, now, SMALL), "copies")
    left = {r.doc_id for r in now.select("doc_id").collect()}
    assert left and max(left) < 10_000_000
