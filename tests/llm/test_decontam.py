import random

import numpy as np
from brute import SMALL

from usagelens.llm import decontam as D
from usagelens.llm.queries import op9_decontamination


def slow_alignment(a, b):
    row = [0] * (len(b) + 1)
    best = 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, max(row))
    return best


def test_alignment_equals_definition():
    rng = random.Random(6)
    for _ in range(300):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 15))])
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 25))])
        assert D.alignment(a, b) == slow_alignment(a, b)


def test_whole_table_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    want = set()
    for r in items:
        item = D.words_of(r.text)
        grams = {tuple(item[i : i + D.GRAM]) for i in range(len(item) - D.GRAM + 1)}
        for d in docs:
            w = D.words_of(d.text)
            if any(tuple(w[i : i + D.GRAM]) in grams for i in range(len(w))):
                ids = {x: i for i, x in enumerate(set(w) | set(item))}
                score = D.alignment(np.array([ids[x] for x in item]), np.array([ids[x] for x in w])) / len(item)
                if score >= D.LEAST_SCORE:
                    want.add((d.doc_id, r.item_id, round(score, 9)))
    got = {(r.doc_id, r.item_id, round(r.score, 9)) for r in op9_decontamination(spark, SMALL).collect()}
    assert want and got == want


def test_edited_copies_and_odd_rows(spark):
    rng = random.Random(8)
    item = [f"w{rng.randrange(500)}" for _ in range(40)]
    edited = list(item)
    for i in range(3, 40, 9):
        edited[i] = "new"
    del edited[20]
    far = [f"v{rng.randrange(500)}" for _ in range(200)]
    rows = [(1, " ".join(far + edited + far), "x"), (2, " ".join(far), "x"), (3, None, "x"), (4, "", "x"), (None, " ".join(item), "x"), (5, " ".join(item), "x"), (5, " ".join(item), "x")]
    rows += [(100 + k, ", ".join(item).upper(), "x") for k in range(300)] + [(6, " ".join(far * 500 + item), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (None, "x"), (9, None), (7, "")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, round(r.score, 2)) for r in D.contaminated(docs, bench).collect()}
    assert set(got) == {1, 5, 6, *range(100, 400)}
    assert got[5] == (7, 1.0) and 0.5 <= got[1][1] < 0.9
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


def test_multiplied_edited_copies_and_short_items(spark):
    rng = random.Random(9)
    item = [f"w{i}" for i in range(16)]
    edited = [*item[:5], "new", *item[6:10], "other", *item[11:]]
    around = lambda words, n=30: " ".join([f"v{rng.randrange(9999)}" for _ in range(n)] + words + ["end"])
    rows = [(i, around(item)) for i in range(3)] + [(100 + i, around(edited)) for i in range(1000)]
    rows += [(2000, around(["What", "is", "this?"])), (2001, around(["what", "this", "is"])), (2002, around(["two", "and", "two", "make", "four"])), (2003, "this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "what is this"), (9, "Two and two make four.")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.first_word) for r in D.contaminated(docs, bench).collect()}
    assert set(got) == {(i, 7) for i in [*range(3), *range(100, 1100)]} | {(2000, 8), (2002, 9)}
    assert got[100, 7][0] == 0.75 and got[2000, 8] == (1.0, 30)


def _language(rng, n):
    """Words with a common turn of phrase here and there."""
    out = []
    while len(out) < n:
        out += "one of the most common things".split() if rng.random() < 0.05 else [f"v{rng.randrange(2000)}"]
    return out[:n]


def test_an_ngram_of_all_documents_seeds_none(spark, monkeypatch):
    rng = random.Random(12)
    item = [f"w{i}" for i in range(12)] + "one of the most common things".split() + [f"w{i}" for i in range(20, 32)]
    phrase = D.index_items([0], [D._hashed("one of the most", D._Hashes())]).grams[D.SHORT_GRAM]
    assert len(phrase[0]) == 2  # an item of four words has n-grams of three
    wide = D.combine(D.mix(D._hashed("one of the most", D._Hashes())), D.GRAM).view(np.int64)[0]
    edited = [x for x in item if x not in ("w3", "w9", "w25")]
    rows = [(k, " ".join(_language(rng, 150) + "one of the most common things".split() + _language(rng, 50))) for k in range(400)]
    rows += [(1000 + k, " ".join(_language(rng, 60) + (item if k % 2 else edited) + _language(rng, 60))) for k in range(500)]
    seeds, looked = [], []
    monkeypatch.setattr(D, "seeds_of", lambda items, rank, f=D.seeds_of: seeds.append(f(items, rank)) or seeds[-1])
    monkeypatch.setattr(D, "join_ids", lambda texts, chosen, *a, f=D.join_ids: looked.append(a[-1]) or f(texts, chosen, *a))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id for r in D.contaminated(docs, bench).collect()}
    assert got == set(range(1000, 1500))
    keys = seeds[0].grams[D.GRAM][0]
    assert wide not in keys and 10 < len(keys) < len(item)
    assert looked[0] <= 510  # the 400 documents with the phrase alone are not aligned


def test_recall_of_edited_copies(spark):
    rng = random.Random(13)
    items = {i: _language(rng, rng.choice([5, 6, 7, 9, 14, 25, 60])) for i in range(120)}
    rows, want = [], set()
    for k in range(1200):
        i = k % 120
        words = []
        for w in items[i]:
            what = rng.random()
            words += [] if what < 0.06 else [f"x{rng.randrange(999)}"] if what < 0.18 else [w, f"y{rng.randrange(999)}"] if what < 0.22 else [w]
        text = _language(rng, 40) + words + _language(rng, 40)
        ids = {x: n for n, x in enumerate({*text, *items[i]})}
        if slow_alignment([ids[x] for x in items[i]], [ids[x] for x in text]) >= D.needed(len(items[i]), D.LEAST_SCORE):
            want.add((k, i))
        rows.append((k, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    print("edited copies", len(want), "found", len(got & want))
    assert len(want) > 600 and len(got & want) >= 0.95 * len(want)


def test_edited_short_items_and_single_words(spark):
    item = "the quick brown fox jumps over fences"
    docs = ["so the quick brown cat jumps over fences here", "the quick red fox jumps over walls", "quick brown fox jumps over fences", "the fox over there jumps", "the", item]
    docs = spark.createDataFrame(list(enumerate(f"aa bb {d} cc dd" for d in docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "the"), (3, "quick RED fox")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 3) for r in D.contaminated(docs, bench).collect()}
    assert got == {(0, 1): 0.714, (2, 1): 0.857, (5, 1): 1.0, (1, 3): 1.0}


def test_every_text_of_a_repeated_id_is_looked_at(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {item}"), (1, "z other text"), (1, None), (2, "z"), (2, "zz")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (5, "a")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in D.contaminated(docs, bench).collect()] == [(1, 5, 1.0)]


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, D.contaminated(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_GRAMS", 400)
    assert whole and sorted(map(tuple, D.contaminated(docs, items).collect())) == whole
