import random

import numpy as np
from brute import SMALL

from usagelens.llm import licenses as L
from usagelens.llm.queries import op7_license_scan


def brute(text, percent=80):
    """Templates of which four fifths of the shingles stand within one stretch of text of about their length."""
    w = L.normal_words(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    found = set()
    for name, template in L.TEMPLATES.items():
        t = L.normal_words(template)
        want = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        if any(g in want for g in grams):
            size = L.span_length(len(want), percent)
            if any(100 * len(want & set(grams[i : i + size])) >= percent * len(want) for i in range(len(grams))):
                found.add(name)
    return found


def test_whole_table_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {(r.doc_id, name) for r in rows for name in brute(r.text)}
    found = op7_license_scan(spark, SMALL).collect()
    assert want and {(r.doc_id, r.license) for r in found} == want
    texts = {r.doc_id: r.text for r in rows}
    for r in found:
        words = L.normal_words(texts[r.doc_id])[r.first_word : r.last_word + 1]
        assert set(words) & set(L.normal_words(L.TEMPLATES[r.license])) and r.containment >= 80


def test_every_template_is_found_anywhere_and_edited():
    rng = random.Random(4)
    known, hashes = L.Templates(L.TEMPLATES), L._Hashes()
    for name, template in L.TEMPLATES.items():
        words = L.normal_words(template)
        for _ in range(30):
            edited = list(words)
            if len(words) > 60:
                edited[rng.randrange(len(words))] = "changed"
            text = [f"a{rng.randrange(99)}" for _ in range(rng.randrange(300))] + edited + [f"b{rng.randrange(99)}" for _ in range(rng.randrange(300))]
            s = L._shingles(text, hashes)
            assert name in {known.names[i] for _, i, *_ in known.scan(s, np.array([0, len(s)]), 80)}


def _found(text, templates=L.TEMPLATES, percent=80):
    known = L.Templates(templates)
    s = L._shingles(L.normal_words(text), L._Hashes())
    return sorted((known.names[i], a, b) for _, i, a, b, _ in known.best(s, np.array([0, len(s)]), percent))


def test_spans_are_one_occurrence_each():
    rng = random.Random(6)
    foreign = lambda n: [f"f{rng.randrange(9999)}" for _ in range(n)]
    mit = L.normal_words(L.TEMPLATES["MIT"])
    half = len(mit) // 2
    assert _found(" ".join(foreign(30) + mit[:half] + foreign(100) + mit[half:] + foreign(30))) == []
    assert [x for x in _found(" ".join(foreign(9) + mit + foreign(3) + mit)) if x[0] == "MIT"] == [("MIT", 9, 9 + len(mit) - 5), ("MIT", 12 + len(mit), 12 + 2 * len(mit) - 5)]
    assert [(n, b - a) for n, a, b in _found(" ".join(mit * 4))] == [("MIT", len(mit) - 5)] * 4
    inner = mit[:half] + foreign(5) + mit[half:]
    assert [n for n, *_ in _found(" ".join(inner))] == ["MIT"]
    notice = L.TEMPLATES["MIT-notice"]
    assert [n for n, *_ in _found(f"{notice} {notice} other words between {notice}")] == ["MIT-notice"] * 3


def test_occurrences_equal_every_window():
    rng = random.Random(9)
    template = [f"t{i}" for i in range(30)]
    known, hashes = L.Templates({"t": " ".join(template)}), L._Hashes()
    n = len(known.sets[0])
    for _ in range(200):
        words = []
        for _ in range(rng.randrange(1, 5)):
            part = [w for w in template if rng.random() > rng.choice([0, 0.02, 0.3])]
            words += part[: rng.randrange(5, 40)] + [f"f{rng.randrange(99)}" for _ in range(rng.randrange(0, 25))]
        s = L._shingles(words, hashes)
        size = L.span_length(n, 80)
        want = any(len(np.intersect1d(s[i : i + size], known.sets[0])) >= 0.8 * n for i in range(len(s)))
        spans = list(known.occurrences(s, 0, 80))
        assert bool(spans) == want
        assert all(b - a < size and len(np.intersect1d(s[a : b + 1], known.sets[0])) == m >= 0.8 * n for a, b, m in spans)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_versions_of_a_license_are_told_apart(spark, tmp_path):
    """Long templates that differ in some passages only."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(4000)}" for _ in range(3000)]
    version = {"one": list(base), "two": list(base), "other": [f"v{rng.randrange(4000)}" for _ in range(900)]}
    for k in range(0, 3000, 60):
        version["two"][k : k + 3] = ["changed", "in", "two"]
    for name, words in version.items():
        (tmp_path / name).write_text(" ".join(words))
    templates = L.read_templates(spark, f"file://{tmp_path}")
    assert set(templates) == set(version)
    rows = [(1, " ".join(version["one"])), (2, "x " * 500 + " ".join(version["two"])), (3, " ".join(version["two"] + version["one"])), (4, " ".join(base[:2000]))]
    got = sorted((r.doc_id, r.license) for r in L.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect())
    assert got == [(1, "one"), (2, "two"), (3, "one"), (3, "two")]


def test_odd_rows(spark):
    mit = L.TEMPLATES["MIT-notice"]
    rows = [(1, None, "x"), (2, "", "x"), (3, "MIT", "x"), (None, mit, "x"), (4, mit.upper(), "x"), (4, mit.upper(), "x"), (5, "z " * 200_000 + mit + " y" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license, r.first_word) for r in L.license_matches(docs).collect()), key=repr)
    assert got == sorted([(None, "MIT-notice", 0), (4, "MIT-notice", 0), (4, "MIT-notice", 0), (5, "MIT-notice", 200_000)], key=repr)
    assert L.license_matches(docs.limit(0)).count() == 0
