import random

from brute import SMALL, components, same_rows, shingles, similar

from usagelens.llm import oracles
from usagelens.llm.ngram_join import jaccard_components
from usagelens.llm.queries import op2_ngram_jaccard


def expected(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = similar(sets)
    own = components(sets, links)
    return {i: (len(s), own[i]) for i, s in sets.items()}


def test_whole_table_equals_sql(spark):
    assert same_rows(op2_ngram_jaccard(spark, SMALL), oracles.JACCARD)


def test_chains_copies_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(40)}" for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a b"), (4, "A B"), (5, "a b c"), (6, "É b"), (7, "é b")]
    for k in range(8, 60):  # a drift of edits: neighbours link, ends don't
        base[rng.randrange(len(base))] = f"n{k}"
        rows.append((k, " ".join(base)))
    rows += [(100 + k, " ".join(base).upper()) for k in range(20)]
    for k in range(200, 240):  # near copies of one text, some too far from it and from each other
        other = list(base)
        for _ in range(rng.randrange(1, 8)):
            other[rng.randrange(len(base))] = f"z{k}{rng.randrange(9)}"
        rows.append((k, " ".join(other)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "a b", "x"), (3, "a b", "y")], "doc_id long, text string, n_shingles string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == expected(rows)
    assert jaccard_components(docs.limit(0)).count() == 0
