import random

from brute import SMALL, components

from usagelens.llm import line_dedup as L
from usagelens.llm.queries import op5_line_dedup


def forms(rows):
    """(doc, line number) -> form, of the lines that count."""
    return {(d, i): f for d, t in rows if t is not None and d is not None for i, x in enumerate(t.split("\n")) if (f := L.line_form(x))}


def chars(form, k):
    return {form[i : i + k] for i in range(max(1, len(form) - k + 1))}


def near(a, b):
    """By shingles of 4 if both are short enough, or by shingles of 8 if both are long enough."""
    for k, fits in ((L.SHORT, max(len(a), len(b)) < L.WIDE), (L.LONG, min(len(a), len(b)) >= L.LONG_FROM)):
        x, y = chars(a, k), chars(b, k)
        if fits and 100 * len(x & y) >= 80 * len(x | y):
            return True
    return False


def expected(rows):
    """Every line but the first of each component, by comparing all distinct forms that share a shingle."""
    where = forms(rows)
    first = {}
    for place in sorted(where):
        first.setdefault(where[place], place)
    index, links = {}, []
    for f in first:
        grams = chars(f, L.SHORT)
        links += [(first[f], first[o]) for o in set().union(*(index.get(g, set()) for g in grams)) if 0.7 <= len(f) / len(o) <= 1.5 and near(f, o)]
        for g in grams:
            index.setdefault(g, set()).add(f)
    own = components(first.values(), links)
    gone = {}
    for place, f in where.items():
        if place != own[first[f]]:
            gone.setdefault(place[0], []).append(place[1])
    return {d: sorted(x) for d, x in gone.items()}


def test_whole_table_finds_nearly_all(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {(d, i) for d, x in expected(rows).items() for i in x}
    got = {}
    for r in op5_line_dedup(spark, SMALL).collect():
        lines = dict(rows)[r.doc_id].split("\n")
        assert r.n_lines == len(lines) and r.n_dropped == len(lines) - len(r.text.split("\n")) or r.text == ""
        got[r.doc_id] = r.text
    assert set(got) == {d for d, _ in rows}
    dropped = {(r.doc_id, i) for r in L.repeated_lines(spark.read.parquet(f"{SMALL}/documents.parquet")).collect() for i in r.lines}
    assert dropped <= want and len(dropped) >= 0.99 * len(want)
    for d, text in rows:
        assert got[d] == "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in dropped)


def test_edits_ties_and_odd_rows(spark):
    rng = random.Random(2)
    line = " ".join(f"word{rng.randrange(999)}" for _ in range(60))
    near = line.replace(line.split()[30], "other", 1)
    far = " ".join(f"text{rng.randrange(999)}" for _ in range(60))
    rows = [
        (5, f"{line}\nshort line\n{far}", "x"), (3, f"{near}\n{near}", "x"), (9, f"{line.upper()}\n\nshort line", "x"), (1, None, "x"),
        (2, "", "x"), (None, line, "x"), (7, "a b c d e", "x"), (7, "a b c d e", "x"), (8, "A  b c d e", "x"), (4, (far + "\n") * 500, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in L.dedup_lines(docs).collect()), key=repr)
    assert got == sorted(
        [
            (5, "short line", 2), (3, near, 1), (9, "", 2), (1, None, 0), (2, "", 0), (None, line, 0), (7, "a b c d e", 0),
            (7, "a b c d e", 0), (8, "", 1), (4, far + "\n", 499),
        ],
        key=repr,
    )
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_clashing_columns_are_kept(spark):
    names = ["gone", "gone_id", "GONE_", "lines", "line_id", "component", "gram", "n_dropped"]
    docs = spark.createDataFrame([(1, "one line\nown", *names), (2, "One line", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = {r.doc_id: r for r in L.dedup_lines(docs).collect()}
    assert found[2].text == "" and (found[2].n_lines, found[2].n_dropped) == (1, 1)
    assert all(found[k][n] == n for k in found for n in names[:-1])


def test_buckets_of_sorted_keys():
    import pyarrow as pa

    rng = random.Random(11)
    rows = sorted((rng.randrange(60), rng.randrange(8)) for _ in range(400)) + [(99, k // 3) for k in range(300)]
    want = {}
    for g, i in rows:
        want.setdefault(g, set()).add(i)
    want = sorted((g, i) for g, s in want.items() if len(s) > 1 for i in s)
    for size in (1, 7, 1000):
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pydict({"line_id": [i for _, i in p], "gram": [g for g, _ in p]}) for p in parts]
        got = [(g, i) for b in L._shared(iter(batches)) for g, i in zip(b["gram"].to_pylist(), b["line_id"].to_pylist(), strict=True)]
        assert got == want


def test_short_lines_and_scripts_without_blanks(spark):
    rng = random.Random(3)
    # one "word" of 120 characters; an edit at the end breaks few of its shingles
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    rows = [(1, f"Menu\n{han}\nRead more\n-\n\u3000\nalone"), (2, f"menu\nown\n{han[:-1]}x\n read  MORE\n-\n\u3000"), (3, "Menu\n" * 300 + "other end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in L.dedup_lines(docs).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("own\n\u3000", 4), 3: ("other end", 300)}


def test_signatures_of_short_forms_are_independent():
    # pairs that share 8 of 26 shingles should rarely meet in a band, near ones nearly always
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    far = near = 0
    for _ in range(300):
        base = word(16 + L.SHORT)
        a, b, c = L._signatures([base, base[: 7 + L.SHORT] + word(9), base[:-1] + "1"], L.SHORT)
        far += bool((a == b).any())
        near += bool((a == c).any())
    assert far < 90 and near > 290


def test_lines_near_the_change_of_shingle_size(spark):
    """Pairs of lines of 110 to 180 characters, one some characters longer: compared one way, the other, or both."""
    rng = random.Random(8)
    lines, want = [], 0
    for i in range(400):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if j % 7 else " " for j in range(1, 111 + i % 70))
        other = line + " " + "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 50)))
        lines.append((line, other))
        want += near(L.line_form(line), L.line_form(other))
    docs = spark.createDataFrame([(1, "\n".join(a for a, _ in lines)), (2, "\n".join(b for _, b in lines))], "doc_id long, text string")
    got = {r.doc_id: r.lines for r in L.repeated_lines(docs).collect()}
    assert set(got) == {2} and all(near(*map(L.line_form, lines[i])) for i in got[2])
    assert 200 < want < 390 and len(got[2]) >= 0.97 * want


def test_one_changed_character_in_short_lines(spark):
    rng = random.Random(7)
    lines = []
    for i in range(300):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if j % 6 else " " for j in range(1, 41 + i % 41))
        at = rng.choice([j for j in range(6, len(line) - 6) if line[j] != " "])
        lines.append((line, line[:at] + "7" + line[at + 1 :]))
    docs = spark.createDataFrame([(1, "\n".join(a for a, _ in lines)), (2, "\n".join(b for _, b in lines))], "doc_id long, text string")
    got = {r.doc_id: r.lines for r in L.repeated_lines(docs).collect()}
    assert set(got) == {2} and len(got[2]) >= 0.97 * len(lines)


def test_packed_band_keys_meet_in_parts():
    """All pairs of a small bucket, the members of a large one, from rows that hold many keys each."""
    import pyarrow as pa

    rng = random.Random(12)
    common = rng.getrandbits(62)
    few = [rng.getrandbits(63) - 2**62 for _ in range(40)]
    lines = [(2 * i, [*rng.sample(few, 3), *([common] if i % 2 else []), *(rng.getrandbits(62) for _ in range(L.BANDS))][: L.BANDS]) for i in range(1, 90)]
    lines += lines[:10]  # the same lines of another batch
    blobs = [b"".join(g.to_bytes(8, "little", signed=True) for g in grams) for _, grams in lines]
    batch = pa.RecordBatch.from_pydict({"line_id": [i for i, _ in lines], "bands": blobs})
    dealt = [r for b in L._dealt(7)(iter([batch.slice(0, 50), batch.slice(50)])) for r in b.to_pylist()]
    assert len(dealt) <= 14 and sum(len(r["grams"]) for r in dealt) == 8 * L.BANDS * len(lines)
    dealt.sort(key=lambda r: r["part"])
    parts = [pa.RecordBatch.from_pylist(dealt[k : k + 2]) for k in range(0, len(dealt), 2)]
    got = [(r["a"], r["b"], r["gram"]) for b in L._meetings(iter(parts)) for r in b.to_pylist()]
    buckets = {}
    for i, grams in lines:
        for g in grams:
            buckets.setdefault(g, set()).add(i)
    small = [sorted(s) for s in buckets.values() if 1 < len(s) <= L.ALL_PAIRS]
    assert {(a, b) for a, b, g in got if g is None} == {(x, y) for s in small for x in s for y in s if x < y} and small
    large = sorted((i, None, g) for g, s in buckets.items() if len(s) > L.ALL_PAIRS for i in s)
    assert sorted(r for r in got if r[2] is not None) == large and len(buckets[common]) > L.ALL_PAIRS


def test_near_pairs_are_verified_exactly():
    import pyarrow as pa

    rng = random.Random(13)
    pairs = []
    for _ in range(700):
        base = "".join(rng.choice("abcde ") for _ in range(rng.randrange(4, 400)))
        at = rng.randrange(len(base))
        k = L.LONG if len(base) >= 144 else L.SHORT
        pairs.append((k, base, base[:at] + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 30))) + base[at + rng.randrange(9) :]))
    forms = [[bytes([k]) + p[i].encode() for k, *p in pairs] for i in (0, 1)]
    batch = pa.RecordBatch.from_pydict({"a": list(range(700)), "b": list(range(700, 1400)), "form_a": forms[0], "form_b": forms[1]})
    got = [r for b in L._near(80)(iter([batch])) for r in b.column("a").to_pylist()]
    want = [i for i, (k, x, y) in enumerate(pairs) if 100 * len(chars(x, k) & chars(y, k)) >= 80 * len(chars(x, k) | chars(y, k))]
    assert got == want and 100 < len(want) < 600
