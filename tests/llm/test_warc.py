import gzip

from brute import SMALL, same_rows

from usagelens.llm import oracles
from usagelens.llm.queries import op8_warc
from usagelens.llm.shared import new_path
from usagelens.llm.warc import read_archives, record, salvage, write_archives

DATE = "2024-01-01T00:00:00Z"


def test_whole_table_equals_sql(spark):
    assert same_rows(op8_warc(spark, SMALL), oracles.WARC)


def test_payloads_survive_and_odd_rows(spark):
    rows = [
        (1, "u\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "a"), (2, None, None, "a"), (3, "u", "", "a"), (None, "u", "same", "a"), (4, "u", "same", "a"),
        (9, "u", "same", "a"), (9, "u", "same", "a"), (-7, "u", "z" * 3_000_000, "a"), (5, "u", "other", "a"), (5, "u", "same", "a"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    path = new_path(spark, "warc-test")
    write_archives(pages, path)
    found = read_archives(spark, path)
    assert found.where("kind = 'gap'").count() == 0
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload and bytes(r.payload).decode()) for r in found.collect()), key=repr)
    expected = [
        (1, "response", None, 23, rows[0][2]), (2, "revisit", 3, 0, None), (3, "response", None, 0, ""), (None, "response", None, 4, "same"),
        (4, "revisit", 9, 4, None), (9, "response", None, 4, "same"), (9, "response", None, 4, "same"), (-7, "response", None, 3_000_000, "z" * 3_000_000),
        (5, "response", None, 5, "other"), (5, "revisit", 9, 4, None),
    ]
    assert [x[:4] for x in got] == [x[:4] for x in sorted(expected, key=repr)]
    assert {x[4] for x in got if x[4]} == {x[4] for x in expected if x[4]}
    empty = new_path(spark, "warc-test")
    write_archives(pages.limit(0), empty)
    assert read_archives(spark, empty).where("kind = 'record'").count() == 0
    few = new_path(spark, "warc-test")
    write_archives(pages, few, min_bytes=5)
    assert read_archives(spark, few).where("record_type = 'revisit'").count() == 0


def records():
    return [record(i, f"http://h/{i}", f"<p>page {i}</p>".encode() * 5, None, DATE) + b"\r\n" for i in range(5)]


def ids(data):
    rows = list(salvage(data))
    assert rows[0][1] == 0 and rows[-1][2] == len(data) and all(x[2] == y[1] for x, y in zip(rows, rows[1:], strict=False))
    return [r[3]["page_id"] for r in rows if r[0] == "record"], [(r[1], r[2]) for r in rows if r[0] == "gap"]


def test_salvage_goes_on_after_damage():
    parts = records()
    whole = b"".join(parts)
    start = [sum(map(len, parts[:i])) for i in range(6)]
    assert ids(whole) == ([0, 1, 2, 3, 4], [])
    flipped = bytearray(whole)
    flipped[start[2] - 20] ^= 1  # in the block of record 1
    assert ids(bytes(flipped)) == ([0, 2, 3, 4], [(start[1], start[2])])
    cut = whole[: start[1] + 30] + whole[start[3] :]
    assert ids(cut) == ([0, 3, 4], [(start[1], start[1] + 30)]) or ids(cut)[0] == [0, 3, 4]
    assert ids(whole[:-40])[0] == [0, 1, 2, 3]
    assert ids(b"junk" + whole)[0] == [1, 2, 3, 4] or ids(b"junk\n" + whole)[0] == [0, 1, 2, 3, 4]
    wrong = whole.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert ids(wrong)[0] == [1, 2, 3, 4]


def test_salvage_of_gzip_members():
    parts = [gzip.compress(x) for x in records()]
    assert ids(b"".join(parts)) == ([0, 1, 2, 3, 4], [])
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    found, gaps = ids(parts[0] + bytes(broken) + b"".join(parts[2:]))
    assert found == [0, 2, 3, 4] and gaps[0][0] == len(parts[0])


def test_gzip_members_of_several_records():
    parts = records()
    first, rest = gzip.compress(b"".join(parts[:3])), gzip.compress(parts[3])
    rows = list(salvage(first + rest + parts[4]))
    assert [(r[0], r[3]["page_id"]) for r in rows] == [("record", i) for i in range(5)]
    assert [r[1:3] for r in rows] == [(0, len(first))] * 3 + [(len(first), len(first + rest)), (len(first + rest), len(first + rest + parts[4]))]
    # damage inside a member that unzips: the records around it are kept
    inner = bytearray(b"".join(parts))
    inner[len(parts[0]) + len(parts[1]) // 2 + 60] ^= 1
    rows = list(salvage(gzip.compress(bytes(inner))))
    assert [r[3]["page_id"] for r in rows if r[0] == "record"] == [0, 2, 3, 4]
    gaps = [r[3] for r in rows if r[0] == "gap"]
    assert len(gaps) == 1 and gaps[0].startswith(f"bytes {len(parts[0])} to {len(parts[0]) + len(parts[1])} of the member")
    assert [r[0] for r in salvage(gzip.compress(b""))] == []
