import random

from brute import components as brute

from usagelens.llm.components import components


def test_paths_stars_and_odd_edges(spark):
    rng = random.Random(1)
    path = list(range(1000, 1040))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(7, k) for k in range(8, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    odd = [(3, 3), (None, 5), (6, None), (7, 8), (8, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges + odd, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == brute({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_task_turns_its_edges_into_stars():
    import random

    import pyarrow as pa

    from usagelens.llm.components import _contracted

    rng = random.Random(3)
    edges = [(i + 1, i) for i in range(400)] + [(rng.randrange(500, 900), rng.randrange(500, 600)) for _ in range(200)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    batches = [pa.RecordBatch.from_pylist([{"u": u, "v": v} for u, v in edges[k : k + 50]]) for k in range(0, len(edges), 50)]
    got = [(r["u"], r["v"]) for b in _contracted(iter(batches)) for r in b.to_pylist()]
    own = brute({x for e in edges for x in e}, edges)
    assert sorted(got) == sorted((u, low) for u, low in own.items() if u != low)
