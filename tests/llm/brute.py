"""Plain definitions that the operators are held against."""

import collections
import re

SMALL = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words(fold(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(nodes, links):
    """node -> smallest node that links reach."""
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def similar(sets, percent=80):
    """Pairs of keys whose sets reach the Jaccard similarity."""
    where = collections.defaultdict(list)
    for key, s in sets.items():
        for g in s:
            where[g].append(key)
    both = collections.Counter((a, b) for keys in where.values() for a in keys for b in keys if a < b)
    return [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def same_rows(df, sql, tables=("documents", "pages"), folder=SMALL):
    """Whether a query's rows equal those of its DuckDB SQL; columns by name."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = found.fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    con.close()
    return sorted(got, key=repr) == sorted(expected, key=repr)
