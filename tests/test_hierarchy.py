import random
from collections import Counter

import pytest

from stemma.operators import hierarchy as H

SCHEMA = "doc string, node int, up int, g string, id string, p string, via string"


def brute(rows):
    """{(doc, node): (root, depth, path, status)} by walking up."""
    parent = {}
    for doc, node, up in rows:
        if node is not None:
            key = (doc, node)
            old = parent.get(key, ...)
            up = None if up == -1 else up
            parent[key] = up if old in (..., None) else old if up is None else min(old, up)
    out = {}
    for doc, node in parent:
        path, at, seen = [node], node, {node}
        while True:
            up = parent[doc, at]
            if up is None or (doc, up) not in parent:
                out[doc, node] = (path[-1], len(path) - 1, "/".join(map(str, path[::-1])), "tree" if up is None else "orphan")
                break
            if up in seen:
                out[doc, node] = (None, None, None, "cycle" if up == node else "?")
                break
            seen.add(up)
            path.append(up)
            at = up
        if out[doc, node][3] == "?":
            out[doc, node] = (None, None, None, "below_cycle")
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, n, u, "x", "y", "z", "v") for d, n, u in rows], SCHEMA)
    all_ = H.hierarchy(df, ["doc"], "node", "up", **kw).collect()
    got = {(r["doc"], r["node"]): (r["root_id"], r["depth"], r["path"], r["status"]) for r in all_}
    below = Counter((doc, int(x)) for (doc, _), v in got.items() if v[2] for x in v[2].split("/")[:-1])
    for r in all_:
        assert r["n_descendants"] == (None if r["path"] is None else below[r["doc"], r["node"]])
    assert len(all_) == len(got)
    cycles = {(r["doc"], r["node"]) for r in H.find_cycles(df, ["doc"], "node", "up", **kw).collect()}
    return got, cycles, df


# Whole blocks; small blocks finished by one task; small blocks with rounds of joins to the end.
@pytest.mark.parametrize("kw", [{}, {"bits": 2}, {"bits": 1, "rest_rows": 60}])
def test_random_forests_with_cycles_orphans_copies_and_nulls(spark, kw):
    rng = random.Random(5)
    rows = []
    for doc in ["a", "b", None, "chain", "star", "ring"]:
        n = 40
        for i in range(n):
            up = {"chain": i - 1, "star": 0 if i else -1, "ring": (i + 1) % n}.get(doc)
            if up is None:
                up = rng.choice([None, -1, 999, *range(n)])
            rows.append((doc, i, up))
    rows += rng.sample(rows, 20) + [("a", None, 3), ("a", 500, 500)]
    got, cycles, df = run(spark, rows, **kw)
    want = brute(rows)
    assert got == want
    assert cycles == {k for k, v in want.items() if v[3] == "cycle"}
    pairs = sorted((r["doc"] or "", r["node"], r["descendant_id"], r["distance"]) for r in H.descendants(df, ["doc"], "node", "up", **kw).collect())
    expect = []
    for (doc, node), (_, depth, path, _s) in want.items():
        if path:
            ids = list(map(int, path.split("/")))
            expect += [(doc or "", up, node, depth - k) for k, up in enumerate(ids[:-1])]
    assert pairs == sorted(expect)


def test_descendant_counts(spark):
    df = spark.createDataFrame([("d", 0, -1), ("d", 1, 0), ("d", 2, 1), ("d", 3, 1)], "doc string, node int, up int")
    assert {r["node"]: r["n_descendants"] for r in H.hierarchy(df, ["doc"], "node", "up").collect()} == {0: 3, 1: 2, 2: 0, 3: 0}


def test_empty(spark):
    df = spark.createDataFrame([], "doc string, node int, up int")
    assert H.hierarchy(df, ["doc"], "node", "up").collect() == []
    assert H.find_cycles(df, ["doc"], "node", "up").collect() == []


def test_disputed_parents_are_reported(spark):
    df = spark.createDataFrame([("d", 0, -1), ("d", 1, 0), ("d", 1, 2), ("d", 1, 2), ("d", 2, 0), (None, 3, 1), (None, 3, 1)], "doc string, node int, up int")
    assert [tuple(r) for r in H.disputed_parents(df, ["doc"], "node", "up").collect()] == [("d", 1, 2)]
    assert {r["node"]: r["depth"] for r in H.hierarchy(df, ["doc"], "node", "up").collect()} == {0: 0, 1: 1, 2: 1, 3: 0}


def test_a_deep_chain_streams(spark):
    n = 3000
    df = spark.range(n).selectExpr("'d' AS doc", "id AS node", "id - 1 AS up")
    got = H.hierarchy(df, ["doc"], "node", "up", bits=8).selectExpr("max(depth)", "min(root_id)", "sum(n_descendants)", "count(*)").first()
    assert tuple(got) == (n - 1, 0, n * (n - 1) // 2, n)
