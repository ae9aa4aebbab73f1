import random

import numpy as np

from stemma.operators.diff import Presence, compare_tables

SCHEMA = "k string, n int, label string, pos bigint, difference string"


def brute(a, b):
    def first(rows):
        out = {}
        for k, n, label, pos, _ in rows:
            v = (label, pos)
            order = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
            if (k, n) not in out or order(v) < order(out[k, n]):
                out[k, n] = v
        return out

    x, y = first(a), first(b)
    want = [(k, "gone") for k in x.keys() - y.keys()] + [(k, "new") for k in y.keys() - x.keys()]
    for k in x.keys() & y.keys():
        want += [(k, f) for f, i in (("label", 0), ("pos", 1)) if x[k][i] != y[k][i]]
    return sorted(want, key=repr)


def run(spark, a, b):
    rows = compare_tables(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["k", "n"], ["label", "pos"], "gone", "new").collect()
    return sorted((((r["k"], r["n"]), r["difference"]) for r in rows), key=repr), rows


def test_random_tables(spark):
    rng = random.Random(3)

    def side():
        rows = [(rng.choice(["a", "b", None, "ü"]), rng.choice([None, *range(40)]), rng.choice([None, "", "x", "X"]), rng.choice([None, 1, 2]), "clash") for _ in range(150)]
        return rows + rng.choices(rows, k=60)

    a, b = side(), side()
    got, _ = run(spark, a, b)
    assert got == brute(a, b)


def test_same_and_empty(spark):
    a = [("a", 1, None, 5, "")] * 3
    assert run(spark, a, a)[0] == []
    assert run(spark, a, [])[0] == [(("a", 1), "gone")]
    assert run(spark, [], a)[0] == [(("a", 1), "new")]
    assert run(spark, [], [])[0] == []


def test_values_come_out(spark):
    _, rows = run(spark, [("a", 1, "x", 5, "")], [("a", 1, None, 6, "")])
    assert {(r["difference"], r["left_value"], r["right_value"]) for r in rows} == {("label", "x", None), ("pos", "5", "6")}


def test_bitmaps_sparse_and_dense():
    rng = np.random.default_rng(1)
    for n in (1, 7, 64, 5000):
        for share in (0.0, 0.01, 0.5, 1.0):
            a, b = np.flatnonzero(rng.random(n) < share), np.flatnonzero(rng.random(n) < 0.4)
            x, y = Presence(n, a), Presence(n, b)
            assert x.and_not(y).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
            assert x.both(y).tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_runs_of_many_ordinals():
    rng = np.random.default_rng(2)
    for share in (0.001, 0.03, 0.2, 0.9):
        n = 200_000
        a, b = np.flatnonzero(rng.random(n) < share), np.flatnonzero(rng.random(n) < 0.1)
        for x, y in ((a, b), (b, a)):
            p, q = Presence(n, x), Presence(n, y)
            assert np.array_equal(p.and_not(q), np.setdiff1d(x, y))
            assert np.array_equal(p.both(q), np.intersect1d(x, y))


def test_keys_and_fields_of_other_types(spark):
    import datetime
    from decimal import Decimal

    schema = "k date, t timestamp, d decimal(9,2), x double"
    day, at = datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4)
    a = spark.createDataFrame([(day, at, Decimal("1.50"), float("nan")), (day, at, Decimal("2.50"), 1.0), (None, at, None, None)], schema)
    b = spark.createDataFrame([(day, at, Decimal("1.50"), float("nan")), (day, at, Decimal("2.50"), 1.5)], schema)
    rows = compare_tables(a, b, ["k", "t", "d"], ["x"]).collect()
    assert sorted((str(r["d"]), r["difference"], r["left_value"], r["right_value"]) for r in rows) == [("2.50", "x", "1", "1.5"), ("None", "only_left", None, None)]


def test_a_key_that_fills_chunks(spark):
    rows = [("a", 1, f"x{i % 997:03}", i, "") for i in range(30_000)]
    got, _ = run(spark, rows, [("a", 1, "x000", 0, ""), ("b", 2, None, None, "")])
    assert got == [(("b", 2), "new")]
