import math
import random

import pytest

from tidelog.operators import skewed_keys as skew

SCHEMA = "a string, b string, v long, n long, lo string, rank int"
QS = [0.0, 0.01, 0.5, 0.95, 1.0]


def brute(rows):
    out = {}
    for f, i in (("a", 0), ("b", 1)):
        for key in {r[i] for r in rows}:
            vs = sorted(r[2] for r in rows if r[i] == key and r[2] is not None)
            n = sum(r[i] == key for r in rows)
            out[f, key] = (n, len(vs), sum(vs) if vs else None, [vs[max(1, math.ceil(round(q * len(vs), 6))) - 1] for q in QS] if vs else None)
    return out


def run(spark, rows, buckets=8):
    df = skew.keyed_selection(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "v", QS, buckets)
    return {(r["key_field"], r["key_value"]): (r["n"], r["n_values"], None if r["total"] is None else int(r["total"]), r["quantiles"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_with_hot_keys_ties_and_nulls(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 8 + ["x", "", None]), str(r.randrange(5)), r.choice([None, 7, 7, r.randrange(-1000, 1000), r.randrange(-(10**12), 10**12)]), 1, "c", 2) for _ in range(400)]
    assert run(spark, rows) == brute(rows)


def test_extremes_one_value_and_empty(spark):
    rows = [("k", None, 2**63 - 1, 1, "c", 2), ("k", None, -(2**63), 1, "c", 2), ("k", None, 2**62, 1, "c", 2), ("k", None, 0, 1, "c", 2), ("z", "q", None, 1, "c", 2)]
    assert run(spark, rows, 1024) == brute(rows)
    assert run(spark, [("k", "k", 3, 1, "c", 2)] * 5) == brute([("k", "k", 3, 1, "c", 2)] * 5)
    assert run(spark, [("k", "k", -1, 1, "c", 2), ("k", "k", 0, 1, "c", 2)]) == brute([("k", "k", -1, 1, "c", 2), ("k", "k", 0, 1, "c", 2)])
    assert run(spark, []) == {} and run(spark, [("k", None, None, 1, "c", 2)]) == {("a", "k"): (1, 0, None, None), ("b", None): (1, 0, None, None)}


def test_shuffled_state_gives_the_same(spark, monkeypatch):
    rows = [(str(i % 7), "h", i * i % 101, 1, "c", 2) for i in range(300)]
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    assert run(spark, rows) == brute(rows)


def test_heavy_keys(spark):
    rows = [("hot", "", 1, 1, "c", 2)] * 95 + [("cold", None, 1, 1, "c", 2)] * 4 + [(None, "x", 1, 1, "c", 2)]
    got = skew.heavy_keys(spark.createDataFrame(rows, SCHEMA), ["a", "b"], 0.05)
    assert [tuple(r) for r in got.collect()] == [("a", "hot", 95)]
    assert skew.heavy_keys(spark.createDataFrame([], SCHEMA), ["a", "b"], 0.05).count() == 0


@pytest.mark.parametrize("bits", [32, 4])
def test_heavy_keys_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(skew, "HASH_BITS", bits)  # with 4 bits many values share a hash
    monkeypatch.setattr(skew, "FIRST_BITS", bits // 2)
    r = random.Random(bits)
    rows = [(r.choice([*"abcdefgh"] * 3 + [None, ""] + [f"v{i}" for i in range(40)]), str(int(r.expovariate(0.2))), 1, 1, "c", 2) for _ in range(600)]
    want = {(f, k) for f, i in (("a", 0), ("b", 1)) for k in {x[i] for x in rows} if k and sum(x[i] == k for x in rows) >= 0.05 * len(rows)}
    got = skew.heavy_keys(spark.createDataFrame(rows, SCHEMA), ["a", "b"], 0.05).collect()
    assert {(x["key_field"], x["key_value"]) for x in got} == want and len(want) > 6
    assert all(x["n"] == sum(y[0 if x["key_field"] == "a" else 1] == x["key_value"] for y in rows) for x in got)


def test_values_at_exactly_the_share(spark):
    rows = [(str(i % 20), "k", 1, 1, "c", 2) for i in range(200)]  # each value holds exactly a twentieth
    assert skew.heavy_keys(spark.createDataFrame(rows, SCHEMA), ["a"], 0.05).count() == 20


@pytest.mark.parametrize("bound", [200_000, 0])
def test_exact_quantiles_of_doubles(spark, monkeypatch, bound):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", bound)
    r = random.Random(6)
    make = [lambda: r.gauss(0, 1), lambda: 10.0 ** r.uniform(-30, 30), lambda: float(r.randrange(3)), lambda: 1.7e308 * r.choice([-1, 1]) * r.random(), lambda: 1.0 + r.randrange(4) * 2.0**-52]
    rows = [(r.choice(["a"] * 9 + ["b", None]), make[i % 5]() if r.random() > 0.05 else r.choice([None, float("nan")])) for i in range(500)]
    got = {x["key"]["g0"]: x["quantiles"] for x in skew.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), [skew.ident("k")], skew.ident("v"), QS).collect()}
    for key in ("a", "b", None):
        vs = sorted(v for k, v in rows if k == key and v is not None and v == v)
        assert got[key] == [vs[max(1, math.ceil(round(q * len(vs), 6))) - 1] for q in QS]
    assert skew.exact_quantiles(spark.createDataFrame([], "k string, v double"), [], skew.ident("v"), QS).collect() == []
