import bisect

import numpy as np
import pytest

from tidelog.llm import quantiles
from tidelog.llm.quantiles import RankSketch

QS = [0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 0.999]


def rank_errors(sketch, values):
    values = sorted(values)
    out = []
    for q, x in zip(QS, sketch.quantiles(QS)):
        lo, hi = bisect.bisect_left(values, x) / len(values), bisect.bisect_right(values, x) / len(values)
        out.append(0 if lo <= q <= hi else min(abs(lo - q), abs(hi - q)))
    return out


def within(sketch, values, slack=4):
    for q, e in zip(QS, rank_errors(sketch, values)):
        assert e <= slack * quantiles.relative_error() * (1 - q) + 2 / len(values), (q, e)


@pytest.mark.parametrize("kind", ["uniform", "heavy", "sorted", "falling", "ties"])
def test_relative_error(kind):
    r = np.random.default_rng(5)
    v = {"uniform": r.integers(0, 10**9, 200_000), "heavy": (r.pareto(0.8, 200_000) * 1000).astype(np.int64), "sorted": np.arange(200_000), "falling": np.arange(200_000)[::-1].copy(), "ties": r.integers(0, 7, 200_000)}[kind]
    s = RankSketch()
    for part in np.array_split(v, 37):
        s.update(part)
    within(s, v)
    assert s.n == len(v) and len(s.to_bytes()) < 8 * 20_000


def test_merged_parts_and_bytes():
    r = np.random.default_rng(6)
    v = (r.lognormal(10, 3, 150_000)).astype(np.int64)
    total = RankSketch()
    for part in np.array_split(v, 50):
        s = RankSketch()
        s.update(part)
        total.merge(RankSketch.from_bytes(s.to_bytes()))
    within(total, v)
    assert RankSketch.from_bytes(total.to_bytes()).quantiles(QS) == total.quantiles(QS)


def test_small_sets_are_exact():
    s = RankSketch()
    s.update(np.array([5, 1, 9, 9, 2]))
    assert s.quantiles([0.0, 0.2, 0.5, 0.95, 1.0]) == [1, 1, 5, 9, 9] and RankSketch().quantiles([0.5]) == [None]


def test_groups_days_nulls_and_unknown_values(spark):
    rows = [("a", "d1", i, i if i % 2 else None, "x") for i in range(2000)] + [("a", "d2", 10**6 + i, -1, "x") for i in range(2000)] + [(None, "d1", 7, None, "x")]
    df = spark.createDataFrame(rows, "app string, day string, m long, k long, sketch string").repartition(7)
    sk = quantiles.merge(quantiles.sketch(df, ["app", "day"], ["m", "k"]), ["app", "day"])
    got = {(r["app"], r["day"], r["metric"]): (r["n"], r["values"]) for r in quantiles.percentiles(sk, ["app", "day"], [0.5, 0.95]).collect()}
    assert set(got) == {("a", "d1", "m"), ("a", "d2", "m"), ("a", "d1", "k"), (None, "d1", "m")}
    assert got["a", "d1", "m"][0] == 2000 and abs(got["a", "d1", "m"][1][1] - 1899) < 15 and got["a", "d1", "k"][0] == 1000 and got[None, "d1", "m"] == (1, [7, 7])
    days = {r["app"]: r["n"] for r in quantiles.percentiles(quantiles.merge(sk, ["app"]), ["app"], [0.5]).where("metric = 'm'").collect()}
    assert days == {"a": 4000, None: 1}
    assert quantiles.percentiles(quantiles.merge(quantiles.sketch(df.where("false"), ["app", "day"], ["m"]), ["app", "day"]), ["app", "day"], [0.5]).collect() == []


def test_many_open_groups_are_sent_on(spark, monkeypatch):
    df = spark.range(300).selectExpr("cast(id % 100 as string) g", "id v").coalesce(1)
    monkeypatch.setattr(quantiles, "OPEN_SKETCHES", 10)
    got = quantiles.percentiles(quantiles.merge(quantiles.sketch(df, ["g"], ["v"]), ["g"]), ["g"], [0.5]).collect()
    assert len(got) == 100 and all(r["n"] == 3 and r["values"] == [100 + int(r["g"])] for r in got)


@pytest.mark.parametrize("fan_in", [2, 5, 32])
def test_merging_as_a_tree(spark, fan_in):
    df = spark.range(40_000).selectExpr("cast(id % 2 as string) g", "id v").repartition(23)
    got = quantiles.percentiles(quantiles.merge(quantiles.sketch(df, ["g"], ["v"]), ["g"], fan_in), ["g"], QS).collect()
    assert sorted((r["g"], r["n"]) for r in got) == [("0", 20_000), ("1", 20_000)]
    for r in got:
        assert all(abs(v / 40_000 - q) <= 4 * quantiles.relative_error() * (1 - q) + 1e-4 for q, v in zip(QS, r["values"]))


def test_once_each(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 5), ("b", 2, 2), (None, 3, 3), (None, 3, 3)], "id string, x int, y int")
    assert sorted(map(tuple, quantiles.once_each(df, "id", ["x", "y"]).collect())) == [(1, 5), (2, 2), (3, 3), (3, 3)]
