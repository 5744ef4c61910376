import datetime as dt
import random

from tidelog.operators import exactly_once as once

SCHEMA = "tenant string, id string, collected timestamp, seq long, n int, s string, keep string"


def brute(rows):
    groups = {}
    for r in rows:
        key = (r[0], r[1]) if r[0] is not None and r[1] is not None else ("own", r[3])
        groups.setdefault(key, []).append(r)
    return {min(g, key=lambda r: (r[2] is None, r[2] or dt.datetime.min, r[3]))[3] for g in groups.values()}


def make(n, ids, seed):
    r = random.Random(seed)
    return [(r.choice(["t", "u", None]), str(r.randrange(ids)) if r.random() > 0.05 else None, dt.datetime(2024, 1, r.randrange(1, 4)) if r.random() > 0.2 else None, i, 1, "x", "k") for i in range(n)]


def test_against_brute_force(spark):
    for ids in (5, 200):
        rows = make(300, ids, ids)
        df = spark.createDataFrame(rows, SCHEMA)
        want = brute(rows)
        assert {r[0] for r in once.kept_rows(df, ["tenant", "id"], "collected", "seq").collect()} == want
        assert {r[0] for r in once.dropped_rows(df, ["tenant", "id"], "collected", "seq").collect()} == {r[3] for r in rows} - want
        whole = once.exactly_once(df, ["tenant", "id"], "collected", "seq")
        assert whole.columns == df.columns and {r["seq"] for r in whole.collect()} == want and whole.count() == len(want)


def test_hot_identity_and_empty(spark):
    rows = [("t", "hot", dt.datetime(2024, 1, 1), i, 1, "x", "k") for i in range(5000)] + make(100, 50, 1)
    rows = [(*r[:3], i, *r[4:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert once.exactly_once(df, ["tenant", "id"], "collected", "seq").count() == len(brute(rows))
    assert once.exactly_once(spark.createDataFrame([], SCHEMA), ["tenant", "id"], "collected", "seq").count() == 0


def test_stored_and_new(spark):
    old, new = make(100, 30, 4), [(*r[:3], r[3] + 1000, *r[4:]) for r in make(100, 30, 5)]
    got = once.merge_new(spark.createDataFrame(old, SCHEMA).drop("keep"), spark.createDataFrame(new, SCHEMA), ["tenant", "id"], "collected", "seq")
    assert {r["seq"] for r in got.collect()} == brute(old + new)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(once, "BROADCAST_ROWS", 1)
    rows = make(300, 40, 7) + [("t", "hot", dt.datetime(2024, 1, 2), 1000 + i, 1, "x", "k") for i in range(500)]
    df, want = spark.createDataFrame(rows, SCHEMA), brute(rows)
    assert {r["seq"] for r in once.exactly_once(df, ["tenant", "id"], "collected", "seq").collect()} == want
    assert {r[0] for r in once.dropped_rows(df, ["tenant", "id"], "collected", "seq").collect()} == {r[3] for r in rows} - want


def test_same_hash_keeps_both(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(once, "_hash", lambda identity: F.when(once._known(identity), F.lit(7).cast("long")))
    rows = make(200, 30, 9)
    df, want = spark.createDataFrame(rows, SCHEMA), brute(rows)
    assert {r["seq"] for r in once.exactly_once(df, ["tenant", "id"], "collected", "seq").collect()} == want


def test_singletons_are_neither_shuffled_nor_ranked(spark):
    rows = [("t", str(i), dt.datetime(2024, 1, 1), i, 1, "x", "k") for i in range(200)] + [("t", "0", None, 500, 1, "y", "k")]
    split = once._Split(spark.createDataFrame(rows, SCHEMA), ["tenant", "id"], "collected", "seq")
    assert split.ranked.count() == 2 and split.first.count() == 1
    plan = split.kept()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and split.kept().count() == 200


def test_copy_counts(spark):
    rows = [("t", "a", None, 1, 1, "x", "k"), ("t", "a", None, 2, 1, "x", "k"), ("t", "b", None, 3, 1, "x", "k"), (None, "b", None, 4, 1, "x", "k")]
    assert {tuple(r) for r in once.copy_counts(spark.createDataFrame(rows, SCHEMA), ["tenant", "id"]).collect()} == {(2, 1), (1, 1)}
