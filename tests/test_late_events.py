import datetime as dt
import random

import pytest

from tidelog.operators import late_events as late

SCHEMA = "tenant string, id string, idx string, at timestamp, arrived timestamp, v long, n_late string, period_start int"
T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def row(i, idx="a", at=T0, arrived=None, tenant="t", v=1):
    return (tenant, i, idx, at, arrived, v, "clash", 7)


def brute(rows, rule=late.Lateness()):
    first = {}
    for n, (tenant, i, idx, at, arrived, v, _, _) in enumerate(rows):
        key = (tenant, i) if tenant is not None and i is not None else ("own", n)
        big = dt.datetime(9999, 1, 1)
        if key not in first or (arrived or big) < (first[key][2] or big):
            first[key] = (idx, at, arrived)
    out = {}
    for idx, at, arrived in first.values():
        start = None if at is None else int((at - dt.datetime(1970, 1, 1)).total_seconds() // rule.period_s * rule.period_s)
        ok = was_late = False
        if at is not None and arrived is not None:
            gone = (arrived - dt.datetime(1970, 1, 1)).total_seconds() - start - rule.period_s
            ok, was_late = gone <= rule.cutoff_s, rule.grace_s < gone <= rule.cutoff_s
        c = out.setdefault((idx, start), [0, 0, 0])
        c[0] += ok
        c[1] += was_late
        c[2] += not ok
    return {k: tuple(v) for k, v in out.items()}


def counts(df):
    return {(r["idx"], r["period_start"]): (r["n_accepted"], r["n_late"], r["n_refused"]) for r in df.collect()}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return late.combine_partials(late.period_partials(df, ["idx"], event_time="at", arrival="arrived", identity=["tenant", "id"], **kw), ["idx"], kw.get("values", ()))


def test_limits_nulls_and_copies(spark):
    rows = [
        row("1", arrived=T0 + H + dt.timedelta(minutes=5)), row("2", arrived=T0 + H + dt.timedelta(minutes=5, microseconds=1)), row("3", arrived=T0 + 25 * H), row("4", arrived=T0 + 25 * H + dt.timedelta(microseconds=1)),
        row("1", arrived=T0 + 20 * H), row("5", at=None, arrived=T0), row("6", arrived=None), row(None, arrived=T0), row(None, arrived=T0), row("7", idx=None, arrived=T0), row("8", at=T0 - 10 * H, arrived=T0 - 11 * H),
        row("1", arrived=T0, tenant="other"), row("9", at=dt.datetime(1969, 12, 31, 23, 30), arrived=dt.datetime(1970, 1, 1)),
    ]
    assert counts(run(spark, rows)) == brute(rows)


def test_random_against_brute_force(spark):
    r = random.Random(3)
    rows = [row(str(r.randrange(60)), idx=r.choice("abc"), at=T0 + r.randrange(5) * H, arrived=T0 + dt.timedelta(minutes=r.randrange(3000))) for _ in range(400)]
    same = {}
    for x in rows:  # copies share index and time
        same.setdefault(x[1], x)
    rows = [(*x[:2], same[x[1]][2], same[x[1]][3], *x[4:]) for x in rows]
    assert counts(run(spark, rows)) == brute(rows)


def test_values_and_empty(spark):
    got = run(spark, [row("1", arrived=T0, v=5), row("2", arrived=T0 + 30 * H, v=100), row("3", arrived=T0, v=None)], values=["v"]).collect()[0]
    assert (got["sum_v"], got["min_v"], got["max_v"], got["n_v"], got["n_refused"]) == (5, 5, 5, 1, 1)
    assert run(spark, []).collect() == []


def test_partials_merge_in_any_split(spark):
    rows = [row(str(i), at=T0 + i % 3 * H, arrived=T0 + dt.timedelta(minutes=37 * i)) for i in range(60)]
    parts = [late.period_partials(spark.createDataFrame(rows[a::3], SCHEMA), ["idx"], event_time="at", arrival="arrived", identity=["tenant", "id"]) for a in range(3)]
    assert counts(late.combine_partials(parts[0].unionAll(parts[1]).unionAll(parts[2]), ["idx"])) == brute(rows)


def test_store_merges_batches_once(spark, tmp_path):
    rows = [row(str(i), at=T0 + i % 3 * H, arrived=T0 + dt.timedelta(minutes=61 * i)) for i in range(40)]
    batches = [rows[:15], rows[15:30] + [(*r[:4], r[4] + 16 * H, *r[5:]) for r in rows[3:9]], rows[30:]]
    store = late.PeriodStore(spark, str(tmp_path / "s"), ["idx"], event_time="at", arrival="arrived", identity=["tenant", "id"])
    for i, b in enumerate(batches):
        store.merge(spark.createDataFrame(b, SCHEMA), f"{i:03d}")
    store.merge(spark.createDataFrame(batches[2], SCHEMA), "002")  # a retry
    accepted = {k: v[:2] for k, v in counts(store.read()).items()}
    assert accepted == {k: v[:2] for k, v in brute(rows).items()}


def test_store_counts_redeliveries_of_closed_periods_nowhere(spark, tmp_path):
    rows = [row(str(i), at=T0 + i % 5 * H, arrived=T0 + dt.timedelta(hours=2 * i), v=i) for i in range(30)]
    again = [(*r[:4], r[4] + dt.timedelta(hours=70), *r[5:]) for r in rows[::4]]  # past the cut-off of their periods
    store = late.PeriodStore(spark, str(tmp_path / "s"), ["idx"], event_time="at", arrival="arrived", identity=["tenant", "id"], values=["v"])
    for i, b in enumerate((rows[:20], rows[20:] + again)):
        store.merge(spark.createDataFrame(b, SCHEMA), f"{i:03d}")
    assert counts(store.read()) == brute(rows)
    whole = late.combine_partials(late.period_partials(spark.createDataFrame(rows, SCHEMA), ["idx"], event_time="at", arrival="arrived", identity=["tenant", "id"], values=["v"]), ["idx"], ["v"])
    assert sorted(map(tuple, store.read().drop("n_batches").collect())) == sorted(map(tuple, whole.drop("n_batches").collect()))
    # a batch reads the identities of its own days only
    seen = spark.read.parquet(str(tmp_path / "s/seen"))
    assert "day" in seen.columns and seen.where("day = 0").count() == 0


@pytest.mark.parametrize("ids", [["7", "007", "x"], ["2024-01-01", "2024-01-02", "b"]])
def test_batch_ids_are_texts(spark, tmp_path, ids):
    rows = [row(str(i), at=T0, arrived=T0 + dt.timedelta(minutes=i)) for i in range(9)]
    store = late.PeriodStore(spark, str(tmp_path / "s"), ["idx"], event_time="at", arrival="arrived", identity=["tenant", "id"])
    for i, b in enumerate(ids):
        store.merge(spark.createDataFrame(rows[3 * i : 3 * i + 3], SCHEMA), b)
    store.merge(spark.createDataFrame(rows[6:], SCHEMA), ids[2])
    assert counts(store.read()) == brute(rows)
