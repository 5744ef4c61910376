"""Registered queries against their SQL on the smallest tables."""
import os

import pytest

FOLDER = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(FOLDER):
    pytest.skip("the test tables aren't here", allow_module_level=True)

from tidelog.queries import problems, searches  # noqa: E402

QUERIES, SQL = problems.QUERIES | searches.QUERIES, problems.SQL | searches.SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def rows(table):
    names = sorted(table.column_names)
    out = []
    for r in zip(*[table[n].to_pylist() for n in names]):
        out.append(tuple(None if x is None or x != x else round(float(x), 4) if isinstance(x, int | float) and not isinstance(x, bool) else str(x) for x in r))
    return names, sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    names, got = rows(QUERIES[name](spark, FOLDER).toArrow())
    want_names, want = rows(con.execute(SQL[name]).to_arrow_table())
    assert names == want_names and len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-4) if all(isinstance(x, float) for x in (*a, *b)) else all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4) for x, y in zip(a, b)), name


def test_every_query_has_a_place():
    import __spark_entry__

    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_snapshot_covers_most_of_its_tenant(spark):
    seen = sum(r["count"] for r in QUERIES["scan_snapshot"](spark, FOLDER).collect())
    of_tenant = spark.read.parquet(f"{FOLDER}/log_events.parquet").where("tenant_id = 'tn-harbor'").count()
    assert 0.8 * of_tenant < seen < of_tenant


def test_list_and_timechart_take_every_user(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    assert QUERIES["agg_list"](spark, FOLDER).count() == events.where("user_id is not null").select("user_id").distinct().count()
    in_range = events.where("event_type = 'error' and ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-20'").count()
    assert sum(r["count"] for r in QUERIES["cmd_timechart"](spark, FOLDER).collect()) == in_range


def test_json_lines_take_every_decoded_raw(spark):
    got = {r["has_fields"]: r["count"] for r in QUERIES["source_json_lines"](spark, FOLDER).groupBy("has_fields").count().collect()}
    raws = spark.read.parquet(f"{FOLDER}/log_events.parquet").where("raw_encoding = 1 and trim(raw) != ''")
    assert sum(got.values()) == raws.count() and 0 < got[True] < got[False] + got[True]
