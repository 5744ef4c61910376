import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.operators import log_lines as logs

NEAR = dt.datetime(2023, 1, 2, 12)


def at(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp())


CASES = [
    # raw, layout, epoch, level, component, message
    ("2023-01-03 09:46:36,923 ERROR [pool-0] com.x.Wal - cannot decode\n\tat a.b.C", "thread_after", at(2023, 1, 3, 9, 46, 36), "error", "com.x.Wal", "cannot decode\n\tat a.b.C"),
    ("2023-01-10 18:00:11,249 [worker 7] FATAL com.x.Cache: closed", "thread_before", at(2023, 1, 10, 18, 0, 11), "fatal", "com.x.Cache", "closed"),
    ("2023-01-03 18:04:41,337 - billing.planner - WARNING - slow", "dashed", at(2023, 1, 3, 18, 4, 41), "warn", "billing.planner", "slow"),
    ("CRITICAL:ledger.planner:2023-01-12 16:02:37,157: deadline", "level_first", at(2023, 1, 12, 16, 2, 37), "fatal", "ledger.planner", "deadline"),
    ("Jan 03, 2023 12:28:47 AM com.x.Planner step0\r\nSEVERE: gone\r\n\tat x", "clock12", at(2023, 1, 3, 0, 28, 47), "error", "com.x.Planner", "gone\r\n\tat x"),
    ("Jan 03, 2023 12:28:47 PM com.x.Planner step0\nFINE: gone", "clock12", at(2023, 1, 3, 12, 28, 47), "debug", "com.x.Planner", "gone"),
    ("E1231 17:41:48.363319    5336 scheduler.go:48] cannot decode", "klog", at(2022, 12, 31, 17, 41, 48), "error", "scheduler.go", "cannot decode"),
    ("[2023-01-11T07:51:09.434-0500][CRT][ingest.scheduler] deadline", "bracket", at(2023, 1, 11, 12, 51, 9), "fatal", "ingest.scheduler", "deadline"),
    ("2023-01-11T15:02:15.352515Z \x1b[31mERROR\x1b[0m search::session: failed: x", "module_path", at(2023, 1, 11, 15, 2, 15), "error", "search::session", "failed: x"),
    ("<131>Jan  2 12:37:22 relay.example ledger-wal[24988]: failed: INFO", "syslog_bsd", at(2023, 1, 2, 12, 37, 22), "error", "ledger-wal", "failed: INFO"),
    ('<165>1 2023-01-03T02:00:00.5+05:30 h app 1 ID1 [m@1 note="level=error"] fine', "syslog_ietf", at(2023, 1, 2, 20, 30), "info", "app", "fine"),
    ('ts=2023-01-02T00:11:12.106Z level=error component=edge.router msg="a \\"b\\" level=debug c" shard=26', "pairs", at(2023, 1, 2, 0, 11, 12), "error", "edge.router", 'a \\"b\\" level=debug c'),
    ('msg="lvl=fatal inside" shard=1 logger=l lvl=info t=2023-01-02T00:00:01Z', "pairs", at(2023, 1, 2, 0, 0, 1), "info", "l", "lvl=fatal inside"),
    ('{"level":50,"time":1673249324700,"pid":1,"hostname":"h","name":"search.cache","msg":"x"}', "json_pino", 1673249324, "error", "search.cache", "x"),
    ('{ "ts": 1672618411.985, "level": "dpanic", "logger": "a.b", "msg": "m" }', "json_zap", 1672618411, "fatal", "a.b", "m"),
    ('{"msg":"has \\"level\\":\\"error\\" in it","logger":"a","ts":"2023-01-02T00:00:51.489083Z","level":"info"}', "json_zap", at(2023, 1, 2, 0, 0, 51), "info", "a", 'has \\"level\\":\\"error\\" in it'),
    ('{"level":"error","ts":"2023-01-02T05:24:59.111542Z","logger":"r","caller":"router/ro', "json_zap", at(2023, 1, 2, 5, 24, 59), "error", "r", None),
    ('{\n  "timestamp": "2023-01-02T00:07:10.8Z",\n  "severity_number": 17,\n  "body": "b",\n  "scope": {\n    "name": "s.t"\n  }\n}', "json_otel", at(2023, 1, 2, 0, 7, 10), "error", "s.t", "b"),
    ('203.0.113.68 - - [02/Jan/2023:18:00:52 +0200] "GET /error HTTP/1.1" 500 1 "-" "x"', "access", at(2023, 1, 2, 16, 0, 52), None, None, "GET /error HTTP/1.1"),
    ("error counter router=45 total=873733", "plain", None, None, None, "error counter router=45 total=873733"),
    ("", "plain", None, None, None, ""),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0], NEAR, "clash", 1) for i, c in enumerate(CASES)], "id long, raw string, near timestamp, entry string, record_no int")
    return {r["id"]: r for r in logs.parse_texts(df, "raw", "near").where("record_no = 0").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_layouts(parsed, i):
    raw, layout, epoch, level, component, message = CASES[i]
    e = parsed[i]["entry"]
    got = (e["layout"], None if e["entry_us"] is None else e["entry_us"] // 1_000_000, e["level"], e["component"])
    assert got == (layout, epoch, level, component)
    if message is not None:
        assert e["message"] == message


def test_severe_entries_and_nulls(spark):
    df = spark.createDataFrame([(i, c[0], NEAR) for i, c in enumerate(CASES)] + [(99, None, NEAR), (98, CASES[6][0], None)], "id long, raw string, near timestamp")
    got = {r["id"]: (r["entry_epoch"], r["component"]) for r in logs.severe_entries(df, "raw", "near", ["id"]).collect()}
    want = {i: (c[2], c[4]) for i, c in enumerate(CASES) if c[3] in ("error", "fatal")}
    assert got == want | {98: (None, "scheduler.go")}
    assert logs.parse_texts(df.where("id = 99"), "raw", "near").collect()[0]["entry"]["layout"] is None
    assert logs.severe_entries(df.where("false"), "raw", "near", ["id"]).collect() == []


def test_very_long_message(spark):
    long = '{"level":"error","ts":1.5,"logger":"x","msg":"' + "a\\n" * 200_000 + '"}'
    got = logs.severe_entries(spark.createDataFrame([(1, long, NEAR)], "id long, raw string, near timestamp"), "raw", "near", ["id"]).collect()
    assert [(r["entry_epoch"], r["component"]) for r in got] == [(1, "x")]


def test_records_within_a_text(spark):
    text = "2023-01-03 09:46:36,923 - a - INFO - one\n  more\r\n2023-01-03 09:46:37,000 - b - ERROR - two\nTraceback"
    rows = logs.parse_texts(spark.createDataFrame([(text, NEAR)], "raw string, near timestamp"), "raw", "near").orderBy("record_no").collect()
    assert [(r["entry"]["component"], r["entry"]["message"], r["entry"]["n_lines"]) for r in rows] == [("a", "one\n  more", 2), ("b", "two\nTraceback", 2)]


def test_every_severe_record_of_a_text_counts(spark):
    text = "2023-01-03 09:46:36,923 - a - INFO - one\n  more\n2023-01-03 09:46:37,000 - b - ERROR - two\nTraceback\n2023-01-03 09:46:39,000 - c - CRITICAL - three"
    got = logs.severe_entries(spark.createDataFrame([(5, text, NEAR, "x", 3)], "id long, raw string, near timestamp, entry string, record_no int"), "raw", "near", ["id", "entry"])
    assert sorted(tuple(r) for r in got.collect()) == [(5, "x", at(2023, 1, 3, 9, 46, 37), "b"), (5, "x", at(2023, 1, 3, 9, 46, 39), "c")]
    many = "\n".join(f"2023-01-03 09:46:37,000 - b{i} - ERROR - two\n  cont" for i in range(20_000))
    assert logs.severe_entries(spark.createDataFrame([(5, many, NEAR)], "id long, raw string, near timestamp"), "raw", "near", ["id"]).count() == 20_000


def test_assembling_lines_of_files(spark):
    starts = {0, 3, 4, 11, 12, 25}
    rows = [("f", i, f"2023-01-03 09:46:{i:02d},0 x" if i in starts else f"  cont {i}", "extra") for i in range(30)]
    rows += [("g", i, f"tail {i}", "extra") for i in range(7)] + [(None, 1, None, "extra")]
    df = spark.createDataFrame(rows, "path string, n long, line string, record_no string")
    got = {(r["file"], r["record_no"], r["part"]): (r["first_line"], r["n_lines"], r["text"]) for r in logs.assemble_records(df, "path", "n", "line", block=4, longest=5).collect()}
    edges = sorted(starts) + [30]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        lines = [r[2] for r in rows[a:b]]
        parts = [got["f", k + 1, p] for p in range((b - a + 4) // 5)]
        assert parts[0][0] == a and sum(p[1] for p in parts) == b - a and "\n".join(p[2] for p in parts) == "\n".join(lines)
    assert got["g", 0, 0][1] + got["g", 0, 1][1] == 7 and got[None, 0, 0] == (1, 1, "")


def test_levels_cover_every_rank():
    assert set(logs.LEVELS) == {1, 2, 3, 4, 5, 6} and len({w for ws in logs.LEVELS.values() for w in ws}) == sum(map(len, logs.LEVELS.values()))


def test_over_long_record_stays_one(spark):
    lines = ["2024-03-01 10:00:00,123 - app - ERROR - first", *[f"  at frame {i}" for i in range(24)], "2024-03-01 10:00:01,000 - app - INFO - next"]
    df = spark.createDataFrame([("f", i, x, "2024-03-02") for i, x in enumerate(lines)], "file string, no int, line string, at string").withColumn("at", F.col("at").cast("timestamp"))
    whole = logs.parse_lines(df, "file", "no", "line", "at").orderBy("record_no").collect()
    parts = logs.parse_lines(df, "file", "no", "line", "at", longest=10).orderBy("record_no", "part").collect()
    assert [(r["record_no"], r["part"], r["n_lines"]) for r in parts] == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 1)]
    head = lambda r: (r["entry"]["layout"], r["entry"]["entry_us"], r["entry"]["level"], r["entry"]["component"])
    assert head(whole[0])[0] != "plain" and {head(r) for r in parts[:3]} == {head(whole[0])} and head(parts[3]) == head(whole[1])
    assert "\n".join(r["entry"]["message"] for r in parts[:3]) == whole[0]["entry"]["message"]


def test_lines_give_the_entries_of_texts(spark):
    from tidelog.queries import problems

    d = "/root/testdata/sf0.001"
    names = ["visibility_seq", "layout", "entry_us", "level", "component", "message", "n_lines"]
    key = lambda df: sorted((tuple(r) for r in df.where("layout is not null").select(*names).collect()), key=repr)
    assert key(problems.QUERIES["p6_lines"](spark, d)) == key(problems.QUERIES["p6_entries"](spark, d))
