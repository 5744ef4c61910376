import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidelog.operators.late_events import PeriodStore
from tidelog.plans.errors import DataError
from tidelog.sources import readers, sinks
from tidelog.streaming import ingest



def when():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def test_json_lines(spark):
    lines = ['{"timestamp":"2024-02-03T04:05:06.5Z","level":"warn","msg":"m","traceId":"t","x":1}', '{"ts":1700000000.25,"severity":"ERROR","body":"b"}', '{"time":1700000000250}', "not json", "  ", None, '{"broken":']
    rows = readers.decode_json_lines(spark.createDataFrame([(x,) for x in lines], "value string"), received=when(), index="i").collect()
    assert len(rows) == 5
    assert [(r["_time"].isoformat(), r["time_source"], r["severity"], r["message"]) for r in rows[:3]] == [("2024-02-03T04:05:06.500000", 1, 4, "m"), ("2023-11-14T22:13:20.250000", 1, 5, "b"), ("2023-11-14T22:13:20.250000", 1, 0, None)]
    assert [(r["_raw"], r["fields"], r["time_source"]) for r in rows[3:]] == [("not json", None, 2), ('{"broken":', None, 2)] and rows[0]["trace_id"] == "t"


def test_envelopes(spark):
    bodies = ['{"event":"one"}\n{"event":{"a":{"b":["}",1]}},"time":"1700000000","host":"h","fields":{"k":1}}', '{"event":""}', '[1]', '{"event":"x"},{"event":"y"}', '{"event":"q\\"uote}"}']
    got = readers.split_envelopes(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), "body", received=when(), defaults={"index": "d", "source": "s"}).orderBy("id", "event_no").collect()
    ok = [r for r in got if r["problem"] is None]
    assert [(r["id"], r["_raw"], r["message"], r["host"], r["source"], r["index"], r["sourcetype"]) for r in ok] == [
        (0, "one", "one", "hec", "s", "d", "httpevent"), (0, '{"a":{"b":["}",1]}}', None, "h", "s", "d", "httpevent"), (4, 'q"uote}', 'q"uote}', "hec", "s", "d", "httpevent")]
    assert {r["id"] for r in got if r["problem"]} == {1, 2, 3}


def test_envelopes_of_any_depth(spark):
    nest = lambda n, start, end: '{"event":' + start * n + '"}]"' + end * n + "}"
    kinds = {"objects": ('{"a":', "}"), "arrays": ("[", "]"), "both": ('{"a":[', "]}")}
    bodies = [(f"{k}-{n}", '{"event":"before"}' + nest(n, *kinds[k]) + '\n{"event":"after"}') for k in kinds for n in (4, 8, 40, 200)]
    long = '{"event":"' + "{x" * 100_000 + '"}' + '{"event":{"l":[' + ",".join(['{"k":[1]}'] * 20_000) + "]}}"
    got = readers.split_envelopes(spark.createDataFrame([*bodies, ("long", long)], "id string, body string"), "body", received=when(), defaults={"index": "i"}).collect()
    for k, body in bodies:
        kind, n = k.split("-")
        inner = nest(int(n), *kinds[kind])[len('{"event":') : -1]
        assert [r["_raw"] for r in sorted(got, key=lambda r: r["event_no"]) if r["id"] == k and r["problem"] is None] == ["before", inner, "after"], k
    assert [r["problem"] for r in got if r["id"] == "long"] == [None, None]


def test_envelope_errors_refuse_the_request(spark):
    good = '{"event":"g"}'
    bodies = {
        good + '{"event":"x","host":null}': "invalid host", good + '{"event":"x","source":""}': "invalid source", good + '{"event":"x","sourcetype":5}': "invalid sourcetype", good + '{"event":"x","x":1}': "unknown member",
        good + '{"event":null}': "blank event", good + '{"host":"h"}': "blank event", good + '{"event":"x"} 7': "invalid body", good + '{"event":"x"': "invalid body", good + '{"event":"x","event":"y"}': "invalid body", good + "]" + good: "invalid body",
    }
    for index, more in (({"index": "i"}, {}), ({}, {good + '{"event":"x","index":"i"}': "no index"})):
        texts = list(bodies | more)
        got = readers.split_envelopes(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), "body", received=when(), defaults=index).collect()
        for i, text in enumerate(texts):
            problems = [r["problem"] for r in got if r["id"] == i]
            assert None not in problems and (bodies | more)[text] in problems, text


def test_packed_bodies(spark, tmp_path):
    import gzip

    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'{"event":"one"}\n{"event":"two"}'))
    (tmp_path / "b.json").write_text('{"event":"three"}')
    got = readers.read_envelopes(spark, str(tmp_path), received=when(), defaults={"index": "i"})
    assert sorted((r["_raw"], r["problem"]) for r in got.collect()) == [("one", None), ("three", None), ("two", None)]


def test_dropping_an_index_touches_no_other(spark, tmp_path):
    df = spark.createDataFrame([(x, i, dt.datetime(2024, 1, 31)) for i, x in enumerate(("a", "b", "a=/c", None))], "index string, n int, _time timestamp")
    store = sinks.EventStore(spark, str(tmp_path / "s"))
    store.append(df, "one")
    store.append(df, "two")
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    assert store.drop_index("a=/c") == 2 and store.drop_index("a=/c") == 0
    assert sorted(r["n"] for r in store.read().collect()) == [0, 0, 1, 1, 3, 3]
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    assert len(left) < len(kept) and left.items() <= kept.items()


def test_raw_bodies_and_redaction(spark):
    df = spark.createDataFrame([(1, "a\r\n\nb\rc\n"), (2, None)], "id int, body string")
    assert [(r["id"], r["_raw"]) for r in readers.split_raw_body(df, "body").orderBy("line_no").collect()] == [(1, "a"), (1, "b\rc")]
    text = 'Authorization: Bearer abc\n{"password": "p\\"q", "n": 1, "token":5} api_key=zzz&x=1 tokens=3'
    assert readers.redact(spark.createDataFrame([(text,)], "t string"), ["t"]).first()[0] == 'Authorization: [REDACTED]\n{"password": "[REDACTED]", "n": 1, "token":"[REDACTED]"} api_key=[REDACTED]&x=1 tokens=3'


def test_lookup_files(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text('k,v\na,"x, ""y""\nz"\nb,\n')
    assert [tuple(r) for r in readers.read_lookup_csv(spark, str(p)).collect()] == [("a", 'x, "y"\nz'), ("b", "")]
    p.write_text("k,K\na,b\n")
    with pytest.raises(DataError):
        readers.read_lookup_csv(spark, str(p)).collect()


def test_generator_is_repeatable(spark):
    for shape in ("flat", "nested", "cardinality", "raw"):
        a = readers.generate_events(spark, 200, seed=3, shape=shape, partitions=2)
        b = readers.generate_events(spark, 200, seed=3, shape=shape, partitions=5)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        assert a.exceptAll(readers.generate_events(spark, 200, seed=4, shape=shape)).count() > 0


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2**60, 0.5, b"\x00\xff", ["a", None], dt.datetime(2024, 1, 1), True), (None,) * 7], "t string, n long, d double, b binary, l array<string>, at timestamp, f boolean")
    assert [tuple(r) for r in sinks.csv_cells(df).collect()] == [("'=1+1", str(2**60), "0.5", "AP8=", '["a",null]', "2024-01-01T00:00:00.000000Z", "true"), ("",) * 7]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    rows = [json.loads(r[0]) for r in sinks.json_rows(df, typed_integers=True).collect()]
    assert rows[0]["n"] == {"type": "sint64", "value": str(2**60)} and rows[0]["b"] == "AP8=" and set(rows[1].values()) == {None}
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 2


def test_store_is_idempotent_and_forgets(spark, tmp_path):
    df = spark.createDataFrame([("a", "t", dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 1)), ("b", "t", dt.datetime(2024, 2, 1), None)], "index string, tenant_id string, _time timestamp, expires_at timestamp")
    store = sinks.EventStore(spark, str(tmp_path / "s"))
    for _ in range(2):
        store.append(df, "batch-1")
    store.append(df, "batch-2")
    before = F.lit("2024-01-15 00:00:00").cast("timestamp")
    assert store.read(before).count() == 4 and store.read().count() == 2
    left = store.delete_index("b", str(tmp_path / "d")).read(before).collect()
    assert len(left) == 2 and {r["index"] for r in left} == {"a"}
    assert store.purge(str(tmp_path / "p"), before).read(before).count() == 4
    with pytest.raises(ValueError):
        store.append(df, "../x")


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.log").write_text('{"ts":1700000000,"msg":"a"}\n{"ts":1700000001,"msg":"b"}\n')
    store = sinks.EventStore(spark, str(tmp_path / "store"))
    run = lambda: ingest.into_batches(readers.decode_json_lines(ingest.tail_lines(spark, str(src))), str(tmp_path / "cp"), store.append).awaitTermination(120)
    run()
    assert store.read().count() == 2
    (src / "2.log").write_text('{"ts":1700000002,"msg":"c"}\n')
    run()
    assert sorted(r["message"] for r in store.read().collect()) == ["a", "b", "c"]


def test_stream_into_periods(spark, tmp_path):
    rows = [("t", str(i % 4), "a", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 30)) for i in range(8)]
    df = spark.createDataFrame(rows, "tenant string, id string, idx string, at timestamp, arrived timestamp")
    df.write.parquet(str(tmp_path / "in"))
    store = PeriodStore(spark, str(tmp_path / "p"), ["idx"], event_time="at", arrival="arrived", identity=["tenant", "id"])
    ingest.into_periods(ingest.tail_table(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "cp"), store).awaitTermination(120)
    assert [(r["n_accepted"], r["n_late"]) for r in store.read().collect()] == [(4, 0)]
    kept = ingest.once_within(ingest.tail_table(spark, str(tmp_path / "in"), df.schema), ["tenant", "id"], "arrived")
    q = kept.writeStream.format("memory").queryName("kept").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert spark.table("kept").count() == 4
