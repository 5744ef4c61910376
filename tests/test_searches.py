"""Searches over small events, with their results written down."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.plans import analysis
from tidelog.plans.engine import Session
from tidelog.plans.errors import DataError, SearchError
from tidelog.plans.knowledge import Knowledge, Selector
from tidelog.sources.catalog import Binding, Catalog

T0 = dt.datetime(2024, 1, 1)
ROWS = [  # id, seconds, host, n, raw, tags, j
    (1, 0, "h1", 1.5, "alpha Beta", "red,,blue", '{"a":{"b":1},"l":[{"m":"x"},{"m":null},{"n":1},{"m":"y"}]}'), (2, 10, "h1", None, "beta-gamma", None, '{"a":{"b":"t"}}'),
    (3, 20, None, -11.5, "GAMMA_1 beta2", "green", "not json"), (4, 30, "h2", 25.0, "delta", "", '{"l":[]}'), (5, 40, "h2", 25.0, "", "a,b", None),
]


@pytest.fixture(scope="module")
def s(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=t), *rest) for i, t, *rest in ROWS], "id long, at timestamp, host string, n double, raw string, tags string, j string")
    c = Catalog()
    c.add(Binding("e", lambda _: df, time="at", keys=("id",), raw="raw"))
    session = Session(spark, c, default_index="e")
    session.add_lookup("assets", spark.createDataFrame([("h1", "web", ""), ("h9", "db", "r9")], "host string, role string, rack string"), ["host"])
    return session


def ids(s, q, **kw):
    return [r["id"] for r in s.search(q + " | table id", now=1_704_100_000.0, **kw).collect()]


def values(s, q, *names, **kw):
    rows = s.search(q, now=1_704_100_000.0, **kw).collect()
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


def test_order_terms_and_missing(s):
    assert ids(s, "index=e") == [5, 4, 3, 2, 1]
    assert ids(s, "beta") == [2, 1] and ids(s, '"beta"') == [3, 2, 1] and ids(s, "gamma") == [2] and ids(s, "*amm*") == [3, 2]
    assert ids(s, "NOT host=h1") == [5, 4, 3] and ids(s, "host!=H1") == [5, 4] and ids(s, "host=*") == [5, 4, 2, 1] and ids(s, "n>=25 OR n<0 host=h*") == [5, 4]


def test_where_is_three_valued(s):
    assert ids(s, 'index=e | where NOT host="h1"') == [5, 4]
    assert ids(s, "index=e | where n IN (25, null)") == [5, 4] and ids(s, "index=e | where n NOT IN (25, null)") == []
    assert ids(s, 'index=e | where host="H1"') == []


@pytest.mark.parametrize("expr, want", [
    ("((8+2-1)*3/9)%4", 3.0), ("1/0", None), ("5%0", None), ("-5%2", -1.0), ("5%-2", 1.0), ('"2.5"+1', 3.5), ('" 2.5 "+1', None), ("null+1", None),
    ("round(2.5)", 2.0), ("round(-2.5)", -2.0), ("round(3.5)", 4.0), ("round(2.555,2)", 2.56), ("round(17.275,2)", 17.27), ("round(15.275,2)", 15.28), ("ceil(1.2)", 2.0), ("floor(-1.2)", -2.0), ("ceil(-1.2)", -1.0),
    ('len("😀ab")', 3), ('tostring(1=1)', "True"), ('tonumber("NaN")', None), ('tonumber("1e3")', 1000.0), ('if(null=1,"a","b")', "b"), ('case(1=2,"a")', None), ('coalesce(null,"x")', "x"), ('"a" . 1 . "b"', "a1b"), ('"a" . null', None),
    ('substr("😀abcdef",1,3)', "😀ab"), ('substr("😀abcdef",0,3)', "😀a"), ('substr("😀abcdef",-2,2)', "ef"), ('substr("😀abcdef",-3)', "def"), ('substr("😀abcdef",2,0)', ""), ('substr("😀abcdef",4,-2)', "ab"), ('substr("😀abcdef",99,3)', ""), ('substr("😀abcdef",-99)', "😀abcdef"),
    ('mvcount(split("a,b",","))', 2), ("mvcount(5)", 1), ("mvcount(null)", None), ('mvjoin(mvsort(split("10,9,Z,e,é",",")),"|")', "10|9|Z|e|é"), ('mvjoin(split("abc",""),"-")', "a-b-c"), ('mvindex(split("a,b,c",","),-1)', "c"), ('mvindex(split("a,b",","),5)', None),
    ('mvjoin(mvindex(split("a,b,c,d",","),1,-2),"")', "bc"), ('mvfind(split("a,b,bc",","),"^b")', 1), ('mvfind(split("a",","),"z")', None), ('mvjoin(mvzip(split("a,b,c",","),split("1,2",",")),";")', "a,1;b,2"), ('mvjoin(mvdedup(split("b,a,b",",")),"")', "ba"),
    ('mvjoin(mvappend("x",null,split("a,b",",")),"")', "xab"), ('match("a\nb","a.b")', False), ('like("50%","50\\%")', True), ('like("ab","a_")', True), ('replace("aXbX","X","<$>")', "a<$>b<$>"), ('replace("ab","(a)(b)","\\2\\1")', "ba"),
    ('strftime(0.25,"%F %T.%3Q %z %:z %I %p %j %V %G %e")', "1970-01-01 00:00:00.250 +0000 +00:00 12 AM 001 01 1970  1"), ('strptime("2024-02-29 1:02:03.5 PM","%Y-%m-%d %I:%M:%S.%Q %p")', 1709211723.5), ('strptime("2023-02-29","%Y-%m-%d")', None),
    ('strptime("01/Mar/2024 00:00 +0200","%d/%b/%Y %H:%M %z")', 1709244000.0), ('relative_time(1709211723,"-1mon@mon")', 1704067200.0), ('relative_time(1709211723,"@w0")', 1708819200.0), ("now()", 1_704_100_000.0),
])
def test_expressions(s, expr, want):
    got = values(s, f"id=1 | eval x={expr}", "x")[0]
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_zone(spark, s):
    z = Session(spark, s.catalog, zone="America/New_York", default_index="e")
    assert values(z, 'id=1 | eval x=strftime(0,"%F %H %z")', "x") == ["1969-12-31 19 -0500"]
    assert values(z, 'id=1 | eval x=relative_time(1710082800,"@d")', "x") == [1710046800.0]  # the day the clocks go forward
    assert values(z, 'id=1 | eval x=strptime("2024-07-01 00:00:00","%Y-%m-%d %H:%M:%S")', "x") == [1719806400.0]


def test_pipeline_of_row_commands(s):
    q = "index=e | reverse | accum n AS total | strcat host \"-\" id hs | strcat allrequired=true host \"-\" id req | fillnull value=none host | addtotals fieldname=t n id | delta n AS d"
    assert values(s, q, "id", "total", "hs", "req", "host", "t", "d") == [
        (1, 1.5, "h1-1", "h1-1", "h1", 2.5, None), (2, 1.5, "h1-2", "h1-2", "h1", 2.0, None), (3, -10.0, "-3", None, "none", -8.5, None), (4, 15.0, "h2-4", "h2-4", "h2", 29.0, 36.5), (5, 40.0, "h2-5", "h2-5", "h2", 30.0, 0.0)]


def test_bins_sort_dedup_and_frequencies(s):
    assert values(s, 'index=e | eval m=if(id=2,"text",n) | bin span=10 m | sort id', "m") == ["0", "text", "-20", "20", "20"]
    assert values(s, 'index=e | eval m=case(id=1,"beta",id=2,10,id=3,"alpha",id=4,2) | sort m | table m', "m") == ["2", "10", "alpha", "beta", None]
    assert values(s, 'index=e | eval m=case(id=1,"beta",id=2,10,id=3,"alpha",id=4,2) | sort -m | table m', "m")[-1] is None
    assert ids(s, "index=e | dedup host") == [5, 2] and ids(s, "index=e | dedup 2 host n") == [5, 4, 1] and ids(s, "index=e | tail 2") == [1, 2]
    assert values(s, "index=e | top host", "host", "count", "percent") == [("h2", 2, 50.0), ("h1", 2, 50.0)]
    assert values(s, "index=e | rare limit=1 host", "host") == ["h2"]


def test_multivalues(s):
    assert values(s, 'index=e | makemv delim="," tags | mvexpand tags | table id tags', "id", "tags") == [(5, "a"), (5, "b"), (3, "green"), (2, None), (1, "red"), (1, "blue")]
    assert values(s, 'id=1 | makemv delim="," allowempty=true tags | nomv tags', "tags", flat=True) == ["red\n\nblue"]
    assert values(s, "index=e | spath input=j path=a.b output=b | sort id", "b") == ["1", "t", None, None, None]
    assert values(s, "index=e | spath input=j path=l{}.m output=m | sort id", "m") == [["x", None, "y"], None, None, None, None]
    assert values(s, "index=e | spath input=j path=l{0}.m output=m | sort id", "m")[0] == "x"


def test_rex_and_regex(s):
    assert values(s, 'index=e | eval k="old" | rex "(?<first>[a-z]+)[ -](?<k>\\w+)" | sort id', "first", "k") == [("alpha", "Beta"), ("beta", "gamma"), (None, "old"), (None, "old"), (None, "old")]
    assert ids(s, 'index=e | regex host!="1$"') == [5, 4, 3] and ids(s, 'index=e | regex "^[a-z]+$"') == [4]


def test_stats_groups_and_rules(s):
    assert values(s, "index=e | stats count, count(n) AS n, sum(n) AS t BY host", "host", "count", "n", "t") == [("h1", 2, 1, 1.5), ("h2", 2, 2, 50.0)]
    assert values(s, "index=e | stats stdev(n) AS s, var(n) AS v, rate(n) AS r BY id | where id=1", "s", "v", "r") == [(0.0, 0.0, None)]
    assert values(s, "index=e nothing | stats count, sum(n) AS t", "count", "t") == [(0, None)]
    assert values(s, 'index=e | stats first(id) AS f, last(id) AS l, earliest(n) AS e, latest_time(n) AS lt, list(host) AS h', "f", "l", "e", "lt", "h") == [(5, 1, 1.5, 1704067240.0, ["h2", "h2", "h1", "h1"])]
    assert values(s, 'index=e | sort n | stats first(id) AS f, last(id) AS l', "f", "l") == [(3, 2)]
    assert values(s, 'index=e | eval w=split(tags,",") | stats count(w) AS c, dc(w) AS d, values(w) AS v', "c", "d", "v") == [(7, 6, ["", "a", "b", "blue", "green", "red"])]
    assert values(s, "index=e | stats sparkline(count, 20s) AS s", "s") == [["##__SPARKLINE__##", "2", "2", "1"]]
    assert values(s, "index=e | eval c=100*id | stats rate(c) AS r", "r") == [10.0]
    with pytest.raises(SearchError):
        s.search("index=e | stats sum(zz*)")


def test_eventstats_and_streamstats(s):
    assert values(s, "index=e | eventstats count AS c BY host | sort id", "c") == [2, 2, None, 2, 2]
    assert values(s, "index=e | reverse | streamstats current=f sum(n) AS s, count AS c", "s", "c") == [(None, 0), (1.5, 1), (1.5, 2), (-10.0, 3), (15.0, 4)]
    assert values(s, "index=e | reverse | streamstats window=2 max(n) AS m", "m") == [1.5, 1.5, -11.5, 25.0, 25.0]
    assert values(s, "index=e | stats count BY id | streamstats sum(id) AS s", "s") == [1, 3, 6, 10, 15]


def test_charts(s):
    got = s.search("index=e | timechart span=20s count BY host", "2024-01-01T00:00:00Z", "2024-01-01T00:01:20Z", now=0.0 + 1_704_100_000)
    assert got.columns == ["_time", "h1", "h2", "NULL"] and [tuple(r)[1:] for r in got.collect()] == [(2, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 0)]
    assert values(s, "index=e | timechart span=20s avg(n) AS a", "a") == [1.5, 6.75, 25.0]
    assert s.search("index=e nothing | timechart span=1h count").collect() == []
    many = "index=e | eval k=split(\"a,b,c,d,e,f,g,h,i,j,k,l,_m\",\",\") | mvexpand k | eval v=if(k=\"_m\",100,if(k=\"k\" OR k=\"l\",1,10)) | chart sum(v) OVER id BY k"
    df = s.search(many)
    assert df.columns == ["id", "VALUE__m", "a", "b", "c", "d", "e", "f", "g", "h", "i", "OTHER"] and df.collect()[0]["OTHER"] == 12.0
    assert values(s, "index=e | eval v=if(id<4,1,49), k=id | chart avg(v) OVER host BY id", "5") == [None, 49.0]


def test_other_is_weighted_by_members(s):
    q = 'index=e | eval k=split("a1,a2,a3,a4,a5,a6,a7,a8,a9,b0,x,y",","), r=1 | mvexpand k | eval v=case(k="x",id,k="y",id*2,true,1000), keep=if(k="y" AND id>2,0,1) | where keep=1 | chart avg(v) OVER r BY k'
    assert values(s, q, "OTHER") == [pytest.approx((1 + 2 + 3 + 4 + 5 + 2 + 4) / 7)]


def test_lookups(s):
    assert values(s, "index=e | lookup assets host OUTPUT role | sort id", "role") == ["web", "web", None, None, None]
    assert values(s, 'index=e | eval role=if(id=1,"own",null) | lookup assets host OUTPUTNEW role, rack AS r | sort id', "role", "r")[:2] == [("own", ""), ("web", "")]
    assert values(s, 'index=e | eval role="old" | lookup assets host OUTPUT role | sort id', "role") == ["web", "web", "old", "old", "old"]
    with pytest.raises(DataError):
        s.add_lookup("twice", s.spark.createDataFrame([("a", "b"), ("a", "c")], "k string, v string"), ["k"])
    with pytest.raises(SearchError):
        s.search("index=e | lookup nope host OUTPUT role")


def test_knowledge_stages_and_scopes(spark, s):
    k = Session(spark, s.catalog, default_index="e")
    k.lookups = s.lookups
    k.add_knowledge(
        Knowledge("extract", "w", {"pattern": r"(?<first>\w+)\W(?<second>\w+)"}), Knowledge("alias", "h", {"source": "host", "target": "box"}), Knowledge("calc", "c", {"target": "up", "expression": "upper(first) . \"/\" . box"}),
        Knowledge("calc", "d", {"target": "sib", "expression": "coalesce(up, \"none\")"}), Knowledge("lookup", "l", {"table": "assets", "keys": (("host", "box"),), "outputs": (("role", "role"),)}),
        Knowledge("alias", "n", {"source": "id", "target": "only"}, Selector(host=("h?",))), Knowledge("calc", "gone", {"target": "x", "expression": "1"}, Selector(index=("other*",))),
    )
    assert values(k, "role=web | sort id", "id", "up", "sib", "only") == [(1, "ALPHA/h1", "none", "1"), (2, "BETA/h1", "none", "2")]
    assert "x" not in k.search("index=e").columns


def test_cutoffs_and_addinfo(s):
    assert ids(s, "index=e", earliest="2024-01-01T00:00:10Z", latest="2024-01-01T00:00:30Z") == [3, 2]
    assert values(s, "id=3 | addinfo", "info_min_time", "info_max_time", "info_sid", earliest="2024-01-01T00:00:10Z", latest="2024-01-01T00:00:30Z", sid="q7") == [(1704067210.0, 1704067230.0, "q7")]


def test_analyses(s):
    t = analysis.timeline(s, "index=e", "2024-01-01T00:00:05Z", "2024-01-01T00:01:00Z", slots=10).orderBy("slot_start").collect()
    assert [(r["slot_start"] - 1704067200, r["n"], r["is_partial"]) for r in t] == [(0, 0, True), (10, 1, False), (20, 1, False), (30, 1, False), (40, 1, False), (50, 0, False)]
    cat = {r["field"]: (r["kind"], r["n_present"], r["n_null"]) for r in analysis.field_catalog(s, "index=e").collect()}
    assert cat["host"] == ("string", 4, 1) and cat["n"] == ("number", 4, 1)
    assert [tuple(r) for r in analysis.field_summary(s, "index=e", "host").collect()] == [("h1", 2, 50.0), ("h2", 2, 50.0)]
    with pytest.raises(SearchError):
        analysis.timeline(s, "index=e | stats count", "-1h", "now")
    assert {"kind": "command", "text": "streamstats"} in analysis.suggestions(s, "index=e | stre") and {"kind": "index", "text": "e"} in analysis.suggestions(s, "index=")
    assert "Scan" in s.explain("index=e | stats count")
    assert s.validate("index=e | stats count BY host")["result_kind"] == "statistics" and not s.validate("index=e | xx")["ok"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id"), F.timestamp_seconds(F.col("id") * 3600).alias("at"), (F.col("id") % 7).alias("k"), F.lit("x").alias("raw"), F.lit("unused").alias("wide")).write.parquet(str(tmp_path / "t"))
    c = Catalog()
    c.add(Binding("p", lambda sp: sp.read.parquet(str(tmp_path / "t")), time="at", keys=("id",), raw="raw"))
    plan = Session(spark, c).explain("index=p k=3 | stats count BY k", "0", "-1d@d", now=400_000.0)
    assert "EqualTo(k,3)" in plan and "LessThan(at" in plan and "wide" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_atomic_failure(s):
    with pytest.raises(Exception, match="more than 1000 members"):
        s.search('id=1 | eval t=replace("' + "x" * 1001 + '","x","x,") | makemv delim="," t').collect()


def test_spath_of_objects_arrays_and_nulls(s):
    assert values(s, "index=e | spath input=j path=l{1}.m output=host | sort id", "host") == [None, "h1", None, "h2", "h2"]  # an explicit null is a value
    assert values(s, "index=e | spath input=j path=l{} output=l | where id=4 | table l", "l") == [[]]
    for path in ("a", "l", "l{0}", "l{}"):
        with pytest.raises(Exception, match="object or an array"):
            s.search(f"id=1 | spath input=j path={path} output=x", now=1_704_100_000.0).collect()
    with pytest.raises(Exception, match="single values"):
        s.search("id=2 | spath input=j path=l{}.m output=host", now=1_704_100_000.0).collect()


def test_makemv_parts_at_spaces_by_default(s):
    assert values(s, "index=e | makemv raw | sort id | table raw", "raw")[:2] == [["alpha", "Beta"], ["beta-gamma"]]


def test_sparkline_takes_the_range_and_fails_beyond_its_points(s):
    kw = {"earliest": "2024-01-01T00:00:00Z", "latest": "2024-01-01T00:01:40Z"}
    assert values(s, "index=e | stats sparkline(count, 20s) AS s BY host | sort host", "s", **kw) == [["##__SPARKLINE__##", "2", "0", "0", "0", "0"], ["##__SPARKLINE__##", "0", "1", "1", "0", "0"]]
    assert [len(x) for x in values(s, "index=e | stats sparkline(count, 1s) AS s", "s", **kw)] == [101]
    assert [len(x) for x in values(s, "index=e | stats sparkline(count) AS s", "s", earliest="2024-01-01T00:00:00Z", latest="2024-01-01T00:01:41Z")] == [22]
    with pytest.raises(DataError, match="101 points"):
        s.search("index=e | stats sparkline(count, 1s) AS s", "2024-01-01T00:00:00Z", "2024-01-01T00:01:41Z", now=1_704_100_000.0).collect()


def test_timeline_slots_begin_with_1_2_or_5(s):
    for end, slots, span in (("2024-01-01T00:01:00Z", 10, 10), ("2024-01-01T00:01:00Z", 7, 10), ("2024-01-01T00:01:00Z", 5, 20), ("2024-01-11T00:00:00Z", 50, 20_000), ("2024-01-11T00:00:00Z", 1000, 1000)):
        t = analysis.timeline(s, "index=e", "2024-01-01T00:00:00Z", end, slots=slots).collect()
        assert {r["slot_end"] - r["slot_start"] for r in t} == {span} and len(t) <= slots and sum(r["n"] for r in t) == 5


def test_values_and_mode(spark, monkeypatch):
    from tidelog.operators import grouping

    df = spark.createDataFrame([(i, T0, f"v{i % 7}", "a" if i < 20 else "b") for i in range(30)] + [(99, T0, None, "c")], "id long, at timestamp, x string, g string")
    c = Catalog()
    c.add(Binding("t", lambda _: df, time="at", keys=("id",)))
    q = Session(spark, c, default_index="t")
    assert values(q, "index=t | stats values(x) AS v, mode(x) AS m BY g | sort g", "v", "m") == [([f"v{i}" for i in range(7)], "v0"), ([f"v{i}" for i in range(7)], "v0"), ([], None)]
    monkeypatch.setattr(grouping, "VALUES_ENTRIES", 6)
    with pytest.raises(Exception, match="more than 6 entries"):
        q.search("index=t | stats values(x) AS v BY g").collect()


def test_catalog_and_summary_fail_rather_than_cut(spark, s, monkeypatch):
    df = spark.createDataFrame([(1, T0, '{"a":1,"b":null,"c":{"x":1}}'), (2, T0, '{"a":"t"}'), (3, T0, "no json"), (4, T0, None)], "id long, at timestamp, j string")
    c = Catalog()
    c.add(Binding("t", lambda _: df, time="at", keys=("id",), json="j"))
    q = Session(spark, c, default_index="t")
    got = {r["field"]: tuple(r)[2:] for r in analysis.field_catalog(q, "index=t").collect()}
    assert got["a"] == ("number,string", 4, 2, 0, 2) and got["b"] == ("", 4, 0, 1, 3) and got["c"] == ("object", 4, 1, 0, 3) and got["j"] == ("string", 4, 3, 1, 0)
    monkeypatch.setattr(analysis, "CATALOG_FIELDS", 7)
    with pytest.raises(DataError):
        analysis.field_catalog(q, "index=t")
    monkeypatch.setattr(analysis, "SUMMARY_DIFFERENT", 2)
    with pytest.raises(DataError):
        analysis.field_summary(q, "index=t", "id")
    with pytest.raises(SearchError):
        analysis.field_summary(q, "index=t", "id", values=101)


def test_sorted_events_are_numbered_in_ranges(s):
    plan = s.explain("index=e | sort 0 n | accum id AS t | delta n AS d | streamstats window=2 sum(n) AS w")
    assert "Exchange SinglePartition" not in plan.replace("BroadcastExchange", "")
    assert values(s, "index=e | sort 0 n, -id | accum id AS t | delta id AS d | streamstats count AS c | table id t d c", "id", "t", "d", "c") == [(3, 3.0, None, 1), (1, 4.0, -2.0, 2), (5, 9.0, 4.0, 3), (4, 13.0, -1.0, 4), (2, 15.0, -2.0, 5)]


def test_pages_of_kept_results(s, tmp_path):
    from tidelog.plans.paging import Retained

    kept = Retained.keep(s, str(tmp_path / "r"), b"secret", "index=e | sort 0 n, -id", now=1_704_100_000.0)
    seen, cursor = [], None
    for _ in range(4):
        rows, cursor = kept.page(2, cursor)
        seen.append([r["id"] for r in rows.collect()])
    assert seen == [[3, 1], [5, 4], [2], []] and kept.columns[:2] == ["id", "at"]
    for bad in ("", "x", cursor[:-4] + "AAAA", Retained(s.spark, str(tmp_path / "r"), b"other").cursor(2)):
        with pytest.raises(DataError):
            kept.page(2, bad)
    with pytest.raises(DataError):
        kept.page(0)


def test_ceilings_are_an_option(spark, s, monkeypatch):
    from tidelog.operators import grouping, multivalue

    strict = Session(spark, s.catalog, default_index="e", ceilings=True)
    monkeypatch.setattr(grouping, "DISTINCT", 3)
    monkeypatch.setattr(grouping, "LIST_BYTES", 10)
    monkeypatch.setattr(multivalue, "EXPANDED", 4)
    for q in ("stats dc(id) AS d", "stats values(raw) AS v", "stats list(raw) AS l", 'makemv delim="," tags | mvexpand tags'):
        with pytest.raises(Exception, match="more than"):
            strict.search(f"index=e | {q}", now=1_704_100_000.0).collect()
        assert s.search(f"index=e | {q}", now=1_704_100_000.0).collect()
    assert strict.search("index=e | stats dc(host) AS d, values(host) AS v", now=1_704_100_000.0).collect()[0]["d"] == 2


def test_json_extraction_of_containers(s):
    for strict in (False, True):
        k = Session(s.spark, s.catalog, default_index="e")
        k.add_knowledge(Knowledge("json", "a", {"path": "a", "output": "a", "strict": strict}))
        df = s.spark.createDataFrame([(1, T0, '{"a":{"b":1}}'), (2, T0, '{"a":5}'), (3, T0, "no")], "id long, at timestamp, raw string")
        c = Catalog()
        c.add(Binding("e", lambda _, df=df: df, time="at", keys=("id",), raw="raw"))
        k.catalog = c
        if strict:
            with pytest.raises(Exception, match="object or an array"):
                k.search("index=e | table a").collect()
        else:
            assert sorted(values(k, "index=e | table a", "a"), key=repr) == ["5", None, None]


def test_exact_percentiles_beyond_the_buffer(s, monkeypatch):
    from tidelog.operators import grouping

    q = "index=e | stats exactperc50(n) AS a, exactperc99(id) AS b, count AS c BY host | sort host"
    first = values(s, q, "host", "a", "b", "c")
    monkeypatch.setattr(grouping, "SMALL_ROWS", 0)
    assert values(s, q, "host", "a", "b", "c") == first == [("h1", 1.5, 2.0, 2), ("h2", 25.0, 5.0, 2)]
    assert values(s, "index=e | stats exactperc50(id) AS a", "a") == [3.0]


def test_text_tests_reach_the_scan(spark, tmp_path):
    words = ["error", "ERROR", "Error", "errors", "erro", "warn", None, "", "toKen", "to\u212aen", "TOKEN", "tokem", "tokfn"]
    spark.createDataFrame([(i, T0, w) for i, w in enumerate(words)], "id long, at timestamp, w string").write.parquet(str(tmp_path / "t"))
    c = Catalog()
    c.add(Binding("t", lambda x: x.read.parquet(str(tmp_path / "t")), time="at", keys=("id",)))
    q = Session(spark, c, default_index="t")
    assert sorted(ids(q, "w=eRRor")) == [0, 1, 2] and sorted(ids(q, "w=token")) == [8, 9, 10] and sorted(ids(q, "NOT w=error")) == list(range(3, 13)) and ids(q, 'w=""') == [7]
    assert sorted(ids(q, "w=ERR*")) == [0, 1, 2, 3, 4] and sorted(ids(q, "w=to*n")) == [8, 9, 10, 12] and sorted(ids(q, "w=*")) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]
    plan = q.explain("w=error | table id")
    assert "GreaterThanOrEqual(w,ERROR)" in plan and "LessThanOrEqual(w,error)" in plan
