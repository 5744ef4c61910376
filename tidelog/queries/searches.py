"""Registered searches, one or more for every command and function, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.common import ident, scratch, table
from tidelog.plans import analysis
from tidelog.plans.engine import Session
from tidelog.plans.knowledge import Knowledge, Selector
from tidelog.plans.paging import Retained
from tidelog.sources import readers, sinks
from tidelog.sources.catalog import parquet_folder
from tidelog.streaming import ingest, tail

NOW = 1_706_745_600.0  # 2024-02-01, after the last event
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Columns that any reader compares alike: doubles to four places, times as epoch microseconds, lists as text."""
    out = []
    for f in df.schema:
        c = ident(f.name)
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.round(c.cast("double"), 4)
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|", "null")
        elif isinstance(f.dataType, T.IntegerType | T.ShortType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def session(spark: SparkSession, d: str, lookups: bool = False) -> Session:
    s = Session(spark, parquet_folder(d))
    if lookups:
        s.add_lookup("nations", table(spark, d, "nation"), ["n_nationkey"])
        s.add_lookup("hosts", table(spark, d, "host_assets"), ["host"])
    return s


def add(name: str, search: str, sql: str | None = None, earliest: str | None = None, latest: str | None = None, lookups: bool = False, **options) -> None:
    """Registers a search; without SQL it is checked by tests only. Options that are functions are taken from the tables."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        given = {k: v(spark, d) if callable(v) else v for k, v in options.items()}
        return plain(session(spark, d, lookups).search(search, earliest, latest, now=NOW, ordered=False, **given))

    run.__doc__ = search
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def _most(spark: SparkSession, d: str, c) -> int:
    return table(spark, d, "log_events").agg(c).first()[0]


E = "index=events | "
# scans and base predicates ------------------------------------------------------------------------------------------
add("flagship_error_users", "index=events event_type=error | stats count AS n, avg(value) AS m BY user_id | sort 20 -n, +user_id",
    "SELECT user_id, count(*) AS n, round(avg(value), 4) AS m FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
add("scan_two_indexes", "index=orders OR index=customer | stats count BY index", "SELECT 'orders' AS index, count(*) AS count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
add("scan_time_range", E + "stats count, sum(value) AS s BY event_type", "SELECT event_type, count(*) AS count, round(sum(value), 4) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1", "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z")
add("scan_relative_range", E + "stats count", "SELECT count(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-25' AND ts < TIMESTAMP '2024-01-31 20:00:00'", "-7d@d", "-4h")
add("scan_snapshot", "index=log_events | stats count BY index",
    "SELECT index_name AS index, count(*) AS count FROM log_events WHERE tenant_id = 'tn-harbor' AND index_time <= (SELECT max(event_time) - INTERVAL 1 HOUR FROM log_events) AND visibility_seq <= (SELECT max(visibility_seq) * 9 // 10 FROM log_events) GROUP BY 1",
    tenant="tn-harbor", indexed_until=lambda spark, d: _most(spark, d, F.unix_micros(F.max("event_time").cast("timestamp"))) / 1e6 - 3600, visible_until=lambda spark, d: _most(spark, d, F.max("visibility_seq")) * 9 // 10)
add("search_term", "index=documents ticket | table doc_id", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])ticket([^A-Za-z0-9_]|$)')")
add("search_phrase", 'index=documents "Open A ticket" | table doc_id', "SELECT doc_id FROM documents WHERE contains(lower(text), 'open a ticket')")
add("search_field_compare", "index=events value>=50 event_type!=view user_id<100 | table event_id value", "SELECT event_id, value FROM events WHERE value >= 50 AND event_type <> 'view' AND user_id < 100")
add("search_wildcard", "index=events event_type=*UR*se | table event_id", "SELECT event_id FROM events WHERE event_type ILIKE '%ur%se'")
add("search_precedence", "index=events event_type=click OR event_type=VIEW value>20 NOT (user_id=3 OR user_id=4) | stats count", "SELECT count(*) AS count FROM events WHERE (event_type = 'click' OR event_type = 'view') AND value > 20 AND NOT (user_id = 3 OR user_id = 4)")
add("search_missing_field", "index=events NOT nope=1 | stats count", "SELECT count(*) AS count FROM events")
add("search_not_equal_missing", "index=events nope!=1 | stats count", "SELECT 0::BIGINT AS count")
add("search_present", "index=log_events service=* | stats count", "SELECT count(*) AS count FROM log_events WHERE service IS NOT NULL")
add("search_json_path", "index=events k>90 | stats count", "SELECT count(*) AS count FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")
add("search_later_stage", E + "eval big=if(value>100,\"yes\",\"no\") | search big=YES event_type=e* | stats count", "SELECT count(*) AS count FROM events WHERE value > 100 AND event_type LIKE 'e%'")
# where --------------------------------------------------------------------------------------------------------------
add("where_compare_fields", "index=lineitem | where l_tax >= l_discount AND NOT l_quantity = 10 | stats count", "SELECT count(*) AS count FROM lineitem WHERE l_tax >= l_discount AND l_quantity <> 10")
add("where_in", E + 'where event_type IN ("click", "view") AND user_id NOT IN (1, 2, 3) | stats count', "SELECT count(*) AS count FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3)")
add("where_in_null", E + "where user_id NOT IN (1, nope) | stats count", "SELECT 0::BIGINT AS count")
add("where_boolean_functions", "index=log_events | where isnull(service) OR match(service, \"-api$\") OR like(host, \"edge%\") | stats count", "SELECT count(*) AS count FROM log_events WHERE service IS NULL OR regexp_matches(service, '-api$') OR host LIKE 'edge%'")
add("where_numeric_text", E + "where k = 25.0 | stats count", "SELECT count(*) AS count FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 25")
# eval ---------------------------------------------------------------------------------------------------------------
add("eval_arithmetic", E + "eval a=value*2+user_id/4-1, b=user_id%7, c=-value, d=value/0, e=k+1 | table event_id a b c d e",
    "SELECT event_id, round(value * 2 + user_id / 4.0 - 1, 4) AS a, CAST(user_id % 7 AS DOUBLE) AS b, round(-value, 4) AS c, CAST(NULL AS DOUBLE) AS d, CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS e FROM events")
add("eval_left_to_right", E + "eval a=user_id+1, a=a*2, b=a . \"x\" | table event_id a b", "SELECT event_id, CAST((user_id + 1) * 2 AS DOUBLE) AS a, CAST((user_id + 1) * 2 AS VARCHAR) || 'x' AS b FROM events")
add("eval_if_case", E + 'eval s=if(value>50, "big", event_type), c=case(user_id<10, "low", user_id<100, "mid") | table event_id s c',
    "SELECT event_id, CASE WHEN value > 50 THEN 'big' ELSE event_type END AS s, CASE WHEN user_id < 10 THEN 'low' WHEN user_id < 100 THEN 'mid' END AS c FROM events")
add("eval_coalesce_null", "index=log_events | eval s=coalesce(service, level, \"none\"), n=isnull(level), p=isnotnull(service) | stats count BY s n p",
    "SELECT coalesce(service, level, 'none') AS s, level IS NULL AS n, service IS NOT NULL AS p, count(*) AS count FROM log_events GROUP BY 1, 2, 3")
add("eval_text", E + 'eval l=lower(upper(event_type)), u=upper(event_type), n=len(event_type), r=replace(event_type, "([aeiou])", "<\\1>"), c="id-" . event_id . "/" . user_id | table event_id l u n r c',
    r"SELECT event_id, event_type AS l, upper(event_type) AS u, length(event_type) AS n, regexp_replace(event_type, '([aeiou])', '<\1>', 'g') AS r, 'id-' || event_id || '/' || user_id AS c FROM events")
add("eval_substr", E + "eval a=substr(event_type,2,3), b=substr(event_type,0,3), c=substr(event_type,-2), d=substr(event_type,4,-2), e=substr(event_type,99), f=substr(event_type,-99) | table event_id a b c d e f",
    "SELECT event_id, event_type[2:4] AS a, event_type[1:2] AS b, event_type[-2:] AS c, event_type[2:3] AS d, '' AS e, event_type AS f FROM events")
add("eval_conversion", E + 'eval n=tonumber(k), t=tostring(user_id), b=tostring(value>50), x=tonumber("12x") | table event_id n t b x',
    "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS n, CAST(user_id AS VARCHAR) AS t, CASE WHEN value > 50 THEN 'True' ELSE 'False' END AS b, CAST(NULL AS DOUBLE) AS x FROM events")
add("eval_rounding", E + "eval a=round(value), b=round(value,1), c=ceil(value), d=floor(value), e=ceiling(value), f=round(user_id/2) | table event_id a b c d e f",
    "SELECT event_id, round_even(value, 0) AS a, round(round_even(value * 10, 0) / 10, 4) AS b, ceil(value) AS c, floor(value) AS d, ceil(value) AS e, round_even(user_id / 2.0, 0) AS f FROM events")
add("eval_now", E + "eval age=now()-_time | stats max(age) AS oldest", "SELECT round(max(1706745600 - epoch_us(ts) / 1e6), 4) AS oldest FROM events")
add("eval_strftime", E + 'eval d=strftime(_time, "%Y-%m-%d %H:%M:%S.%6Q %p %j %a %b %e|%I %y %B %A %w %z %s %F %T %%") | table event_id d',
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f %p %j %a %b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, '|%I %y %B %A %w +0000 ') || CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) || strftime(ts, ' %Y-%m-%d %H:%M:%S %%') AS d FROM events")
add("eval_strftime_more", E + 'eval d=strftime(_time, "%G-%V %g %:z %Q %3Q %9Q %N %f") | table event_id d',
    "SELECT event_id, strftime(ts, '%G-%V ') || right(strftime(ts, '%G'), 2) || ' +00:00 ' || left(strftime(ts, '%f'), 3) || ' ' || left(strftime(ts, '%f'), 3) || strftime(ts, ' %f000 %f000 %f') AS d FROM events")
add("eval_strptime", E + 'eval t=strptime(strftime(_time, "%d/%b/%Y %H:%M:%S"), "%d/%b/%Y %H:%M:%S"), bad=strptime("2024-13-01", "%Y-%m-%d") | table event_id t bad',
    "SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS bad FROM events")
add("eval_relative_time", E + 'eval d=relative_time(_time, "-1d@d"), w=relative_time(_time, "@w1"), m=relative_time(_time, "@mon+2h"), q=relative_time(_time, "-1q@q") | table event_id d w m q',
    "SELECT event_id, epoch(date_trunc('day', ts) - INTERVAL 1 DAY) AS d, epoch(date_trunc('week', ts)) AS w, epoch(date_trunc('month', ts) + INTERVAL 2 HOUR) AS m, epoch(date_trunc('quarter', ts - INTERVAL 3 MONTH)) AS q FROM events")
# multivalues --------------------------------------------------------------------------------------------------------
add("mv_split_join_count", "index=part | eval w=split(p_type, \" \"), n=mvcount(w), j=mvjoin(w, \"+\"), c=mvjoin(split(p_brand, \"\"), \".\") | table p_partkey n j c",
    "SELECT p_partkey, len(string_split(p_type, ' ')) AS n, array_to_string(string_split(p_type, ' '), '+') AS j, array_to_string(string_split(p_brand, ''), '.') AS c FROM part")
add("mv_index_range", "index=part | eval w=split(p_type . \" z y\", \" \"), a=mvindex(w, 0), z=mvindex(w, -1), r=mvjoin(mvindex(w, 1, -1), \"|\"), o=mvindex(w, 50) | table p_partkey a z r o",
    "SELECT p_partkey, string_split(p_type || ' z y', ' ')[1] AS a, 'y' AS z, array_to_string(string_split(p_type || ' z y', ' ')[2:], '|') AS r, CAST(NULL AS VARCHAR) AS o FROM part")
add("mv_sort_dedup_append", "index=part | eval w=mvappend(split(p_type, \" \"), p_brand, split(p_type, \" \")), s=mvsort(mvdedup(w)), n=mvcount(w) | table p_partkey s n",
    "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append(string_split(p_type, ' '), p_brand))), '|') AS s, 2 * len(string_split(p_type, ' ')) + 1 AS n FROM part")
add("mv_zip_find", "index=part | eval w=split(p_type . \" tail\", \" \"), z=mvzip(w, split(p_brand . \" \" . p_size, \" \"), \":\"), f=mvfind(w, \"^tail\") | table p_partkey z f",
    "SELECT p_partkey, array_to_string(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] || ':' || b[i]), '|') AS z, len(a) - 1 AS f FROM (SELECT p_partkey, string_split(p_type || ' tail', ' ') AS a, string_split(p_brand || ' ' || p_size, ' ') AS b FROM part)")
add("cmd_makemv_mvexpand", "index=part | makemv delim=\" \" p_type | mvexpand p_type | stats count BY p_type", "SELECT p_type, count(*) AS count FROM (SELECT unnest(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS p_type FROM part) GROUP BY 1")
add("cmd_mvexpand_limit", "index=part | eval w=split(p_type . \" b c\", \" \") | mvexpand w limit=2 | stats count", "SELECT 2 * count(*) AS count FROM part")
add("cmd_mvexpand_null", "index=part | eval w=if(p_size>25, split(\"a,b\", \",\"), null) | mvexpand w | stats count, count(w) AS present", "SELECT sum(CASE WHEN p_size > 25 THEN 2 ELSE 1 END)::BIGINT AS count, sum(CASE WHEN p_size > 25 THEN 2 ELSE 0 END)::BIGINT AS present FROM part")
add("cmd_nomv", "index=part | eval w=split(p_type, \" \") | nomv w | table p_partkey w", "SELECT p_partkey, array_to_string(string_split(p_type, ' '), '|') AS w FROM part")
# rows ---------------------------------------------------------------------------------------------------------------
add("cmd_regex", 'index=documents | regex _raw="[0-9]{4} [a-z]+ (hosts|rows)" | stats count', "SELECT count(*) AS count FROM documents WHERE regexp_matches(text, '[0-9]{4} [a-z]+ (hosts|rows)')")
add("cmd_regex_negated", 'index=documents | regex lang!="^e" | stats count', "SELECT count(*) AS count FROM documents WHERE lang IS NULL OR NOT regexp_matches(lang, '^e')")
add("cmd_rex", 'index=log_events | rex field=source "^/var/log/(?<app>[a-z]+)/(?<unit>[a-z]+)-(?<no>\\d+)" | stats count BY app unit no',
    r"SELECT regexp_extract(source, '^/var/log/([a-z]+)/([a-z]+)-(\d+)', 1) AS app, regexp_extract(source, '^/var/log/([a-z]+)/([a-z]+)-(\d+)', 2) AS unit, regexp_extract(source, '^/var/log/([a-z]+)/([a-z]+)-(\d+)', 3) AS no, count(*) AS count FROM log_events WHERE regexp_matches(source, '^/var/log/([a-z]+)/([a-z]+)-(\d+)') GROUP BY 1, 2, 3")
add("cmd_rex_keeps_old", E + 'eval t="old" | rex field=event_type "^(?<t>c.)" | stats count BY t', "SELECT CASE WHEN event_type LIKE 'c%' THEN left(event_type, 2) ELSE 'old' END AS t, count(*) AS count FROM events GROUP BY 1")
add("cmd_spath", E + "spath input=props path=k output=key | table event_id key", "SELECT event_id, json_extract_string(props, '$.k') AS key FROM events")
_J = 'eval j="{\\"a\\":[{\\"b\\":\\"x" . user_id . "\\"},{\\"b\\":\\"y\\"},{\\"c\\":1}],\\"d\\":{\\"e\\":[5,6]}}" | '
add("cmd_spath_wildcard", E + _J + "spath input=j path=a{}.b output=b | spath input=j path=d.e{1} output=e | spath input=j path=d.e{} output=es | table event_id b e es", "SELECT event_id, 'x' || user_id || '|y' AS b, '6' AS e, '5|6' AS es FROM events")
_N = 'eval j="{\\"a\\":[{\\"b\\":null},{\\"b\\":" . user_id . "},{\\"c\\":2},7,{\\"b\\":true}],\\"n\\":null,\\"e\\":[],\\"g\\":[{\\"u\\":[1,null]},{\\"u\\":[]},{\\"u\\":[\\"x\\"]}]}", n="old", m="old" | '
add("cmd_spath_nulls", E + _N + "spath input=j path=a{}.b output=b | spath input=j path=n output=n | spath input=j path=nope output=m | spath input=j path=e{} output=e | spath input=j path=g{}.u{} output=u | table event_id b n m e u",
    "SELECT event_id, 'null|' || user_id || '|true' AS b, CAST(NULL AS VARCHAR) AS n, 'old' AS m, '' AS e, '1|null|x' AS u FROM events")
add("cmd_fields_table", E + "fields user_id, value | table value user_id nope", "SELECT value, user_id, CAST(NULL AS VARCHAR) AS nope FROM (SELECT round(value, 4) AS value, user_id FROM events)")
add("cmd_fields_exclude", "index=region | fields - index, r_regionkey", "SELECT r_name FROM region")
add("cmd_rename", E + "rename user_id AS u, value AS \"the value\" | table event_id u \"the value\"", 'SELECT event_id, user_id AS u, round(value, 4) AS "the value" FROM events')
add("cmd_rename_missing", E + "rename nope AS value | stats count(value) AS n, count AS all", "SELECT 0::BIGINT AS n, count(*) AS all FROM events")
add("cmd_fillnull", "index=log_events | fillnull value=\"?\" level, service | stats count BY level, service", "SELECT coalesce(level, '?') AS level, coalesce(service, '?') AS service, count(*) AS count FROM log_events GROUP BY 1, 2")
add("cmd_addtotals", "index=lineitem | addtotals fieldname=t l_quantity, l_tax, l_returnflag | stats sum(t) AS s", "SELECT round(sum(l_quantity + l_tax), 4) AS s FROM lineitem")
add("cmd_strcat", "index=log_events | strcat host \":\" service hs | strcat allrequired=true level \"-\" service ls | table visibility_key hs ls | stats count BY hs", "SELECT host || ':' || coalesce(service, '') AS hs, count(*) AS count FROM log_events GROUP BY 1")
add("cmd_strcat_required", "index=log_events | eval ls=\"old\" | strcat allrequired=true level \"-\" service ls | stats count BY ls", "SELECT coalesce(level || '-' || service, 'old') AS ls, count(*) AS count FROM log_events GROUP BY 1")
add("cmd_addinfo", E + "addinfo | head 1 | table info_min_time info_max_time info_search_time info_sid", "SELECT 1704844800.0::DOUBLE AS info_min_time, 1705708800.0::DOUBLE AS info_max_time, 1706745600.0::DOUBLE AS info_search_time, 'search' AS info_sid", "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z")
add("cmd_bin_numeric", E + "eval v=value-50 | bin span=10 v AS b | bin span=7 user_id | stats count BY b user_id", "SELECT floor((value - 50) / 10) * 10 AS b, user_id - user_id % 7 AS user_id, count(*) AS count FROM events GROUP BY 1, 2")
add("cmd_bin_time", E + "bucket _time span=6h AS slot | stats count BY slot", "SELECT CAST(floor(epoch_us(ts) / 21600e6) * 21600000000 AS BIGINT) AS slot, count(*) AS count FROM events GROUP BY 1")
# order --------------------------------------------------------------------------------------------------------------
add("cmd_sort_mixed", E + "eval m=if(user_id%3=0, event_type, user_id) | sort 50 m, -value | table event_id m",
    "SELECT event_id, m FROM (SELECT event_id, value, CASE WHEN user_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS m, ts FROM events) ORDER BY TRY_CAST(m AS DOUBLE) NULLS LAST, m, value DESC, ts DESC LIMIT 50")
add("cmd_sort_nulls_last", "index=log_events | sort 2000 -level, +host | stats count BY level", "SELECT level, count(*) AS count FROM (SELECT level FROM log_events ORDER BY level DESC NULLS LAST LIMIT 2000) WHERE level IS NOT NULL GROUP BY 1")
add("cmd_head", E + "head 25 | table event_id", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
add("cmd_tail", E + "sort 0 value, event_id | tail 7 | table event_id value", "SELECT event_id, round(value, 4) AS value FROM events ORDER BY value DESC, event_id DESC LIMIT 7")
add("cmd_reverse", E + "reverse | head 9 | table event_id", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 9")
add("cmd_dedup", E + "dedup 2 event_type user_id | table event_id", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 2")
add("cmd_dedup_null", "index=log_events | dedup level | stats count", "SELECT count(DISTINCT level) AS count FROM log_events")
add("cmd_accum", E + "accum value AS total | table event_id total", "SELECT event_id, round(sum(value) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
add("cmd_delta", E + "delta value AS d p=3 | table event_id d", "SELECT event_id, round(value - lag(value, 3) OVER (ORDER BY ts DESC, event_id DESC), 4) AS d FROM events")
_W = "OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS BETWEEN {})"
add("cmd_streamstats", E + "streamstats count AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi BY event_type | table event_id n s lo hi",
    "SELECT event_id, count(*) {w} AS n, round(sum(value) {w}, 4) AS s, round(min(value) {w}, 4) AS lo, round(max(value) {w}, 4) AS hi FROM events".format(w=_W.format("UNBOUNDED PRECEDING AND CURRENT ROW")))
add("cmd_streamstats_not_current", E + "streamstats current=false count(eval(value>50)) AS n, earliest(value) AS e, latest(value) AS l | table event_id n e l",
    "SELECT event_id, count(*) FILTER (value > 50) OVER w AS n, round(last_value(value) OVER w, 4) AS e, round(first_value(value) OVER w, 4) AS l FROM events WINDOW w AS (ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
add("cmd_streamstats_window", E + "streamstats window=5 avg(value) AS a, max(user_id) AS m | table event_id a m", "SELECT event_id, round(avg(value) OVER w, 4) AS a, max(user_id) OVER w AS m FROM events WINDOW w AS (ORDER BY ts DESC, event_id DESC ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
add("cmd_streamstats_window_by", E + "streamstats current=f window=3 global=f sum(value) AS s BY event_type | table event_id s", "SELECT event_id, round(sum(value) {}, 4) AS s FROM events".format(_W.format("3 PRECEDING AND 1 PRECEDING")))
add("cmd_accum_sorted", E + "sort 0 value, event_id | accum user_id AS total | table event_id total", "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM events")
add("cmd_delta_sorted", E + "sort 0 -value, event_id | delta value AS d p=2 | table event_id d", "SELECT event_id, round(value - lag(value, 2) OVER (ORDER BY value DESC, event_id), 4) AS d FROM events")
add("cmd_streamstats_sorted", E + "sort 0 event_type, value, event_id | streamstats count AS n, max(user_id) AS m BY event_type | streamstats window=4 sum(value) AS s | table event_id n m s",
    "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY value, event_id) AS n, max(user_id) OVER (PARTITION BY event_type ORDER BY value, event_id) AS m, round(sum(value) OVER (ORDER BY event_type, value, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s FROM events")
# lookups ------------------------------------------------------------------------------------------------------------
add("cmd_lookup", "index=customer | eval key=tostring(c_nationkey) | lookup nations n_nationkey AS key OUTPUT n_name AS nation | stats count, sum(c_acctbal) AS s BY nation",
    "SELECT n_name AS nation, count(*) AS count, round(sum(c_acctbal), 4) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", lookups=True)
add("cmd_lookup_outputnew", "index=log_events | eval owner=if(severity>3, \"kept\", null) | lookup hosts host OUTPUTNEW owner_team AS owner, rack | fillnull value=\"none\" owner | stats count, count(rack) AS racks BY owner",
    "SELECT coalesce(CASE WHEN severity > 3 THEN 'kept' END, owner_team, 'none') AS owner, count(*) AS count, count(rack) AS racks FROM log_events LEFT JOIN host_assets USING (host) GROUP BY 1", lookups=True)
# stats --------------------------------------------------------------------------------------------------------------
add("agg_counts", "index=log_events | stats count, c AS c2, count(service) AS s, count(eval(severity>=5)) AS e BY index",
    "SELECT index_name AS index, count(*) AS count, count(*) AS c2, count(service) AS s, count(*) FILTER (severity >= 5) AS e FROM log_events GROUP BY 1")
add("agg_moments", "index=lineitem | stats sum(l_quantity) AS s, avg(l_tax) AS a, mean(l_tax) AS m, range(l_extendedprice) AS r, sumsq(l_discount) AS q, stdev(l_quantity) AS sd, stdevp(l_quantity) AS sp, var(l_tax) AS v, varp(l_tax) AS vp BY l_returnflag",
    "SELECT l_returnflag, round(sum(l_quantity), 4) AS s, round(avg(l_tax), 4) AS a, round(avg(l_tax), 4) AS m, round(max(l_extendedprice) - min(l_extendedprice), 4) AS r, round(sum(l_discount * l_discount), 4) AS q, round(stddev_samp(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sp, round(var_samp(l_tax), 4) AS v, round(var_pop(l_tax), 4) AS vp FROM lineitem GROUP BY 1")
add("agg_singleton_deviation", "index=region | where r_regionkey=0 | stats stdev(r_regionkey) AS s, var(r_regionkey) AS v, sum(nope) AS n", "SELECT 0.0::DOUBLE AS s, 0.0::DOUBLE AS v, CAST(NULL AS DOUBLE) AS n")
add("agg_extrema", E + "eval m=if(user_id%3=0, event_type, user_id) | stats min(m) AS lo, max(m) AS hi, min(value) AS lv, max(value) AS hv BY event_type",
    "SELECT event_type, CAST(min(CASE WHEN user_id % 3 <> 0 THEN user_id END) AS VARCHAR) AS lo, max(CASE WHEN user_id % 3 = 0 THEN event_type END) AS hi, round(min(value), 4) AS lv, round(max(value), 4) AS hv FROM events GROUP BY 1")
add("agg_exact_percentiles", "index=lineitem | stats exactperc50(l_quantity) AS a, exactperc95(l_extendedprice) AS b, exactperc1(l_tax) AS c BY l_linestatus",
    "SELECT l_linestatus, round(quantile_disc(l_quantity, 0.5), 4) AS a, round(quantile_disc(l_extendedprice, 0.95), 4) AS b, round(quantile_disc(l_tax, 0.01), 4) AS c FROM lineitem GROUP BY 1")
add("agg_percentiles", "index=lineitem | stats p95(l_quantity) AS a, perc5(l_quantity) AS b, median(l_quantity) AS c, upperperc90(l_quantity) AS d BY l_linestatus",
    "SELECT l_linestatus, round(quantile_disc(l_quantity, 0.95), 4) AS a, round(quantile_disc(l_quantity, 0.05), 4) AS b, round(quantile_disc(l_quantity, 0.5), 4) AS c, round(quantile_disc(l_quantity, 0.9), 4) AS d FROM lineitem GROUP BY 1")
add("agg_distinct", "index=log_events | stats dc(host) AS d, distinct_count(service) AS s BY index", "SELECT index_name AS index, count(DISTINCT host) AS d, count(DISTINCT service) AS s FROM log_events GROUP BY 1")
add("agg_estimated_distinct", "index=log_events | stats estdc(host) AS d, dc(host) AS x, estdc_error(host) AS e BY index | eval within=if(d>=x*0.98-1 AND d<=x*1.02+1, 1, 0), stated=if(d<1000, if(e=0, 1, 0), if(e>0 AND e<0.003, 1, 0)) | table index x within stated",
    "SELECT index_name AS index, count(DISTINCT host) AS x, 1 AS within, 1 AS stated FROM log_events GROUP BY 1")
add("agg_values_mode", "index=log_events | stats values(level) AS v, mode(sourcetype) AS m BY index",
    "SELECT index_name AS index, coalesce(array_to_string(list_sort(list(DISTINCT level) FILTER (level IS NOT NULL)), '|'), '') AS v, (SELECT x.sourcetype FROM log_events x WHERE x.index_name = y.index_name AND x.sourcetype IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, x.sourcetype LIMIT 1) AS m FROM log_events y GROUP BY index_name")
add("agg_list", E + "stats list(event_id) AS l BY user_id", "SELECT user_id, array_to_string(list(event_id ORDER BY ts DESC, event_id DESC)[1:100], '|') AS l FROM events WHERE user_id IS NOT NULL GROUP BY 1")
add("agg_first_last", E + "stats first(value) AS f, last(event_id) AS l BY event_type",
    "SELECT event_type, round(arg_max(value, ts), 4) AS f, arg_min(event_id, ts) AS l FROM events GROUP BY 1")
add("agg_first_after_sort", E + "sort 0 -value, event_id | stats first(event_id) AS f, last(event_id) AS l BY event_type", "SELECT event_type, first(event_id ORDER BY value DESC, event_id) AS f, last(event_id ORDER BY value DESC, event_id) AS l FROM events GROUP BY 1")
add("agg_chronological", E + "sort 0 value | stats earliest(event_id) AS e, latest(event_id) AS l, earliest_time(value) AS et, latest_time(value) AS lt, rate(event_id) AS r BY user_id",
    "SELECT user_id, arg_min(event_id, ts) AS e, arg_max(event_id, ts) AS l, round(epoch_us(min(ts)) / 1e6, 4) AS et, round(epoch_us(max(ts)) / 1e6, 4) AS lt, round((arg_max(event_id, ts) - arg_min(event_id, ts)) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 4) AS r FROM events GROUP BY 1")
add("agg_sparkline", E + "stats sparkline(count, 1d) AS s BY event_type",
    "WITH n AS (SELECT event_type, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS d, count(*) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-02-03' GROUP BY 1, 2), g AS (SELECT event_type, d FROM (SELECT DISTINCT event_type FROM n), (SELECT unnest(range(19732, 19756)) AS d)) SELECT event_type, '##__SPARKLINE__##|' || string_agg(CAST(coalesce(c, 0) AS VARCHAR), '|' ORDER BY d) AS s FROM g LEFT JOIN n USING (event_type, d) GROUP BY 1",
    "2024-01-10T00:00:00Z", "2024-02-03T00:00:00Z")
add("agg_eval_argument", "index=lineitem | stats sum(eval(l_extendedprice*(1-l_discount))) AS revenue, avg(eval(if(l_quantity>25, l_tax, null))) AS t BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(CASE WHEN l_quantity > 25 THEN l_tax END), 4) AS t FROM lineitem GROUP BY 1, 2")
add("agg_wildcard", "index=lineitem | fields l_quantity, l_tax, l_returnflag | fields - _time | stats avg(l_*) AS *_mean BY l_returnflag", "SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity_mean, round(avg(l_tax), 4) AS l_tax_mean FROM lineitem GROUP BY 1")
add("agg_allnum", E + "eval m=if(event_type=\"view\", event_type, value) | stats sum(m) AS s BY event_type allnum=true", "SELECT event_type, CASE WHEN event_type <> 'view' THEN round(sum(value), 4) END AS s FROM events GROUP BY 1")
add("agg_by_multivalue", "index=part | eval w=split(p_type . \" x x\", \" \") | stats count, sum(p_size) AS s BY w dedup_splitvals=true",
    "SELECT w, count(*) AS count, CAST(sum(p_size) AS DOUBLE) AS s FROM (SELECT p_size, unnest(list_distinct(string_split(p_type || ' x x', ' '))) AS w FROM part) GROUP BY 1")
add("agg_over_multivalue", "index=part | eval w=split(p_size . \",1,2\", \",\") | stats count(w) AS n, sum(w) AS s, dc(w) AS d, max(w) AS m BY p_brand",
    "SELECT p_brand, 3 * count(*) AS n, CAST(sum(p_size + 3) AS DOUBLE) AS s, len(list_distinct(list_concat(list(p_size), [1, 2]))) AS d, CAST(greatest(max(p_size), 2) AS VARCHAR) AS m FROM part GROUP BY 1")
add("agg_null_group_dropped", "index=log_events | stats count BY level, service", "SELECT level, service, count(*) AS count FROM log_events WHERE level IS NOT NULL AND service IS NOT NULL GROUP BY 1, 2")
add("cmd_top", E + "top limit=5 user_id", "SELECT user_id, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY 1 ORDER BY count DESC, CAST(user_id AS VARCHAR) DESC LIMIT 5")
add("cmd_top_two_fields", "index=log_events | top 0 level, index", "SELECT level, index_name AS index, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM log_events WHERE level IS NOT NULL GROUP BY 1, 2")
add("cmd_rare", E + "rare 3 event_type", "SELECT event_type, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY 1 ORDER BY count, event_type DESC LIMIT 3")
add("cmd_eventstats_avg", E + "eventstats avg(value) AS a BY event_type | where value > a | stats count BY event_type", "SELECT event_type, count(*) AS count FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS a FROM events) WHERE value > a GROUP BY 1")
add("cmd_eventstats_all", E + "eventstats dc(user_id) AS d | table event_id d", "SELECT event_id, (SELECT count(DISTINCT user_id) FROM events) AS d FROM events")
add("cmd_eventstats_null_group", "index=log_events | eventstats count AS n BY service | stats count, sum(n) AS s", "SELECT count(*) AS count, CAST(sum(CASE WHEN service IS NOT NULL THEN n END) AS DOUBLE) AS s FROM (SELECT service, count(*) OVER (PARTITION BY service) AS n FROM log_events)")
add("cmd_eventstats_extrema", E + "eventstats latest(value) AS l BY user_id | eventstats max(value) AS m | where value = l | table event_id l m", "SELECT event_id, round(l, 4) AS l, round((SELECT max(value) FROM events), 4) AS m FROM (SELECT event_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY ts DESC) AS l FROM events) WHERE value = l")
# charts -------------------------------------------------------------------------------------------------------------
_SLOT = "CAST(floor(epoch_us(ts) / 21600e6) * 21600000000 AS BIGINT)"
_GRID = "(SELECT unnest(range(1704844800000000, 1705708800000000, 21600000000)) AS _time)"
_IN = "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"
add("cmd_timechart", "index=events event_type=error | timechart span=6h count", f"SELECT _time, coalesce(c, 0) AS count FROM {_GRID} LEFT JOIN (SELECT {_SLOT} AS _time, count(*) AS c FROM events WHERE {_IN} AND event_type = 'error' GROUP BY 1) USING (_time)", "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z")
add("cmd_timechart_avg", E + "timechart span=6h avg(value) AS a", f"SELECT _time, a FROM {_GRID} LEFT JOIN (SELECT {_SLOT} AS _time, round(avg(value), 4) AS a FROM events WHERE {_IN} GROUP BY 1) USING (_time)", "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z")
add("cmd_timechart_split", E + "timechart span=6h sum(value) BY event_type", "SELECT _time, " + ", ".join(f"{t} AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")) + f" FROM {_GRID} LEFT JOIN (SELECT {_SLOT} AS _time, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + f" FROM events WHERE {_IN} GROUP BY 1) USING (_time)", "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z")
_TOP = "WITH top AS (SELECT index_name FROM log_events GROUP BY 1 ORDER BY count(*) DESC, index_name LIMIT 10), rows AS (SELECT *, CASE WHEN index_name IN (SELECT index_name FROM top) THEN index_name ELSE 'OTHER' END AS series FROM log_events)"
add("cmd_timechart_other", "index=log_events | timechart span=12h count BY index",
    _TOP + ", cells AS (SELECT CAST(floor(epoch_us(event_time) / 43200e6) * 43200000000 AS BIGINT) AS _time, series, count(*) AS c FROM rows GROUP BY 1, 2), grid AS (SELECT unnest(range((SELECT min(_time) FROM cells), (SELECT max(_time) + 1 FROM cells), 43200000000)) AS _time), filled AS (SELECT g._time, s.series, coalesce(c, 0) AS c FROM grid g CROSS JOIN (SELECT DISTINCT series FROM cells) s LEFT JOIN cells ON cells._time = g._time AND cells.series = s.series) FROM (PIVOT filled ON series USING first(c) GROUP BY _time)")
add("cmd_timechart_empty", "index=events event_type=nothing | timechart span=1h count", "SELECT 0::BIGINT AS _time, 0::BIGINT AS count WHERE false", "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z")
add("cmd_chart", "index=lineitem | chart avg(l_quantity) OVER l_returnflag BY l_linestatus", "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 4) AS \"F\", round(avg(l_quantity) FILTER (l_linestatus = 'O'), 4) AS \"O\" FROM lineitem GROUP BY 1")
add("cmd_chart_other", "index=log_events | eval s=severity | chart count BY s, index",
    _TOP + ", cells AS (SELECT severity AS s, series, count(*) AS c FROM rows WHERE severity IS NOT NULL GROUP BY 1, 2), filled AS (SELECT r.s, x.series, coalesce(c, 0) AS c FROM (SELECT DISTINCT s FROM cells) r CROSS JOIN (SELECT DISTINCT series FROM cells) x LEFT JOIN cells ON cells.s = r.s AND cells.series = x.series) FROM (PIVOT filled ON series USING first(c) GROUP BY s)")
add("cmd_chart_null", "index=log_events | where isnull(level) OR level=\"error\" | chart count OVER index BY level", "SELECT index_name AS index, count(*) FILTER (level = 'error') AS error, count(*) FILTER (level IS NULL) AS \"NULL\" FROM log_events WHERE level IS NULL OR level = 'error' GROUP BY 1")


# knowledge, analyses, sources and sinks -----------------------------------------------------------------------------
def register(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


@register("SELECT coalesce(environment, 'unknown') AS env, substr(host, 1, 3) AS short, count(*) AS n, count(*) FILTER (regexp_matches(raw, 'status=\\d+')) AS with_status FROM log_events LEFT JOIN host_assets USING (host) GROUP BY 1, 2")
def knowledge_stages(spark: SparkSession, d: str) -> DataFrame:
    """Extraction, alias, calculated field and automatic lookup before the base predicate."""
    s = session(spark, d, lookups=True)
    s.add_knowledge(
        Knowledge("extract", "code", {"pattern": r"status=(?<http_code>\d+)"}), Knowledge("alias", "machine", {"source": "host", "target": "machine"}),
        Knowledge("calc", "short", {"target": "short", "expression": "substr(machine, 1, 3)"}), Knowledge("lookup", "assets", {"table": "hosts", "keys": (("host", "machine"),), "outputs": (("environment", "env"),)}),
    )
    return plain(s.search('index=log_events | fillnull value="unknown" env | stats count AS n, count(http_code) AS with_status BY env short', ordered=False, now=NOW))


@register("SELECT coalesce(json_extract_string(j, '$.severity_text'), json_extract_string(j, '$.level'), 'none') AS lvl, count(*) AS n FROM (SELECT CASE WHEN json_valid(raw) AND raw LIKE '{%' THEN raw END AS j FROM log_events WHERE raw_encoding = 1) GROUP BY 1")
def knowledge_json(spark: SparkSession, d: str) -> DataFrame:
    """Values extracted from the events' own JSON text; objects and what is no JSON give none."""
    s = session(spark, d)
    s.add_knowledge(*[Knowledge("json", p, {"path": p, "output": "js_" + p}) for p in ("level", "severity_text", "scope")])
    return plain(s.search('index=log_events raw_encoding=1 | eval lvl=coalesce(js_severity_text, js_level, js_scope, "none") | stats count AS n BY lvl', ordered=False, now=NOW))


@register("SELECT event_id, round(value, 4) AS value FROM events ORDER BY value, event_id LIMIT 250 OFFSET 500")
def search_paging(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a sorted result that is kept."""
    kept = Retained.keep(session(spark, d), scratch(spark, "pages"), b"key", "index=events | sort 0 value, event_id | table event_id value", now=NOW)
    _, second = kept.page(250)
    _, third = kept.page(250, second)
    return plain(kept.page(250, third)[0])


@register("SELECT index_name AS index, count(*) FILTER (index_name LIKE 'm%') AS tagged, count(*) AS n FROM log_events GROUP BY 1")
def knowledge_selector(spark: SparkSession, d: str) -> DataFrame:
    """A calculated field that holds for some indexes only, and one that a nearer scope replaces."""
    s = session(spark, d)
    s.add_knowledge(Knowledge("calc", "tag", {"target": "tag", "expression": '"far"'}, scope="global"), Knowledge("calc", "tag", {"target": "tag", "expression": '"near"'}, Selector(index=("log_events", "m*")), scope="app"))
    return plain(s.search("index=log_events | stats count(tag) AS tagged, count AS n BY index", ordered=False, now=NOW))


@register("SELECT s AS slot_start, s + 20000 AS slot_end, coalesce(n, 0) AS n, s < 1704844800 OR s + 20000 > 1705708800 AS is_partial FROM (SELECT unnest(range(1704840000, 1705708800, 20000)) AS s) LEFT JOIN (SELECT CAST(floor(epoch_us(ts) / 20000e6) * 20000 AS BIGINT) AS s, count(*) AS n FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1) USING (s)")
def analysis_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Events per slot of a range."""
    return analysis.timeline(session(spark, d), "index=events event_type=error", "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z", slots=50, now=NOW)


@register("SELECT *, CASE WHEN kind = 'dynamic' THEN 'number' ELSE kind END AS types FROM (VALUES ('_raw', 'string'), ('_time', 'time'), ('event_id', 'number'), ('event_type', 'string'), ('index', 'string'), ('k', 'dynamic'), ('props', 'string'), ('ts', 'time'), ('user_id', 'number'), ('value', 'number')) t(field, kind), (SELECT count(*) AS n_events, count(*) AS n_present, 0 AS n_null, 0 AS n_missing FROM events)")
def analysis_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a result with their kinds and counts."""
    return analysis.field_catalog(session(spark, d), "index=events", now=NOW)


@register("SELECT service AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM log_events WHERE service IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def analysis_field_summary(spark: SparkSession, d: str) -> DataFrame:
    """A field's commonest values."""
    return plain(analysis.field_summary(session(spark, d), "index=log_events", "service", values=10, now=NOW))


@register("SELECT * FROM (VALUES ('command', 'stats'), ('command', 'strcat'), ('command', 'streamstats'), ('command', 'addtotals')) t(kind, text) WHERE text LIKE 'st%'")
def analysis_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Completions of a search being written."""
    return spark.createDataFrame([(x["kind"], x["text"]) for x in analysis.suggestions(session(spark, d), "index=events | st") if x["text"].startswith("st")], "kind string, text string")


@register("SELECT * FROM (VALUES (true, 'statistics', ''), (true, 'time-series', ''), (true, 'events', ''), (false, '', 'SPL_UNSUPPORTED_COMMAND'), (false, '', 'SPL_UNSUPPORTED_FUNCTION')) t(ok, result_kind, code)")
def analysis_validate(spark: SparkSession, d: str) -> DataFrame:
    """Predicted result kinds and diagnostics."""
    s = session(spark, d)
    rows = [s.validate(q) for q in ("index=events | stats count", "index=events | timechart span=1h count", "index=events | eval a=1", "index=events | join x", "index=events | eval a=nope(1)")]
    return spark.createDataFrame([(r["ok"], r.get("result_kind", ""), r.get("code", "")) for r in rows], "ok boolean, result_kind string, code string")


@register("SELECT * FROM (VALUES (0::BIGINT, 'scan', 'events'), (1, 'filter', 'event_type,index'), (2, 'eval', 'value'), (3, 'stats', 'b,user_id')) t(no, stage, reads)")
def analysis_inspect(spark: SparkSession, d: str) -> DataFrame:
    """The stages of a search without its literals."""
    rows = analysis.inspect(session(spark, d), 'index=events event_type="x" | eval b=value*2 | stats sum(b) BY user_id')
    return spark.createDataFrame([(i, r["stage"], ",".join(r["reads"])) for i, r in enumerate(rows)], "no long, stage string, reads string")


@register("SELECT count(*) AS matched_events, count(DISTINCT user_id) AS produced_rows, true AS has_files FROM events WHERE event_type = 'error'")
def analysis_read_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What a search reads and gives."""
    got = analysis.read_statistics(session(spark, d), "index=events event_type=error | stats count BY user_id", now=NOW)
    return spark.createDataFrame([(got["matched_events"], got["produced_rows"], got["files"] > 0 and got["bytes"] > 0)], "matched_events long, produced_rows long, has_files boolean")


@register("SELECT index_name AS index, count(*) AS events, epoch_us(min(event_time)) AS first_event, epoch_us(max(event_time)) AS last_event FROM log_events GROUP BY 1")
def source_index_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Events, first and last time per index."""
    return plain(readers.index_statistics(table(spark, d, "log_events"), "index_name", "event_time"))


@register("""
WITH r AS (SELECT visibility_seq, json_valid(raw) AND raw LIKE '{%' AS has_fields, CASE WHEN json_valid(raw) AND raw LIKE '{%' THEN raw END AS o FROM log_events WHERE raw_encoding = 1 AND trim(raw) <> '')
SELECT visibility_seq, has_fields, COALESCE(json_extract_string(o, '$.level'), json_extract_string(o, '$.severity'), json_extract_string(o, '$.severity_text')) AS level,
COALESCE(json_extract_string(o, '$.message'), json_extract_string(o, '$.msg'), json_extract_string(o, '$.body')) AS message FROM r""")
def source_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """All decoded raws as JSON lines: the canonical fields by their aliases, and whether a line holds an object."""
    lines = table(spark, d, "log_events").where("raw_encoding = 1").select("visibility_seq", "raw")
    got = readers.decode_json_lines(lines, "raw", received=F.lit("2024-01-01").cast("timestamp"))
    got = got.select("_raw", F.col("fields").isNotNull().alias("has_fields"), "level", "message").distinct()
    return lines.join(got, F.col("raw") == F.col("_raw")).select("visibility_seq", "has_fields", "level", "message")


@register("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE line <> ''")
def source_raw_body(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of raw lines, broken into events."""
    from pyspark.sql import Window

    got = readers.split_raw_body(table(spark, d, "documents").select("doc_id", "text"), "text")
    return got.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).cast("bigint").alias("n"), F.col("_raw").alias("line"))


_DEEP = '{"a":' * 30 + "[{" + '"b":1}]' + "}" * 30


@register(f"""SELECT event_id, unnest([0::BIGINT, 1, 2]) AS event_no, unnest([event_type, '{{"v":' || user_id || '}}', '{_DEEP}']) AS raw, unnest(['hec', 'h' || user_id, 'hec']) AS host, unnest([event_type, NULL, NULL]) AS message FROM events""")
def source_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of JSON envelopes one after another, one of them thirty levels deep."""
    u = F.col("user_id").cast("string")
    body = F.concat(F.lit('{"event":"'), F.col("event_type"), F.lit('"} {"time":1700000000,"host":"h'), u, F.lit('","event":{"v":'), u, F.lit('}}\n{"event":' + _DEEP + "}"))
    got = readers.split_envelopes(table(spark, d, "events").select("event_id", body.alias("body")), "body", defaults={"index": "main"})
    return got.where("problem is null").select("event_id", F.col("event_no").cast("bigint").alias("event_no"), F.col("_raw").alias("raw"), "host", "message")


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'invalid host' WHEN 1 THEN 'invalid body' WHEN 2 THEN 'unknown member' END AS problem FROM events WHERE event_id % 4 < 3
UNION ALL SELECT event_id, 'refused request' FROM events WHERE event_id % 4 IN (0, 2) UNION ALL SELECT event_id, unnest(['none', 'none']) FROM events WHERE event_id % 4 = 3""")
def source_envelope_errors(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with a null host, text between envelopes or an unknown member: each is refused as a whole."""
    n = F.col("event_id") % 4
    end = F.when(n == 0, '{"host":null,"event":"x"}').when(n == 1, '; {"event":"x"}').when(n == 2, '{"event":"x","extra":1}').otherwise('{"event":"x"}')
    got = readers.split_envelopes(table(spark, d, "events").select("event_id", F.concat(F.lit('{"event":"first"}'), end).alias("body")), "body", defaults={"index": "main"})
    return got.select("event_id", F.coalesce("problem", F.lit("none")).alias("problem"))


@register("SELECT event_id, '{\"user\":' || user_id || ',\"password\":\"[REDACTED]\"}' AS a, 'x=1 api_key=[REDACTED] y=' || event_type AS b FROM events")
def source_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Sensitive values replaced before storing."""
    u = F.col("user_id").cast("string")
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit('{"user":'), u, F.lit(',"password":"p'), u, F.lit('"}')).alias("a"), F.concat(F.lit("x=1 api_key=k"), u, F.lit(" y="), F.col("event_type")).alias("b"))
    return readers.redact(rows, ["a", "b"])


@register("""
WITH x AS (SELECT i, (i * 7921 + 104729 + 1299709) % 1000003 AS x FROM range((SELECT count(*) FROM events)) t(i)), d AS (SELECT (x * x + i) % 1000003 % 100 AS luck FROM x)
SELECT CASE WHEN luck < 3 THEN 'TRACE' WHEN luck < 20 THEN 'DEBUG' WHEN luck < 82 THEN 'INFO' WHEN luck < 93 THEN 'WARN' WHEN luck < 99 THEN 'ERROR' ELSE 'FATAL' END AS level, count(*) AS n FROM d GROUP BY 1""")
def source_generator(spark: SparkSession, d: str) -> DataFrame:
    """As many generated events as there are events, by level."""
    return readers.generate_events(spark, table(spark, d, "events").count(), shape="nested").groupBy(F.get_json_object("_raw", "$.outcome.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT index_name AS index, count(*) AS n, count(DISTINCT raw) AS texts FROM log_events WHERE raw_encoding = 1 AND raw <> '' GROUP BY 1")
def source_event_store(spark: SparkSession, d: str) -> DataFrame:
    """Decoded events appended to a store twice under one token; one index deleted by a rewrite and put back, one dropped
    and put back."""
    rows = table(spark, d, "log_events").where("raw_encoding = 1 and raw <> ''").select(F.col("index_name").alias("index"), "tenant_id", "raw", F.col("event_time").cast("timestamp").alias("_time"))
    at = scratch(spark, "store")
    store = sinks.EventStore(spark, at + "/first")
    for _ in range(2):
        store.append(rows, "batch-1")
    left = store.delete_index("main", at + "/second")
    left.append(rows.where("index = 'main' or index = 'audit'"), "batch-2")
    left.drop_index("audit")
    left.append(rows.where("index = 'audit'"), "batch-3")
    return left.read().groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw").alias("texts"))


@register("SELECT host, environment, coalesce(owner_team, '') AS owner_team, coalesce(rack, '') AS rack FROM host_assets")
def source_lookup_file(spark: SparkSession, d: str) -> DataFrame:
    """A lookup table written as a CSV export and read back as a lookup file."""
    at = scratch(spark, "lookup")
    table(spark, d, "host_assets").select("host", "environment", "owner_team", "rack").fillna("").coalesce(1).write.mode("overwrite").csv(at, header=True, quote='"', escape='"', emptyValue="")
    return readers.read_lookup_csv(spark, at)


@register("SELECT regexp_replace(line, chr(13) || '$', '') AS raw, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_replace(line, chr(13) || '$', '') <> '' GROUP BY 1")
def source_raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as files of lines and read as one event per line."""
    at = scratch(spark, "lines")
    table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")).where("value is not null").write.mode("overwrite").text(at)
    return readers.read_raw_lines(spark, at).groupBy(F.col("_raw").alias("raw")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT line AS value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def stream_tail(spark: SparkSession, d: str) -> DataFrame:
    """The documents' lines written as files, tailed, and tailed again without anything new."""
    at = scratch(spark, "tail")
    table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(at + "/in")
    for _ in range(2):
        lines = tail.tail_growing(spark, urlparse(at).path + "/in", pattern="part-*")
        lines.writeStream.format("parquet").option("path", at + "/out").option("checkpointLocation", at + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at + "/out").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT tenant_id, count(DISTINCT event_id) AS n FROM log_events GROUP BY 1")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries tailed as a stream, redeliveries dropped, the result written exactly once and read back."""
    at, source = scratch(spark, "stream"), f"{d}/log_event[s].parquet"  # a pattern may name a file as well as a folder
    kept = ingest.once_within(ingest.tail_table(spark, source, table(spark, d, "log_events").schema).select("tenant_id", "event_id", F.col("index_time").cast("timestamp").alias("index_time")), ["tenant_id", "event_id"], "index_time", "30 days")
    kept.writeStream.format("parquet").option("path", at + "/out").option("checkpointLocation", at + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at + "/out").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT CAST(visibility_seq AS VARCHAR) AS visibility_seq, coalesce(CASE WHEN regexp_matches(raw, '^[=+@\t\r\n''-]') THEN '''' || raw ELSE raw END, '') AS raw, coalesce(service, '') AS service FROM log_events")
def sink_csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows as the cells of a CSV export."""
    return sinks.csv_cells(table(spark, d, "log_events").select("visibility_seq", "raw", "service"))


@register("SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"none\":null}' AS value FROM events")
def sink_json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON lines."""
    return sinks.json_rows(table(spark, d, "events").select("event_id", "event_type", F.lit(None).cast("string").alias("none")))
