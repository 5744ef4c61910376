"""The registered queries of the general training-data operators, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import div, micros, scratch, table
from tidelog.operators import exactly_once as once
from tidelog.operators import late_events as late
from tidelog.operators import log_lines as logs
from tidelog.operators import skewed_keys as skew

IDENTITY = ("tenant_id", "event_id")


def _partials(spark: SparkSession, d: str) -> DataFrame:
    return late.period_partials(table(spark, d, "log_events"), ["index_name"], event_time="event_time", arrival="index_time", identity=IDENTITY)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    sums = late.combine_partials(_partials(spark, d), ["index_name"])
    return sums.where("n_late >= 1 and 4 * n_late >= n_accepted").select("index_name", "period_start")


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    return late.combine_partials(_partials(spark, d), ["index_name"]).drop("n_batches")


def p1_partials(spark: SparkSession, d: str) -> DataFrame:
    return _partials(spark, d)


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """The periods again, from a store into which the deliveries are merged day by day of arrival."""
    rows = table(spark, d, "log_events").withColumn("arrived", F.date_format("index_time", "yyyy-MM-dd"))
    store = late.PeriodStore(spark, scratch(spark, "periods"), ["index_name"], event_time="event_time", arrival="index_time", identity=IDENTITY)
    for day in sorted(r[0] for r in rows.select("arrived").distinct().where("arrived is not null").collect()):  # one row a day
        store.merge(rows.where(F.col("arrived") == day), day)
    return store.read().drop("n_batches")


_P1_ROWS = """
WITH first AS (
  SELECT tenant_id, event_id, arg_min(index_name, index_time) AS index_name, arg_min(event_time, index_time) AS event_time, min(index_time) AS index_time
  FROM log_events GROUP BY 1, 2),
placed AS (
  SELECT index_name, date_trunc('hour', event_time) AS h, index_time FROM first),
marked AS (
  SELECT index_name, CAST(epoch(h) AS BIGINT) AS period_start, CAST(epoch(date_trunc('hour', index_time)) AS BIGINT) AS batch_start,
    index_time <= h + INTERVAL 25 HOUR AS ok, index_time <= h + INTERVAL 25 HOUR AND index_time > h + INTERVAL 65 MINUTE AS late
  FROM placed)
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return once.dropped_rows(table(spark, d, "log_events"), IDENTITY, "collected_at", "visibility_seq")


def p4_events(spark: SparkSession, d: str) -> DataFrame:
    kept = once.exactly_once(table(spark, d, "log_events"), IDENTITY, "collected_at", "visibility_seq")
    return kept.select("tenant_id", "event_id", "visibility_seq", "index_name", F.length("raw").cast("long").alias("raw_chars"), F.unix_micros(F.col("collected_at").cast("timestamp")).alias("collected_us"))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    return once.copy_counts(table(spark, d, "log_events"), IDENTITY)


_P4_RANKED = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_id ORDER BY collected_at ASC NULLS LAST, visibility_seq) AS rn FROM log_events)
"""

KEY_FIELDS = ("index_name", "host", "sourcetype")


def _lagged(spark: SparkSession, d: str) -> DataFrame:
    lag = micros("index_time") - micros("event_time")
    return table(spark, d, "log_events").select(*KEY_FIELDS, div(lag - F.pmod(lag, F.lit(1000)), F.lit(1000)).alias("lag_ms"))


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return skew.keyed_selection(_lagged(spark, d), KEY_FIELDS, "lag_ms", [0.5, 0.95])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "log_events"), KEY_FIELDS, 0.05).select("key_field", "key_value")


def p5_key_profile(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d).select(
        "key_field", "key_value", "n", F.col("total").cast("long").alias("lag_ms_total"), F.col("lo").alias("lag_ms_min"), F.col("hi").alias("lag_ms_max"),
        F.col("quantiles")[0].alias("lag_ms_p50"), F.col("quantiles")[1].alias("lag_ms_p95"),
    )


_P5_LONG = """
WITH long AS (
  SELECT 'index_name' AS key_field, index_name AS key_value, CAST(floor((epoch_us(index_time) - epoch_us(event_time)) / 1000) AS BIGINT) AS v FROM log_events
  UNION ALL SELECT 'host', host, CAST(floor((epoch_us(index_time) - epoch_us(event_time)) / 1000) AS BIGINT) FROM log_events
  UNION ALL SELECT 'sourcetype', sourcetype, CAST(floor((epoch_us(index_time) - epoch_us(event_time)) / 1000) AS BIGINT) FROM log_events)
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return logs.severe_entries(table(spark, d, "log_events").where("raw_encoding = 1"), "raw", "index_time", ["visibility_seq"])


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.parse_texts(table(spark, d, "log_events").where("raw_encoding = 1").select("visibility_seq", "raw", "index_time"), "raw", "index_time")
    return rows.select("visibility_seq", "record_no", "entry.layout", "entry.entry_us", "entry.level", "entry.component", "entry.message", "entry.n_lines")


def p6_lines(spark: SparkSession, d: str) -> DataFrame:
    """The entries again, from raws as files of lines."""
    raws = table(spark, d, "log_events").where("raw_encoding = 1").select("visibility_seq", "index_time", F.posexplode(F.split("raw", "\n", -1)).alias("line_no", "line"))
    rows = logs.parse_lines(raws, "visibility_seq", "line_no", "line", "index_time")
    return rows.select(F.col("file").alias("visibility_seq"), "record_no", "part", "entry.layout", "entry.entry_us", "entry.level", "entry.component", "entry.message", "entry.n_lines")


def p6_lines_checked(spark: SparkSession, d: str) -> DataFrame:
    """The entries of raws and of their lines beside each other: how many texts there are, and how many differ."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        fields = ["layout", "entry_us", "level", "component", "message"]
        return df.groupBy("visibility_seq").agg(F.sum(F.xxhash64(*fields).cast("decimal(20,0)")).alias(name))

    both = digest(p6_entries(spark, d), "a").join(digest(p6_lines(spark, d), "b"), "visibility_seq", "full")
    return both.agg(F.count(F.lit(1)).alias("texts"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))


_P6 = r"""
WITH r AS (SELECT visibility_seq, index_time, replace(raw, chr(13), '') AS raw FROM log_events WHERE raw_encoding = 1),
k AS (SELECT *, CASE
  WHEN raw LIKE '{%' AND (raw LIKE '%"severity_text"%' OR raw LIKE '%"severity_number"%' OR raw LIKE '%"body"%') THEN 'otel'
  WHEN raw LIKE '{%' AND regexp_matches(raw, '"level"\s*:\s*\d') THEN 'pino' WHEN raw LIKE '{%' THEN 'zap'
  WHEN regexp_matches(raw, '^<\d+>\d ') THEN 'ietf' WHEN regexp_matches(raw, '^<\d+>[A-Z]') THEN 'bsd' WHEN regexp_matches(raw, '^[A-Z]\d{4} \d') THEN 'klog'
  WHEN regexp_matches(raw, '^[A-Z][a-z]{2} \d\d, ') THEN 'jul' WHEN regexp_matches(raw, '^\[\d{4}-') THEN 'bracket' WHEN regexp_matches(raw, '^\d{4}-\S+ \S+ - ') THEN 'dash'
  WHEN regexp_matches(raw, '^\d{4}-\S+ \S+ [A-Z]+ +\[') THEN 'after' WHEN regexp_matches(raw, '^\d{4}-\S+ \S+ \[') THEN 'before' WHEN regexp_matches(raw, '^\d{4}-\d\d-\d\dT') THEN 'path'
  WHEN regexp_matches(raw, '^[A-Z]+:[^:\s]+:\d{4}-') THEN 'first' WHEN regexp_matches(raw, '^[a-z]+=') THEN 'pairs' END AS lay FROM r),
q AS (SELECT visibility_seq, index_time, lay, CASE lay WHEN 'pairs' THEN regexp_replace(raw, '"(?:[^"\\]|\\.)*("|$)', '""', 'g') WHEN 'path' THEN regexp_replace(raw, chr(27) || '\[[0-9;]*m', '', 'g') ELSE raw END AS raw FROM k),
f AS (SELECT *, CASE lay
  WHEN 'otel' THEN coalesce(nullif(regexp_extract(raw, '"severity_number"\s*:\s*(\d+)', 1), ''), regexp_extract(raw, '"severity_text"\s*:\s*"([^"]+)"', 1))
  WHEN 'pino' THEN regexp_extract(raw, '"level"\s*:\s*(\d+)', 1) WHEN 'zap' THEN regexp_extract(raw, '[{,]\s*"level"\s*:\s*"([^"]+)"', 1) WHEN 'ietf' THEN regexp_extract(raw, '^<(\d+)>', 1) WHEN 'bsd' THEN regexp_extract(raw, '^<(\d+)>', 1)
  WHEN 'klog' THEN raw[1] WHEN 'jul' THEN regexp_extract(raw, '^[^\n]*\n([A-Z]+):', 1) WHEN 'bracket' THEN regexp_extract(raw, '^\[[^\]]+\]\[([^\]]+)', 1) WHEN 'dash' THEN regexp_extract(raw, '^\S+ \S+ - \S+ - ([A-Z]+) - ', 1)
  WHEN 'after' THEN regexp_extract(raw, '^\S+ \S+ ([A-Z]+)', 1) WHEN 'before' THEN regexp_extract(raw, '^\S+ \S+ \[[^\]]*\] ([A-Z]+)', 1) WHEN 'path' THEN regexp_extract(raw, '^\S+ +([A-Z]+)', 1)
  WHEN 'first' THEN regexp_extract(raw, '^([A-Z]+):', 1) WHEN 'pairs' THEN regexp_extract(raw, '(?:^| )(?:level|lvl|severity)=(\w+)', 1) END AS lv, CASE lay
  WHEN 'otel' THEN regexp_extract(raw, '"timestamp"\s*:\s*"([^"]+)"', 1) WHEN 'pino' THEN regexp_extract(raw, '"time"\s*:\s*(\d+)', 1) WHEN 'zap' THEN regexp_extract(raw, '[{,]\s*"ts"\s*:\s*"?([^",}\s]+)', 1)
  WHEN 'ietf' THEN regexp_extract(raw, '^\S+ (\S+)', 1) WHEN 'bsd' THEN regexp_extract(raw, '>(\w+ +\d+ \S+)', 1) WHEN 'klog' THEN raw[2:14] WHEN 'jul' THEN regexp_extract(raw, '^(.*? [AP]M) ', 1) WHEN 'bracket' THEN regexp_extract(raw, '^\[([^\]]+)', 1)
  WHEN 'path' THEN regexp_extract(raw, '^(\S+)', 1) WHEN 'first' THEN regexp_extract(raw, '(\d{4}-\S+ [\d:]+)', 1) WHEN 'pairs' THEN regexp_extract(raw, '(?:^| )(?:ts|time|t)=(\S+)', 1) ELSE raw[1:19] END AS ts, CASE lay
  WHEN 'otel' THEN regexp_extract(raw, '"scope"\s*:\s*\{\s*"name"\s*:\s*"([^"]+)"', 1) WHEN 'pino' THEN regexp_extract(raw, '"name"\s*:\s*"([^"]+)"', 1) WHEN 'zap' THEN regexp_extract(raw, '[{,]\s*"logger"\s*:\s*"([^"]+)"', 1)
  WHEN 'ietf' THEN regexp_extract(raw, '^\S+ \S+ \S+ (\S+)', 1) WHEN 'bsd' THEN regexp_extract(raw, '^\S+ +\d+ \S+ \S+ ([^\s:\[]+)', 1) WHEN 'klog' THEN regexp_extract(raw, '^\S+ \S+ +\d+ ([^:\s]+):', 1) WHEN 'jul' THEN regexp_extract(raw, ' [AP]M (\S+)', 1)
  WHEN 'bracket' THEN regexp_extract(raw, '^\[[^\]]+\]\[[^\]]+\]\[([^\]]+)', 1) WHEN 'dash' THEN regexp_extract(raw, '^\S+ \S+ - (\S+) - ', 1) WHEN 'after' THEN regexp_extract(raw, '^\S+ \S+ [A-Z]+ +\[[^\]]*\] (\S+) - ', 1)
  WHEN 'before' THEN regexp_extract(raw, '^\S+ \S+ \[[^\]]*\] [A-Z]+ +(\S+): ', 1) WHEN 'path' THEN regexp_extract(raw, '^\S+ +[A-Z]+ (\S+): ', 1) WHEN 'first' THEN regexp_extract(raw, '^[A-Z]+:([^:]+):', 1)
  WHEN 'pairs' THEN regexp_extract(raw, '(?:^| )(?:component|logger)=(\S+)', 1) END AS component FROM q),
e AS (SELECT * FROM f WHERE CASE WHEN lay = 'otel' AND TRY_CAST(lv AS INT) IS NOT NULL THEN CAST(lv AS INT) >= 17 WHEN lay = 'pino' THEN TRY_CAST(lv AS INT) >= 50 WHEN lay IN ('ietf', 'bsd') THEN CAST(lv AS INT) % 8 <= 3
  ELSE lower(lv) IN ('error', 'err', 'eror', 'e', 'severe', 'fatal', 'f', 'critical', 'crit', 'crt', 'panic', 'dpanic', 'emerg', 'alert') END),
y AS (SELECT *, regexp_extract(ts, '([+-]\d\d:?\d\d)$', 1) AS off,
  list_transform([-1, 0, 1], lambda d: try_strptime(CASE lay WHEN 'bsd' THEN regexp_replace(ts, ' +', ' ', 'g') WHEN 'klog' THEN ts ELSE '' END || ' ' || CAST(year(index_time) + d AS VARCHAR), ['%m%d %H:%M:%S %Y', '%b %d %H:%M:%S %Y'])) AS ys FROM e)
SELECT visibility_seq, CASE WHEN lay = 'pino' THEN CAST(ts AS BIGINT) // 1000 WHEN lay = 'zap' AND TRY_CAST(ts AS DOUBLE) IS NOT NULL THEN CAST(floor(CAST(ts AS DOUBLE)) AS BIGINT)
  WHEN lay = 'jul' THEN CAST(epoch(strptime(ts, '%b %d, %Y %I:%M:%S %p')) AS BIGINT)
  WHEN lay IN ('bsd', 'klog') THEN CAST(epoch(list_sort(list_transform(list_filter(ys, lambda t: t IS NOT NULL), lambda t: {'d': abs(epoch(t) - epoch(index_time)), 't': t}))[1].t) AS BIGINT)
  ELSE CAST(epoch(strptime(replace(ts[1:19], 'T', ' '), '%Y-%m-%d %H:%M:%S')) AS BIGINT) - CASE WHEN off = '' THEN 0 ELSE (CASE off[1] WHEN '-' THEN -1 ELSE 1 END) * (CAST(off[2:3] AS INT) * 3600 + CAST(replace(off, ':', '')[4:5] AS INT) * 60) END END AS entry_epoch, component
FROM y
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p1_partials, p1_merged, p4_found, p4_events, p4_copies, p5_found, p5_key_profile, p6_found, p6_entries, p6_lines, p6_lines_checked)}

SQL = {
    "p1_found": _P1_ROWS + "SELECT index_name, period_start FROM marked GROUP BY 1, 2 HAVING count(*) FILTER (late) >= 1 AND 4 * count(*) FILTER (late) >= count(*) FILTER (ok)",
    "p1_periods": _P1_ROWS + "SELECT index_name, period_start, count(*) FILTER (ok) AS n_accepted, count(*) FILTER (late) AS n_late, count(*) FILTER (NOT ok) AS n_refused FROM marked GROUP BY 1, 2",
    "p1_partials": _P1_ROWS + "SELECT index_name, period_start, batch_start, count(*) FILTER (ok AND NOT late) AS n_on_time, count(*) FILTER (late) AS n_late, count(*) FILTER (NOT ok) AS n_refused FROM marked GROUP BY 1, 2, 3",
    "p1_merged": _P1_ROWS + "SELECT index_name, period_start, count(*) FILTER (ok) AS n_accepted, count(*) FILTER (late) AS n_late, count(*) FILTER (NOT ok) AS n_refused FROM marked GROUP BY 1, 2",
    "p4_found": _P4_RANKED + "SELECT visibility_seq FROM ranked WHERE rn > 1",
    "p4_events": _P4_RANKED + "SELECT tenant_id, event_id, visibility_seq, index_name, CAST(length(raw) AS BIGINT) AS raw_chars, epoch_us(collected_at) AS collected_us FROM ranked WHERE rn = 1",
    "p4_copies": "SELECT copies, count(*) AS identities FROM (SELECT count(*) AS copies FROM log_events GROUP BY tenant_id, event_id) GROUP BY 1",
    "p5_found": _P5_LONG + "SELECT key_field, key_value FROM long WHERE key_value <> '' GROUP BY 1, 2 HAVING count(*) >= 0.05 * (SELECT count(*) FROM log_events)",
    "p6_found": _P6,
    "p6_lines_checked": "SELECT count(*) AS texts, 0 AS different FROM log_events WHERE raw_encoding = 1",
    "p5_key_profile": _P5_LONG + "SELECT key_field, key_value, count(*) AS n, CAST(sum(v) AS BIGINT) AS lag_ms_total, min(v) AS lag_ms_min, max(v) AS lag_ms_max, quantile_disc(v, 0.5) AS lag_ms_p50, quantile_disc(v, 0.95) AS lag_ms_p95 FROM long GROUP BY 1, 2",
}
