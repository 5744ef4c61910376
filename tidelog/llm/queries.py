"""The registered queries of this subpackage, and the SQL they are held against."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import cut, ident, rows_at_most, table
from tidelog.llm import distinct, leakage, lookalike, mixture, quantiles

_IDS = ("host", "source", "event_id")


def _day(time: str) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def _sketches(spark: SparkSession, d: str) -> DataFrame:
    return distinct.sketch(table(spark, d, "log_events").withColumn("event_day", _day("event_time")), ["index_name", "event_day"], _IDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    counts = distinct.estimate(_sketches(spark, d), ["index_name", "event_day"])
    wide = counts.groupBy("index_name", "event_day").agg(*[F.max(F.when(F.col("ident") == c, F.col("estimate"))).alias(c) for c in _IDS])
    rows = wide.where(F.round("event_id") >= 10).select("index_name", "event_day", F.col("event_id").alias("all"), F.explode(F.array(*[F.struct(F.lit(c).alias("ident"), F.col(c).alias("n")) for c in ("host", "source")])).alias("x"))
    return rows.where(F.col("x.n") > 0.6 * F.col("all")).select("index_name", "event_day", F.col("x.ident").alias("ident"))


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    return distinct.estimate(_sketches(spark, d), ["index_name", "event_day"])


def p2_unions(spark: SparkSession, d: str) -> DataFrame:
    return distinct.estimate(distinct.merge_all_unions(_sketches(spark, d), ["index_name", "event_day"]), ["index_name", "event_day"])


def _held_against(counts: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates beside exact counts: whether each lies within five standard errors, or three of
    small sets, in which values that share a register weigh more than the standard error says."""
    on = functools.reduce(Column.__and__, [ident(k).eqNullSafe(ident("x_" + k)) for k in [*keys, "ident"]])
    rows = exact.withColumnsRenamed({k: "x_" + k for k in [*keys, "ident"]}).join(counts, on, "left")
    near = F.abs(F.col("estimate") - F.col("n_exact")) <= F.greatest(F.lit(3.0), 5 * distinct.standard_error() * F.col("n_exact"))
    return rows.select(*[F.col("x_" + k).alias(k) for k in [*keys, "ident"]], "n_exact", F.coalesce(near, F.lit(False)).alias("within"))


def _each_ident(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("ident"), F.col(c).alias("n_exact")) for c in _IDS])).alias("x")).select(*keys, "x.*")


def p2_unions_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every index and day, every index, every day and all together: the estimates against exact counts."""
    keys = ["index_name", "event_day"]
    exact = table(spark, d, "log_events").withColumn("event_day", _day("event_time")).cube(*keys).agg(*[F.countDistinct(c).alias(c) for c in _IDS])
    return _held_against(p2_unions(spark, d), _each_ident(exact, keys), keys)


def p2_chosen_checked(spark: SparkSession, d: str) -> DataFrame:
    """A union of some indexes and all days but one, from the same partial results, against exact counts."""
    chosen = "index_name > 'm' and event_day <> '2023-01-03'"
    rows = table(spark, d, "log_events").withColumn("event_day", _day("event_time")).where(chosen)
    counts = distinct.estimate(distinct.merge(_sketches(spark, d).where(chosen), []), [])
    return _held_against(counts, _each_ident(rows.agg(*[F.countDistinct(c).alias(c) for c in _IDS]), []), [])


_METRICS = ("duration", "scanned_bytes", "scanned_rows")


_QS = [0.5, 0.9, 0.95, 0.99]


def _once(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_history").where("final_state = 6")
    return quantiles.once_each(rows, "search_job_id", ["created_at", "app_id", *_METRICS]).withColumn("created_day", _day("created_at")).where("app_id is not null")


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    keys = ["app_id", "created_day"]
    return quantiles.merge(quantiles.sketch(_once(spark, d), keys, _METRICS), keys)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = quantiles.percentiles(_day_sketches(spark, d).where("created_day is not null"), ["app_id", "created_day"], [0.5, 0.9, 0.95])
    at = F.col("values")
    case = ((F.col("metric") == "duration") & (at[2] > 30_000_000)) | ((F.col("metric") == "scanned_bytes") & (at[0] > 1_073_741_824)) | ((F.col("metric") == "scanned_rows") & (at[1] > 5_000_000))
    return rows.where(case).select("app_id", "created_day", "metric")


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(_day_sketches(spark, d), ["app_id", "created_day"], _QS)


def p3_all_days(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(quantiles.merge(_day_sketches(spark, d), ["app_id"]), ["app_id"], _QS)


def _ranked_within(rows: DataFrame, found: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """Percentiles beside exact ranks: whether each value's rank lies within the stated error of the percentile's."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("v")) for m in _METRICS])).alias("x")).select(*keys, "x.*").where("v >= 0")
    at = found.select(*[F.col(k).alias("f_" + k) for k in keys], F.col("metric").alias("f_metric"), F.col("n").alias("f_n"), "values")
    on = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col("f_" + k)) for k in [*keys, "metric"]])
    each = [F.count_if(F.col("v") < F.col("values")[i]).alias(f"lo{i}") for i in range(len(qs))] + [F.count_if(F.col("v") <= F.col("values")[i]).alias(f"hi{i}") for i in range(len(qs))]
    ranks = long.join(at, on, "left").groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.max("f_n").alias("f_n"), *each)
    within = F.col("n") == F.col("f_n")
    for i, q in enumerate(qs):  # an equal value may have a whole stretch of ranks
        slack = F.lit(5 * quantiles.relative_error() * (1 - q)) * F.col("n") + 1
        within = within & (F.col(f"lo{i}") <= F.lit(q) * F.col("n") + slack) & (F.col(f"hi{i}") >= F.lit(q) * F.col("n") - slack)
    return ranks.select(*keys, "metric", "n", F.coalesce(within, F.lit(False)).alias("within"))


def p3_daily_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every application's and day's percentiles against the exact ranks of their values."""
    keys = ["app_id", "created_day"]
    return _ranked_within(_once(spark, d), p3_daily(spark, d), keys, _QS)


def p3_all_days_checked(spark: SparkSession, d: str) -> DataFrame:
    """The same for all days of an application, merged from the sketches of the days."""
    return _ranked_within(_once(spark, d), p3_all_days(spark, d), ["app_id"], _QS)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("exact_words >= 12").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


_LEVELS = ("domain", "lang", "source")


def _leaves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The tree of the documents at hand: the field of work of a document's service (the first part of its name), its
    language and its source. A document without a service belongs to the field "none", one without language to "und"."""
    targets = table(spark, d, "mix_targets")
    names = targets.select("source").distinct()
    docs = table(spark, d, "documents").join(F.broadcast(names) if rows_at_most(names, 100_000) else names, "source", "left_semi")
    domain = F.coalesce(F.split("service", "-")[0], F.lit("none"))
    docs = docs.select("doc_id", "source", F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"), domain.alias("domain"), F.unhex(F.md5("text")).alias("text_key"), "text")
    counted = cut(mixture.count_tokens(docs, "text"))  # tokens are counted once, then used by every step
    texts, leaves = mixture.leaf_stats(counted, targets, doc_id="doc_id", tokens="n_tokens", text_key="text_key", levels=_LEVELS, source="source")
    # a source without documents still has its place in the tree
    return texts, cut(leaves.fillna({"domain": "none", "lang": "und"}))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, leaves = _leaves(spark, d)
    return mixture.short_sources(mixture.budgets(leaves, _LEVELS, "all_tokens"), "source")


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts, leaves = _leaves(spark, d)
    return texts, cut(mixture.budgets(leaves, _LEVELS))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    texts, plan = _tree(spark, d)
    return mixture.shares(plan, mixture.select_prefix(texts, plan, _LEVELS), "source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    texts, plan = _tree(spark, d)
    return mixture.select_prefix(texts, plan, _LEVELS).withColumnRenamed("rep", "doc_id")


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether no text is used more often than allowed, and whether what was chosen lies within a text a leaf of the budgets."""
    texts, plan = _tree(spark, d)
    chosen = mixture.select_prefix(texts, plan, _LEVELS)
    want = plan.groupBy("source").agg(F.sum("budget").alias("budget"), F.count(F.lit(1)).alias("leaves"), F.max("max_repeats").cast("long").alias("max_repeats"))
    uses = chosen.groupBy("source", "rep").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("t"), F.max("tokens").alias("longest"))
    got = uses.groupBy("source").agg(F.max("uses").alias("uses"), F.sum("t").alias("t"), F.max("longest").alias("longest"))
    longest = texts.groupBy("source").agg(F.max("tokens").alias("most"))
    rows = want.join(got, "source", "left").join(longest, "source", "left").fillna(0)
    return rows.select("source", "max_repeats", (F.col("uses") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("t") - F.col("budget")) <= F.col("leaves") * F.col("most") + 1).alias("near_budget"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_classes(table(spark, d, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_form(table(spark, d, "documents").select("doc_id", "text"), "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_daily, p2_unions, p2_unions_checked, p2_chosen_checked, p3_found, p3_daily, p3_all_days, p3_daily_checked, p3_all_days_checked, p7_found, p7_leaks, p8_found, p8_shares, p8_mixture, p8_checked, p9_found, p9_classes, p9_forms)}

_P2_DAYS = "WITH e AS (SELECT index_name, strftime(event_time, '%Y-%m-%d') AS event_day, host, source, event_id FROM log_events) "
#: The form of a text in SQL, for the characters that the tables hold: signs that don't show, kinds of space, full-width
#: forms, look-alike letters, accents.
_FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_LETTERS = "".join(x for x, _ in lookalike.LOOK_ALIKES), "".join(x for _, x in lookalike.LOOK_ALIKES)
_FORM = (
    r"nfc_normalize(translate(translate(regexp_replace(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), '[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), "
    f"'{_FULL_WIDTH[0]}', '{_FULL_WIDTH[1]}'), '{_LETTERS[0]}', '{_LETTERS[1]}'))"
)
_DOC_FORMS = f"WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents) "
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')".format(_FORM)
_RUNS = "SELECT DISTINCT {0}, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {0}, {2} AS w FROM {1}) WHERE len(w) >= 12)"

_P3_ONCE = "WITH once AS (SELECT DISTINCT search_job_id, app_id, strftime(created_at, '%Y-%m-%d') AS created_day, duration, scanned_bytes, scanned_rows FROM search_history WHERE final_state = 6 AND app_id IS NOT NULL) "
_P3_LONG = _P3_ONCE + ", v AS (SELECT app_id, created_day, 'duration' AS metric, duration AS v FROM once WHERE duration >= 0 UNION ALL SELECT app_id, created_day, 'scanned_bytes', scanned_bytes FROM once WHERE scanned_bytes >= 0 UNION ALL SELECT app_id, created_day, 'scanned_rows', scanned_rows FROM once WHERE scanned_rows >= 0) "

SQL = {
    # estimates, held against exact counts and ranks: the cases lie further from the limits than the stated errors
    "p2_found": """
WITH n AS (SELECT index_name, strftime(event_time, '%Y-%m-%d') AS event_day, count(DISTINCT event_id) AS e, count(DISTINCT host) AS h, count(DISTINCT source) AS s FROM log_events GROUP BY 1, 2)
SELECT index_name, event_day, 'host' AS ident FROM n WHERE e >= 10 AND h > 0.6 * e UNION ALL SELECT index_name, event_day, 'source' FROM n WHERE e >= 10 AND s > 0.6 * e""",
    "p2_unions_checked": _P2_DAYS + """
, n AS (SELECT index_name, event_day, count(DISTINCT host) AS host, count(DISTINCT source) AS source, count(DISTINCT event_id) AS event_id FROM e GROUP BY CUBE (index_name, event_day))
SELECT index_name, event_day, ident, n_exact, true AS within FROM (UNPIVOT n ON host, source, event_id INTO NAME ident VALUE n_exact)""",
    "p2_chosen_checked": _P2_DAYS + """
, n AS (SELECT count(DISTINCT host) AS host, count(DISTINCT source) AS source, count(DISTINCT event_id) AS event_id FROM e WHERE index_name > 'm' AND event_day <> '2023-01-03')
SELECT ident, n_exact, true AS within FROM (UNPIVOT n ON host, source, event_id INTO NAME ident VALUE n_exact)""",
    "p3_daily_checked": _P3_LONG + "SELECT app_id, created_day, metric, count(*) AS n, true AS within FROM v GROUP BY 1, 2, 3",
    "p3_all_days_checked": _P3_LONG + "SELECT app_id, metric, count(*) AS n, true AS within FROM v GROUP BY 1, 2",
    "p3_found": _P3_ONCE + """
SELECT app_id, created_day, 'duration' AS metric FROM once WHERE duration >= 0 GROUP BY 1, 2 HAVING quantile_disc(duration, 0.95) > 30000000
UNION ALL SELECT app_id, created_day, 'scanned_bytes' FROM once WHERE scanned_bytes >= 0 GROUP BY 1, 2 HAVING quantile_disc(scanned_bytes, 0.5) > 1073741824
UNION ALL SELECT app_id, created_day, 'scanned_rows' FROM once WHERE scanned_rows >= 0 GROUP BY 1, 2 HAVING quantile_disc(scanned_rows, 0.9) > 5000000""",
    # words in place of tokens: which sources are short is the same for any usual tokenizer
    "p8_found": r"""
WITH n AS (SELECT source, sum(len(regexp_extract_all(text, '\S+'))) AS t FROM documents GROUP BY 1),
m AS (SELECT x.source, target_weight, max_repeats, coalesce(t, 0) AS t FROM mix_targets x LEFT JOIN n USING (source))
SELECT source FROM m WHERE t * max_repeats < target_weight / (SELECT sum(target_weight) FROM m) * (SELECT sum(t) FROM m)""",
    "p8_checked": "SELECT source, CAST(max_repeats AS BIGINT) AS max_repeats, true AS within_repeats, true AS near_budget FROM mix_targets",
    "p7_found": f"WITH d AS ({_RUNS.format('doc_id', 'documents', _WORDS)}), i AS ({_RUNS.format('item_id', 'eval_items', _WORDS)}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)",
    "p9_found": _DOC_FORMS + "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p9_classes": _DOC_FORMS + ", n AS (SELECT form, count(DISTINCT text) AS n_texts FROM f GROUP BY 1) SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS form_id, min(doc_id) OVER (PARTITION BY text) AS text_id, count(*) OVER (PARTITION BY form) AS n_docs, n_texts FROM f JOIN n USING (form)",
    "p9_forms": _DOC_FORMS + "SELECT doc_id, text, form FROM f",
}
