"""Events from files and request bodies: JSON lines, raw lines, envelopes, lookup files, and generated ones.

Every decoder is a projection over a DataFrame of texts, so that the same one serves batches and streams.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, div, ident
from tidelog.functions.values import NUMBER, parsed_whole
from tidelog.operators.log_lines import LEVELS
from tidelog.plans.errors import DataError

#: Names under which JSON events carry the canonical fields, in order of preference.
ALIASES = {
    "_time": ("timestamp", "ts", "time", "@timestamp"), "level": ("level", "severity", "severity_text"), "message": ("message", "msg", "body"),
    "trace_id": ("trace_id", "traceId"), "span_id": ("span_id", "spanId"),
}
#: Fields whose values are never stored.
SENSITIVE = (
    "authorization", "proxy_authorization", "cookie", "set_cookie", "password", "passwd", "secret", "token", "access_token", "refresh_token", "session_token", "auth_token", "api_key", "apikey",
    "client_secret", "private_key",
)
REDACTED = "[REDACTED]"
#: What envelopes without metadata get.
ENVELOPE_DEFAULTS = {"host": "hec", "source": "http:hec", "sourcetype": "httpevent"}


def event_time(text: Column) -> Column:
    """A time written as RFC 3339, or as epoch seconds, milli-, micro- or nanoseconds by size; null if it is neither."""
    n = F.when(text.rlike(NUMBER), text.try_cast("decimal(30,9)"))
    scale = F.when(F.abs(n) < 100_000_000_000, F.lit(1_000_000)).when(F.abs(n) < 100_000_000_000_000, F.lit(1000)).when(F.abs(n) < 100_000_000_000_000_000, F.lit(1))
    number = F.when(scale.isNotNull(), F.timestamp_micros((n * scale).cast("bigint"))).otherwise(F.timestamp_micros((n / 1000).cast("bigint")))
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))
    return F.coalesce(F.when(n.isNotNull(), number), iso)


def severity_rank(level: Column) -> Column:
    """0 for unknown, 1 trace to 6 fatal."""
    rank = F.lit(0)
    for r, words in LEVELS.items():
        rank = F.when(F.upper(level).isin(*words), F.lit(r)).otherwise(rank)
    return rank


def decode_json_lines(lines: DataFrame, line: str = "value", *, received: Column | None = None, index: str = "main", host: str = "", source: str = "", sourcetype: str = "json") -> DataFrame:
    """One event per line with a JSON object. Lines that hold none become events whose raw text is the line.

    Columns: ``_time`` (the first time among its aliases, else the receive time), ``time_source`` (1 written, 2 received),
    ``level, severity, message, trace_id, span_id, index, host, source, sourcetype, _raw, fields`` (the object's text).
    Blank lines are no events; null lines neither.
    """
    text = ident(line)
    received = F.current_timestamp() if received is None else received
    ok = F.when(F.startswith(F.ltrim(text), F.lit("{")) & parsed_whole(text).isNotNull(), text)
    get = lambda name: F.coalesce(*[F.get_json_object(ok, f"$['{a}']") for a in ALIASES[name]])
    written = event_time(get("_time"))
    return lines.where(F.trim(text) != "").select(
        F.coalesce(written, received).alias("_time"), F.when(written.isNotNull(), 1).otherwise(2).alias("time_source"), get("level").alias("level"), severity_rank(get("level")).alias("severity"),
        get("message").alias("message"), get("trace_id").alias("trace_id"), get("span_id").alias("span_id"), F.lit(index).alias("index"), F.lit(host).alias("host"), F.lit(source).alias("source"),
        F.lit(sourcetype).alias("sourcetype"), text.alias("_raw"), ok.alias("fields"),
    )


def read_json_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events of files with a JSON object per line."""
    return decode_json_lines(spark.read.text(path), **options)


def read_raw_lines(spark: SparkSession, path: str, *, index: str = "main", sourcetype: str = "text") -> DataFrame:
    """An event per line: ``_raw``, ``message``, ``source`` (the file) and metadata."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), F.input_file_name().alias("source"))
    return lines.where("value != ''").select(F.current_timestamp().alias("_time"), F.lit(2).alias("time_source"), F.col("value").alias("message"), F.lit(index).alias("index"), F.lit("").alias("host"), "source", F.lit(sourcetype).alias("sourcetype"), F.col("value").alias("_raw"))


def split_raw_body(bodies: DataFrame, body: str) -> DataFrame:
    """An event per line of a request body: split at LF, one CR before it removed, empty lines skipped."""
    kept = [c for c in bodies.columns if c != body]
    lines = bodies.select(*[ident(c) for c in kept], F.posexplode(F.split(ident(body), "\n", -1)).alias("line_no", PRIVATE + "l"))
    line = F.regexp_replace(PRIVATE + "l", r"\r$", "")
    return lines.where(line != "").select(*[ident(c) for c in kept], "line_no", line.alias("_raw"), line.alias("message"))


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A JSON value that begins with a brace, up to the brace after which the text ends or another one opens: within a value
#: an opening brace never follows a closing one without a comma. Whether it is one, the parser decides.
_CHUNK = rf'\{{(?:[^"}}]++|{_STRING}|\}}(?!\s*(?:\{{|\z)))*+\}}'
#: The members of an envelope, and those of them that are metadata.
ENVELOPE_METADATA = ("host", "source", "sourcetype", "index")
ENVELOPE_MEMBERS = ("time", *ENVELOPE_METADATA, "event", "fields")


def split_envelopes(bodies: DataFrame, body: str, *, received: Column | None = None, defaults: dict | None = None) -> DataFrame:
    """An event per envelope of a body of JSON objects one after another, read by the JSON parser at any depth that it takes.

    Metadata come from the envelope, then from ``defaults``, then from fixed values; metadata that are given but null,
    empty or no text are an error, and so are unknown or repeated members, an envelope without a non-blank event, no
    index from anywhere, and a body with anything but objects. A body is taken whole or not at all: ``problem`` says
    what is wrong with an envelope, or that the request was refused for another one's sake. Null bodies are invalid.
    Columns of ``bodies`` other than the body are kept.
    """
    kept = [c for c in bodies.columns if c != body]
    text, given = ident(body), ENVELOPE_DEFAULTS | (defaults or {})
    received = F.current_timestamp() if received is None else received
    chunks, between, items = PRIVATE + "c", PRIVATE + "b", PRIVATE + "i"
    rows = bodies.select(*[ident(c) for c in kept], F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0)).alias(chunks), (F.trim(F.regexp_replace(F.regexp_replace(text, _CHUNK, ""), r"\s+", "")) != "").alias(between))

    def envelope(e: Column) -> Column:
        v, names = parsed_whole(e), F.json_object_keys(e)
        get = lambda name: F.get_json_object(e, f"$.{name}")
        kind = lambda name: F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant"))
        has = lambda name: F.array_contains(names, name)
        problem = F.when(v.isNull(), F.lit("invalid body")).when(F.exists(names, lambda n: ~n.isin(*ENVELOPE_MEMBERS)), F.lit("unknown member"))
        problem = problem.when(F.coalesce(get("event"), F.lit("")) == "", F.lit("blank event"))
        for name in ENVELOPE_METADATA:
            wrong = has(name) & ((F.coalesce(get(name), F.lit("")) == "") | (kind(name) != "STRING"))
            problem = problem.when(wrong, F.lit(f"invalid {name}"))
            if name == "index" and not given.get("index"):
                problem = problem.when(~has(name), F.lit("no index"))
        return F.struct(
            problem.alias("problem"), get("time").alias("time"), *[F.coalesce(get(n), F.lit(given.get(n))).alias(n) for n in ENVELOPE_METADATA], get("event").alias("_raw"),
            F.when(kind("event") == "STRING", get("event")).alias("message"), get("fields").alias("fields"),
        )

    rows = rows.select(*[ident(c) for c in kept], between, F.transform(chunks, envelope).alias(items))
    refused = F.coalesce(F.col(between), F.lit(True)) | F.exists(items, lambda x: x["problem"].isNotNull())
    rows = rows.select(*[ident(c) for c in kept], between, refused.alias(PRIVATE + "r"), F.posexplode_outer(items).alias("event_no", PRIVATE + "e"))
    e = F.col(PRIVATE + "e")
    problem = F.when(F.coalesce(F.col(between), F.lit(True)), F.lit("invalid body")).when(e.isNull(), F.lit("no event")).otherwise(F.coalesce(e["problem"], F.when(F.col(PRIVATE + "r"), F.lit("refused request"))))
    return rows.select(
        *[ident(c) for c in kept], "event_no", F.coalesce(event_time(e["time"]), received).alias("_time"), *[e[n].alias(n) for n in (*ENVELOPE_METADATA, "_raw", "message", "fields")], problem.alias("problem"),
    )


def read_envelopes(spark: SparkSession, path: str, **options) -> DataFrame:
    """The events of files that each hold a request body; files ending in .gz are unpacked."""
    return split_envelopes(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"), "body", **options)


def read_lookup_csv(spark: SparkSession, path: str) -> DataFrame:
    """A lookup file: comma-separated with a header of unique names, all cells texts, empty cells empty texts."""
    head = spark.read.text(path).limit(1).collect()
    names = next(csv.reader([head[0][0]])) if head else []
    if len({n.lower() for n in names}) != len(names) or not names or any(not n for n in names):
        raise DataError("a lookup file's columns need unique names")
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="", mode="FAILFAST")
    return df.fillna("")


def redact(df: DataFrame, texts: Sequence[str], *, more: Sequence[str] = ()) -> DataFrame:
    """The values of sensitive fields in JSON, key=value and header texts replaced by a mark, before storing."""
    names = "|".join(re.escape(n).replace("_", "[_-]?") for n in (*SENSITIVE, *more))
    out = {}
    for t in texts:
        c = F.regexp_replace(ident(t), rf'(?i)("(?:{names})"\s*:\s*)(?:{_STRING}|[^,}}\s]+)', f'$1"{REDACTED}"')
        c = F.regexp_replace(c, rf'(?i)(?<![\w"])((?:{names})=)(?:{_STRING}|[^\s&;,"]+)', f"$1{REDACTED}")
        out[t] = F.regexp_replace(c, rf"(?im)^((?:{names}):\s*)\S.*$", f"$1{REDACTED}")
    return df.withColumns(out)


#: A prime below whose square 64-bit integers don't overflow.
_PRIME = 1_000_003


def _draws(seed: int, most: int, salt: int, ordinal: Column) -> Column:
    """A number below ``most`` for every ordinal: squares modulo a prime, in plain integer arithmetic."""
    x = F.pmod(ordinal * F.lit(7919 + 2 * salt) + F.lit(seed * 104_729 + salt * 1299_709), F.lit(_PRIME))
    return F.pmod(F.pmod(x * x + ordinal, F.lit(_PRIME)), F.lit(most))


def generate_events(spark: SparkSession, n: int, *, seed: int = 1, start: str = "2026-01-01T00:00:00Z", interval_us: int = 100_000, cardinality: int = 100_000, shape: str = "flat", partitions: int | None = None) -> DataFrame:
    """Seeded events, the same for the same arguments: ``ordinal, _time, _raw`` and the parts of the raw text.

    Shapes: flat (a JSON object), nested (objects within), cardinality (few fields, one with ``cardinality`` values),
    raw (a line of words). Every value is drawn from seed and ordinal alone, so any part can be made by itself,
    anywhere. Events come as requests of up to four steps that share a trace; waits are spread over six powers of ten.
    """
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    at, request = F.col("id"), div(F.col("id"), F.lit(4).cast("long"))
    draw = lambda salt, most, by=at: _draws(seed, most, salt, by)
    pick = lambda salt, words: F.element_at(F.array(*[F.lit(w) for w in words]), (draw(salt, len(words)) + 1).cast("int"))
    luck = draw(1, 100)
    level = F.when(luck < 3, "TRACE").when(luck < 20, "DEBUG").when(luck < 82, "INFO").when(luck < 93, "WARN").when(luck < 99, "ERROR").otherwise("FATAL")
    status = F.when(luck < 82, F.element_at(F.array(F.lit(200), F.lit(201), F.lit(204)), (draw(2, 3) + 1).cast("int"))).when(luck < 93, F.lit(404)).otherwise(F.lit(503))
    wait = F.element_at(F.array(*[F.lit(10**i) for i in range(1, 7)]), (draw(3, 6) + 1).cast("int")) * (draw(4, 9) + 1)
    df = rows.select(
        at.alias("ordinal"), F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(start))) + at * interval_us).alias("_time"), level.alias("level"), status.alias("status"),
        pick(5, ["GET", "HEAD", "PUT", "DELETE"]).alias("method"), F.concat_ws("/", F.lit(""), pick(6, ["depot", "berth", "crane", "tide"]), draw(7, 500).cast("string")).alias("path"), wait.alias("wait_us"),
        ((draw(8, 90) + 1) * (draw(9, 90) + 1)).alias("size"), F.format_string("acct%07d", draw(10, min(cardinality, _PRIME))).alias("account"),
        F.md5(F.concat_ws("/", F.lit(seed), request)).alias("trace_id"), F.lpad(F.lower(F.hex(at * 4096 + draw(11, 4096))), 16, "0").alias("span_id"),
    )
    stamp = F.date_format("_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    raw = {
        "flat": lambda: F.to_json(F.struct(stamp, "level", "method", "path", "status", "wait_us", "size", "account", "trace_id", "span_id")),
        "nested": lambda: F.to_json(F.struct(stamp, F.struct("level", "status").alias("outcome"), F.struct("method", "path", "size").alias("request"), F.struct("trace_id", "span_id").alias("trace"), F.array("method", "level").alias("labels"))),
        "cardinality": lambda: F.to_json(F.struct(stamp, "level", "account")),
        "raw": lambda: F.concat_ws(" ", stamp, "level", "account", "method", "path", F.col("status").cast("string"), F.concat(F.col("wait_us").cast("string"), F.lit("us"))),
    }
    if shape not in raw:
        raise ValueError(f"shape is one of {', '.join(raw)}")
    return df.withColumn("_raw", raw[shape]())


def index_statistics(df: DataFrame, index: str, time: str) -> DataFrame:
    """Per index its number of events, and the first and last event time."""
    return df.groupBy(ident(index).alias("index")).agg(F.count(F.lit(1)).alias("events"), F.min(ident(time)).alias("first_event"), F.max(ident(time)).alias("last_event"))
