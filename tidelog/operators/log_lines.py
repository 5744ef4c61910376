r"""Log lines of many layouts into timestamp, level, component and message.

Three steps, each usable by itself:

* a line that begins with a timestamp header starts a record (``RECORD_START``);
* lines in between continue the record before them, numbered by a running count of starts per file;
* the first pattern of an ordered cascade that fits a record's head names its fields.

Everything is built-in Spark expressions, evaluated lazily: a record runs only the patterns of its own layout.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, cut, div, ident, micros

#: The header expressions that start a record. Structured lines start one by their opening sign.
RECORD_START = "|".join((
    r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d",  # ISO date and time first: application logs
    r"\[\d{4}-\d\d-\d\d[T ]\d\d:\d\d",  # the same in brackets
    r"<\d{1,3}>(?:\d |[A-Z][a-z]{2} )",  # syslog priority
    r"[A-Z][a-z]{2} \d\d, \d{4} \d{1,2}:\d\d:\d\d [AP]M ",  # month name first, twelve-hour clock
    r"[IWEFD]\d{4} \d\d:\d\d:\d\d",  # one-letter severity, month and day
    r"[A-Z]+:[^\s:]+:\d{4}-\d\d-\d\d ",  # level and logger before the date
    r"\{\s*\"",  # a JSON object
    r"(?:ts|time|t|level|lvl|severity|msg)=",  # key=value pairs
    r"\S+ \S+ \S+ \[\d\d/[A-Z][a-z]{2}/\d{4}:",  # access log
))

#: The rank of every spelling of a level, on the scale 1 trace, 2 debug, 3 info, 4 warn, 5 error, 6 fatal.
LEVELS = {
    1: ("TRACE", "TRC", "T", "FINEST", "FINER"),
    2: ("DEBUG", "DBG", "DBUG", "D", "FINE"),
    3: ("INFO", "INF", "I", "NOTICE", "CONFIG", "INFORMATION"),
    4: ("WARN", "WARNING", "WRN", "W"),
    5: ("ERROR", "ERR", "EROR", "E", "SEVERE"),
    6: ("FATAL", "F", "CRITICAL", "CRIT", "CRT", "C", "PANIC", "DPANIC", "EMERG", "ALERT"),
}
#: What marks a line at which a text's running count of record starts rises.
_RISE = "\x1e\x1f\x1e"
LEVEL_NAMES = ("trace", "debug", "info", "warn", "error", "fatal")
ERROR = 5
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


@dataclass(frozen=True)
class Layout:
    """One step of the cascade: ``head`` says, with ``has`` found anywhere, whether a record has this layout. ``fields``
    is one pattern for a whole record with the named groups time, level, component and message, those behind the first
    optional, so that a record cut off gives what it still has; for records whose fields come in any order, it is a
    pattern with one group for each. ``stamp`` names the kind of timestamp."""

    name: str
    head: str
    stamp: str  # iso, iso_or_epoch_s, epoch_ms, month_day, klog, clock12 or access
    fields: str | dict[str, str]
    has: str = ""
    level_kind: str = "word"  # word, pino (tens), otel (1..24) or syslog (priority)


FIELDS = ("time", "level", "component", "message")
_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
_ESC = r"(?:\x1b\[[0-9;]*m)"
_STR = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)'  # possessive: a long text costs neither stack nor backtracking
_REST = r"(?<message>[\s\S]*+)"
_TAIL = r"[\s\S]*+$"
_SD = r'(?:-|(?:\[(?:[^\]"\\]|\\.|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+\])+)'  # structured data of a syslog record


def _key(*names: str) -> str:
    """A member of a JSON object up to its value. The name comes first, as a literal where there is but one, which is
    searched for quickly; a name inside a text, where its quotes are escaped, doesn't count."""
    name = '"' + (names[0] if len(names) == 1 else f"(?:{'|'.join(names)})") + '"'
    return rf"{name}(?<!\\{name})\s*:\s*"


#: The cascade. Order matters: a later, more general pattern sees only what the earlier ones left.
CASCADE = (
    Layout("json_otel", r"^\s*\{", "iso", {"time": _key("timestamp") + r'"([^"]+)"', "level": _key("severity_number") + r"(\d+)", "component": _key("scope") + r'\{\s*"name"\s*:\s*' + _STR + '"', "message": _key("body") + _STR}, r'"(?:severity_text|severity_number|body)"\s*:', "otel"),
    Layout("json_pino", r"^\s*\{", "epoch_ms", {"time": _key("time") + r"(\d+)", "level": _key("level") + r"(\d+)", "component": _key("name") + _STR + '"', "message": _key("msg") + _STR}, r'"level"\s*:\s*\d', "pino"),
    Layout("json_zap", r"^\s*\{\s*\"", "iso_or_epoch_s", {"time": _key("ts", "time", "timestamp", "t") + r'"?([0-9][^",}\s]*(?: [0-9:.,]+)?)', "level": _key("level", "severity", "lvl") + r'"([^"]+)"', "component": _key("logger", "component", "name") + _STR + '"', "message": _key("msg", "message") + _STR}),
    Layout("syslog_ietf", r"^<\d{1,3}>\d+ ", "iso", rf"^<(?<level>\d+)>\d+ (?:(?<time>\S+) (?:\S+ (?:(?<component>\S+) (?:\S+ \S+ {_SD} ?{_REST})?)?)?)?{_TAIL}", level_kind="syslog"),
    Layout("syslog_bsd", r"^<\d{1,3}>[A-Z][a-z]{2} +\d+ ", "month_day", rf"^<(?<level>\d+)>(?:(?<time>[A-Z][a-z]{{2}} +\d+ \d\d:\d\d:\d\d) (?:\S+ (?:(?<component>[^\s:\[]+)(?:[^\s:]*: ?{_REST})?)?)?)?{_TAIL}", level_kind="syslog"),
    Layout("klog", r"^[IWEFD]\d{4} \d\d:\d\d:\d\d", "klog", rf"^(?<level>[A-Z])(?<time>\d{{4}} \d\d:\d\d:\d\d)(?:\S* +\d+ (?<component>[^\s:\]]+):\d+(?=\]))?(?:[^\]]*+\] ?{_REST})?{_TAIL}"),
    Layout("clock12", r"^[A-Z][a-z]{2} \d\d, \d{4} \d{1,2}:\d\d:\d\d [AP]M ", "clock12", rf"^(?<time>[A-Z][a-z]{{2}} \d\d, \d{{4}} \d{{1,2}}:\d\d:\d\d [AP]M) (?<component>\S+)?[^\r\n]*+(?:\r?\n(?<level>[A-Z]+): ?{_REST})?{_TAIL}"),
    Layout("bracket", r"^\[" + _ISO + r"\]\[", "iso", rf"^\[(?<time>{_ISO})\]\[(?:(?<level>[^\]]+)\](?:\[(?<component>[^\]]+)\] ?{_REST})?)?{_TAIL}"),
    Layout("dashed", r"^" + _ISO + r" - \S+ - [A-Z]+ - ", "iso", rf"^(?<time>{_ISO}) - (?<component>\S+) - (?<level>[A-Z]+) - {_REST}$"),
    Layout("thread_after", r"^" + _ISO + r" [A-Z]+ +\[[^\]]*\] \S+ - ", "iso", rf"^(?<time>{_ISO}) (?<level>[A-Z]+) +\[[^\]]*\] (?<component>\S+) - {_REST}$"),
    Layout("thread_before", r"^" + _ISO + r" \[[^\]]*\] [A-Z]+ +\S+: ", "iso", rf"^(?<time>{_ISO}) \[[^\]]*\] (?<level>[A-Z]+) +(?<component>\S+): {_REST}$"),
    Layout("module_path", rf"^{_ISO} +{_ESC}? *[A-Z]+{_ESC}? +\S+: ", "iso", rf"^(?<time>{_ISO}) +{_ESC}? *(?<level>[A-Z]+){_ESC}? +(?:{_ESC}*(?<component>[^\s\x1b]+?){_ESC}*:{_ESC}* {_REST})?{_TAIL}"),
    Layout("level_first", r"^[A-Z]+:[^\s:]+:" + _ISO, "iso", rf"^(?<level>[A-Z]+):(?<component>[^\s:]+):(?<time>{_ISO})(?:: ?{_REST})?{_TAIL}"),
    Layout("pairs", r"^[a-z_]+=", "iso", {"time": r'(?:^| )(?:ts|time|t)="?(' + _ISO + ")", "level": r'(?:^| )(?:level|lvl|severity)="?(\w+)', "component": r'(?:^| )(?:component|logger)="?([^\s"]+)', "message": r'(?:^| )msg="([^"\\]*+(?:\\.[^"\\]*+)*+)'}, r"(?:^| )(?:level|lvl|severity)="),
    Layout("access", r"^\S+ \S+ \S+ \[\d\d/[A-Z][a-z]{2}/\d{4}:", "access", {"time": r"\[(\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4})\]", "message": _STR + '"'}),
)
_PART = "\x1f"  # between the fields that a pattern for a whole record gives


def _fields(layout: Layout, head: Column, rec: Column) -> Column:
    """The layout's fields of a record in the order of ``FIELDS``; "" for one that it doesn't have."""
    if isinstance(layout.fields, str):
        groups = _PART.join(f"${{{f}}}" if f"(?<{f}>" in layout.fields else "" for f in FIELDS)
        return F.split(F.regexp_replace(rec, layout.fields, groups), _PART, len(FIELDS))
    return F.array(*[F.regexp_extract(rec if f == "message" else head, layout.fields[f], 1) if f in layout.fields else F.lit("") for f in FIELDS])


def _utc(text: Column) -> Column:
    return F.unix_micros(text.try_cast("timestamp"))


def _iso_us(stamp: Column) -> Column:
    """Microseconds of an ISO date and time; without offset it is UTC, the fraction may follow a point or a comma."""
    zone = F.substring(stamp, -6, 1).isin("+", "-") | F.substring(stamp, -5, 1).isin("+", "-") | F.endswith(stamp, F.lit("Z"))
    return F.when(F.length(stamp) >= 19, _utc(F.concat(F.translate(stamp, ",", "."), F.when(zone, F.lit("")).otherwise(F.lit("Z")))))


def _month_number(name: Column) -> Column:
    return F.lpad(div(F.instr(F.lit(_MONTHS), name).cast("long") + F.lit(2), F.lit(3)).cast("string"), 2, "0")


def _nearest_year_us(month: Column, day: Column, clock: Column, near_us: Column) -> Column:
    """The year that brings a date without one nearest to another time; the 29th of February only in years that have it."""
    year = F.year(F.timestamp_micros(near_us))
    tries = [
        _utc(F.concat((year + d).cast("string"), F.lit("-"), month, F.lit("-"), F.lpad(F.trim(day), 2, "0"), F.lit(" "), clock, F.lit("Z")))
        for d in (0, -1, 1)
    ]
    best = F.array_min(F.filter(F.array(*[F.struct(F.abs(t - near_us).alias("off"), t.alias("us")) for t in tries]), lambda s: s["us"].isNotNull()))
    return best["us"]


def _stamp_us(kind: str, stamp: Column, near_us: Column) -> Column:
    if kind == "iso":
        return _iso_us(stamp)
    if kind == "epoch_ms":
        return stamp.cast("decimal(20,0)").cast("long") * F.lit(1000)
    if kind == "iso_or_epoch_s":
        return F.when(stamp.rlike(r"^\d+(?:\.\d+)?$"), (stamp.try_cast("decimal(26,6)") * F.lit(1_000_000)).cast("long")).otherwise(_iso_us(stamp))
    if kind == "month_day":
        return _nearest_year_us(_month_number(F.substring(stamp, 1, 3)), F.regexp_extract(stamp, r"^\S+ +(\d+)", 1), F.regexp_extract(stamp, r"(\S+)$", 1), near_us)
    if kind == "klog":
        return _nearest_year_us(F.substring(stamp, 1, 2), F.substring(stamp, 3, 2), F.substring(stamp, 6, 8), near_us)
    if kind == "clock12":
        hour = F.regexp_extract(stamp, r" (\d{1,2}):", 1).try_cast("int") % 12 + F.when(stamp.endswith("PM"), 12).otherwise(0)
        return _utc(F.concat(F.substring(stamp, 9, 4), F.lit("-"), _month_number(F.substring(stamp, 1, 3)), F.lit("-"), F.substring(stamp, 5, 2), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.regexp_extract(stamp, r"(:\d\d:\d\d) ", 1), F.lit("Z")))
    if kind == "access":
        return _utc(F.concat(F.substring(stamp, 8, 4), F.lit("-"), _month_number(F.substring(stamp, 4, 3)), F.lit("-"), F.substring(stamp, 1, 2), F.lit(" "), F.substring(stamp, 13, 8), F.substring(stamp, 22, 5)))
    raise ValueError(kind)


def _word_rank(word: Column) -> Column:
    up = F.upper(word)
    rank = F.lit(None).cast("int")
    for r, words in LEVELS.items():
        rank = F.when(up.isin(*words), F.lit(r)).otherwise(rank)
    return rank


def _number_rank(kind: str, n: Column) -> Column:
    if kind == "syslog":  # 0 emergency, 1 alert, 2 critical, 3 error, 4 warning, 5 notice, 6 info, 7 debug
        return F.get(F.array(*[F.lit(x) for x in (6, 6, 6, 5, 4, 3, 3, 2)]), n % 8)
    if kind == "pino":  # tens
        return F.least(F.greatest(div(n.cast("long"), F.lit(10)), F.lit(1)), F.lit(6)).cast("int")
    return F.when(n.between(1, 24), div(n.cast("long") + 3, F.lit(4)).cast("int"))  # telemetry: four numbers a level


def _unquoted(text: Column) -> Column:
    """Key=value pairs with their quoted values emptied, so that a key inside a message isn't taken for a field."""
    return F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)', '""')


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: a generator keeps the optimizer from repeating the
    expression in every place that uses it, which for a cascade of patterns would be dozens of times."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_records(df: DataFrame, record: str, near_us: str, entry: str = "entry") -> DataFrame:
    """``df`` with a struct of ``layout, entry_us, level_rank, level, component, message, n_lines`` for each
    record's text in the column ``record``.

    ``near_us`` (epoch microseconds) settles the year of dates that have none. Fields that the text doesn't state
    are null; a text that fits no layout has the layout "plain" and is its own message; a null text gives a struct
    of nulls. Very long texts are parsed whole.
    """
    rec, lay, head, got = ident(record), F.col(PRIVATE + "lay"), F.col(PRIVATE + "head"), F.col(PRIVATE + "got")
    number = F.lit(None).cast("int")
    for i, layout in reversed([*enumerate(CASCADE)]):
        fits = rec.rlike(layout.head)
        if layout.has:
            fits = fits & (_unquoted(rec) if layout.name == "pairs" else rec).rlike(layout.has)
        number = F.when(fits, F.lit(i)).otherwise(number)
    df = _once(df, PRIVATE + "lay", number)
    of = lambda test: lay.isin([i for i, x in enumerate(CASCADE) if test(x)])
    df = _once(df, PRIVATE + "head", F.when(of(lambda x: x.name == "pairs"), _unquoted(rec)).otherwise(rec))
    parts = F.lit(None).cast("array<string>")
    for i, layout in reversed([*enumerate(CASCADE)]):
        parts = F.when(lay == i, _fields(layout, head, rec)).otherwise(parts)
    df = _once(df, PRIVATE + "got", parts)
    time, level, component = (F.nullif(F.get(got, F.lit(i)), F.lit("")) for i in range(3))
    us, rank = F.lit(None).cast("long"), _word_rank(level)
    for kind in dict.fromkeys(x.stamp for x in CASCADE):
        us = F.when(of(lambda x, kind=kind: x.stamp == kind), _stamp_us(kind, time, ident(near_us))).otherwise(us)
    for kind in ("syslog", "pino", "otel"):
        n = _number_rank(kind, level.try_cast("int"))
        if kind == "otel":  # the name of the level where there is no number
            n = F.coalesce(n, _word_rank(F.nullif(F.regexp_extract(rec, _key("severity_text") + r'"([^"]+)"', 1), F.lit(""))))
        rank = F.when(of(lambda x, kind=kind: x.level_kind == kind), n).otherwise(rank)
    df = _once(df, PRIVATE + "at", F.struct(us.alias("us"), rank.alias("rank")))
    us, rank = F.col(PRIVATE + "at")["us"], F.col(PRIVATE + "at")["rank"]
    value = F.struct(
        F.when(rec.isNotNull(), F.coalesce(F.get(F.array(*[F.lit(x.name) for x in CASCADE]), lay), F.lit("plain"))).alias("layout"), us.alias("entry_us"), rank.alias("level_rank"),
        F.get(F.array(*[F.lit(x) for x in LEVEL_NAMES]), rank - 1).alias("level"), component.alias("component"), F.when(lay.isNull(), rec).otherwise(F.get(got, F.lit(3))).alias("message"),
        (F.length(rec) - F.length(F.replace(rec, F.lit("\n"))) + 1).alias("n_lines"),
    )
    return df.withColumn(entry, value).drop(PRIVATE + "lay", PRIVATE + "head", PRIVATE + "got", PRIVATE + "at")


def records_of(raw: Column) -> Column:
    """The records of a text that is a file by itself: its lines, grouped by the running count of record starts.

    Every line is held against the header expressions; the text is put together again with a mark where the count
    rises and parted there, which takes one pass however many lines and records there are. Lines before the first
    start belong to the first record; a CR at the end of a record that another one follows is dropped; null gives null.
    """
    lines = F.split(raw, "\n", -1)
    marked = F.transform(lines, lambda line, i: F.when((i > 0) & line.rlike("^(?:" + RECORD_START + ")"), F.concat(F.lit(_RISE), line)).otherwise(line))
    return F.when(F.contains(raw, F.lit("\n")), F.split(F.array_join(marked, "\n"), "\r?\n" + _RISE, -1)).otherwise(F.when(raw.isNotNull(), F.array(raw)))


def parse_texts(df: DataFrame, raw: str, near: str) -> DataFrame:
    """Every record of every row's text, parsed: all columns of ``df``, ``record_no`` (from 0) and ``entry`` (the
    struct of ``parse_records``). A row with null text has one record with an entry of nulls. Columns of ``df`` that
    bear those names are replaced."""
    kept = [c for c in df.columns if c.lower() not in ("record_no", "entry")]
    rows = df.select(*[ident(c) for c in kept], micros(near).alias(PRIVATE + "near"), F.posexplode_outer(records_of(ident(raw))).alias("record_no", PRIVATE + "record"))
    return parse_records(rows.withColumn("record_no", F.coalesce("record_no", F.lit(0))), PRIVATE + "record", PRIVATE + "near").drop(PRIVATE + "near", PRIVATE + "record")


def _assemble(lines: DataFrame, file: str, line_no: str, line: str, near: str | None, block: int, longest: int) -> tuple[DataFrame, bool]:
    """The records and whether any may have several parts. Starts are counted per file and block of lines first; if no
    file has more than one block, a file's lines move once, to be numbered and put together."""
    base = lines.select(
        ident(file).alias("file"), ident(line_no).cast("long").alias("no"), F.coalesce(ident(line).cast("string"), F.lit("")).alias("line"), (micros(near) if near else F.lit(None).cast("long")).alias("near"),
    )
    base = base.withColumn("start", F.col("line").rlike("^(?:" + RECORD_START + ")")).withColumn("blk", div(F.coalesce("no", F.lit(0)), F.lit(block)))
    at_start = F.when(F.col("start"), F.col("no"))
    counts = cut(base.groupBy("file", "blk").agg(F.count_if("start").alias("s"), F.max(at_start).alias("last"), F.min("no").alias("least"), F.count(F.lit(1)).alias("n")))
    blocks, most = counts.groupBy("file").agg(F.count(F.lit(1)).alias("b"), F.sum("n").alias("n")).agg(F.max("b"), F.max("n")).first()
    several = (blocks or 0) > 1
    w = Window.partitionBy("file", *(["blk"] if several else [])).orderBy("no", "line").rowsBetween(Window.unboundedPreceding, 0)  # one block
    rows = base.withColumn("record_no", F.sum(F.col("start").cast("long")).over(w)).withColumn("first", F.max(at_start).over(w)).withColumn("least", F.min("no").over(w))
    if several:
        before = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
        shifts = counts.select(
            F.col("file").alias("f2"), F.col("blk").alias("b2"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("shift"), F.max("last").over(before).alias("carried"), F.min("least").over(before).alias("least2"),
        )
        rows = rows.join(shifts, rows["file"].eqNullSafe(shifts["f2"]) & (rows["blk"] == shifts["b2"]))
        rows = rows.withColumn("record_no", F.col("record_no") + F.col("shift")).withColumn("first", F.coalesce("first", "carried", "least2"))
    place = F.coalesce(F.col("no") - F.coalesce("first", "least"), F.lit(0))
    parts = rows.withColumn("part", div(place, F.lit(longest)))
    got = parts.groupBy("file", "record_no", "part").agg(
        F.min("no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.min("near").alias(PRIVATE + "near"), F.array_sort(F.collect_list(F.struct("no", "line"))).alias("ls"),
    )
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return got.select("file", "record_no", "part", "first_line", "n_lines", text.alias("text"), PRIVATE + "near"), (most or 0) > longest


def assemble_records(lines: DataFrame, file: str, line_no: str, line: str, *, block: int = 100_000, longest: int = 10_000) -> DataFrame:
    """Lines of files into records: ``file, record_no, part, first_line, n_lines, text``.

    A record's number is the count of starts up to its lines, kept per block of ``block`` lines and then shifted by
    the starts of the blocks before it, so a file of any length is never in one task. Lines before a file's first
    start are record 0. A record of more than ``longest`` lines is cut into parts of that many, one row each, so no
    line is lost and no task holds an endless record. Null lines count as empty ones, rows with a null file or line
    number are one file of their own or come first; line numbers should be unique in a file, ties are put in
    order of their text. Other columns are ignored.
    """
    return _assemble(lines, file, line_no, line, None, block, longest)[0].drop(PRIVATE + "near")


def parse_lines(lines: DataFrame, file: str, line_no: str, line: str, near: str, *, block: int = 100_000, longest: int = 10_000) -> DataFrame:
    """Lines of files into parsed records: the columns of ``assemble_records`` without ``text``, and ``entry``.

    ``near`` is a time of the line; the earliest of a record's is used. Of a record in several parts only the first is
    parsed: later parts have its layout, time, level and component, and their own text as message.
    """
    recs, may_have_parts = _assemble(lines, file, line_no, line, near, block, longest)
    if may_have_parts:
        recs = cut(recs)  # heads and later parts are taken from the same records
    heads = parse_records(recs.where("part = 0") if may_have_parts else recs, "text", PRIVATE + "near").drop("text", PRIVATE + "near")
    if not may_have_parts:
        return heads
    rest = recs.where("part > 0").alias("p").join(heads.select("file", "record_no", "entry").alias("h"), F.expr("p.file <=> h.file AND p.record_no = h.record_no"))
    later = rest.select("p.file", "p.record_no", "p.part", "p.first_line", "p.n_lines", F.col("h.entry").withField("message", F.col("p.text")).withField("n_lines", F.col("p.n_lines").cast("int")).alias("entry"))
    return heads.select(*later.columns).unionByName(later)


def severe_entries(df: DataFrame, raw: str, near: str, keep: Sequence[str], least: int = ERROR) -> DataFrame:
    """Every record of the rows' texts that states at least the level ``least``: ``keep``, ``entry_epoch`` (seconds,
    fraction dropped) and ``component``. A text with several such records has a row for each; records that state no
    level, null and empty texts have none."""
    kept = [ident(c).alias(f"{PRIVATE}k{i}") for i, c in enumerate(keep)]
    rows = parse_texts(df.select(*kept, ident(raw).alias(PRIVATE + "raw"), ident(near).alias(PRIVATE + "n")), PRIVATE + "raw", PRIVATE + "n")
    us = F.col("entry.entry_us")
    return rows.where(F.col("entry.level_rank") >= F.lit(least)).select(
        *[F.col(f"{PRIVATE}k{i}").alias(c) for i, c in enumerate(keep)], div(us - F.pmod(us, F.lit(1_000_000)), F.lit(1_000_000)).alias("entry_epoch"), F.col("entry.component").alias("component"),
    )
