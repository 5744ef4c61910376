"""Commands that work row by row: filters, projections and new fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, div, ident
from tidelog.functions.scalars import Value, java_pattern
from tidelog.functions.values import txt
from tidelog.plans.errors import SearchError
from tidelog.plans.nodes import Command, FieldTest, Literal, Logic, Not, Term
from tidelog.plans.relation import NAME, Relation


# the predicates of a base search ------------------------------------------------------------------------------------
def _glob(pattern: str) -> str:
    return "(?is)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def _term(rel: Relation, node: Term) -> Column:
    raw = rel.field("_raw")
    if node.phrase:
        return F.lower(raw.txt).contains(node.text.lower())
    if node.text == "*":
        return F.lit(True)
    word = ".*".join(re.escape(p) for p in node.text.split("*"))
    # the cheap test first, on what the exact one needs anyway
    found = raw.txt.rlike(f"(?is)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")
    return F.lower(raw.txt).contains(node.text.lower()) & found if "*" not in node.text and node.text.isascii() else found


def _is_number(text: str) -> bool:
    return bool(re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text))


def _field_test(rel: Relation, node: FieldTest) -> Column:
    v = rel.field(node.field)
    value = node.value
    if value == "*" and not node.quoted:
        return v.col.isNotNull() if node.op == "=" else v.col.isNull() & v.col.isNotNull()
    if v.kind == "mv":
        return F.exists(v.col, lambda m: _test(Value(m, "string"), node, value))
    if node.field == "index" and node.op in ("=", "!=") and NAME in rel.df.columns:
        # a table that holds several indexes is named as a whole by its binding
        own, whole = _test(v, node, value), _test(Value(F.col(NAME), "string"), node, value)
        return own | whole if node.op == "=" else own & whole
    hit = _test(v, node, value)
    head = value.split("*")[0]  # what comes before a wildcard
    if node.op == "=" and head and v.kind == "string" and node.field in rel.public and head.isascii() and not _is_number(value):
        # however it is written, it lies between its capitals and its small letters, which the scan can compare
        lo, hi = head.upper(), head.lower() + ("\U0010ffff" if head != value else "")
        if "k" in hi:  # but for the sign of the unit kelvin, whose small letter is a k
            hi = hi[: hi.index("k")] + "\U0010ffff"
        hit = (v.col >= F.lit(lo)) & (v.col <= F.lit(hi)) & hit
    return hit


def _test(v: Value, node: FieldTest, value: str) -> Column:
    exact = node.field == "index"
    if "*" in value and node.op in ("=", "!="):
        hit = v.txt.rlike(_glob(value).replace("(?is)", "(?s)") if exact else _glob(value))
        return hit if node.op == "=" else ~hit
    if v.kind == "bool" and node.op in ("=", "!=") and value.lower() in ("true", "false"):
        return v.col == F.lit(value.lower() == "true") if node.op == "=" else v.col != F.lit(value.lower() == "true")

    def compare(x: Column, y: Column) -> Column:
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[node.op]

    if v.kind == "time" and not _is_number(value):
        return compare(v.col.cast("timestamp"), F.to_timestamp(F.lit(value)))
    if _is_number(value) and not exact:
        number = F.lit(int(value)) if v.integral and re.fullmatch(r"[+-]?\d{1,18}", value) else F.lit(float(value))
        if v.kind in ("number", "time"):
            return compare(v.col if v.integral else v.num, number)
        as_number, as_text = v.num, compare(F.lower(v.txt), F.lit(value.lower()))
        return F.when(as_number.isNotNull(), compare(as_number, number)).otherwise(as_text)
    return compare(v.txt, F.lit(value)) if exact else compare(F.lower(v.txt), F.lit(value.lower()))


def search_predicate(rel: Relation, node) -> Column:
    """A base-search predicate; a missing value satisfies no test, and a negation holds for it."""
    if isinstance(node, Logic):
        parts = [search_predicate(rel, p) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return out
    if isinstance(node, Not):
        return ~F.coalesce(search_predicate(rel, node.arg), F.lit(False))
    if isinstance(node, Term):
        return _term(rel, node)
    return _field_test(rel, node)


def search(rel: Relation, c: Command) -> Relation:
    return rel if c["predicate"] is None else rel.with_(df=rel.df.where(search_predicate(rel, c["predicate"])))


def where(rel: Relation, c: Command) -> Relation:
    return rel.with_(df=rel.df.where(rel.compiler.predicate(c["predicate"])))


def eval_(rel: Relation, c: Command) -> Relation:
    for name, node in c["pairs"]:
        v = rel.compiler.value(node)
        rel = rel.set({name: v.col})
    return rel


def regex(rel: Relation, c: Command) -> Relation:
    hit = rel.field(c["field"]).txt.rlike(java_pattern(c["pattern"]))
    return rel.with_(df=rel.df.where(F.coalesce(~hit, F.lit(True)) if c["negated"] else hit))


def rex(rel: Relation, c: Command) -> Relation:
    """The first match's named groups; without a match the fields keep their values."""
    text, pattern = rel.field(c["field"]).txt, java_pattern(c["pattern"])
    groups = [m for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?<([A-Za-z_]\w*)>|\((?!\?)", pattern) if not m[0].startswith(("\\", "["))]
    number = {m[1]: i + 1 for i, m in enumerate(groups) if m[1]}
    # Java's named groups allow no underscore
    plain = re.sub(r"\(\?<[A-Za-z_]\w*>", "(", pattern)
    hit = text.rlike(plain)
    return rel.set({n: F.when(hit, F.regexp_extract(text, plain, number[n])).otherwise(_old_text(rel, n)) for n in c["names"]})


def _old_text(rel: Relation, name: str) -> Column:
    old = rel.field(name)
    return F.lit(None).cast("string") if old.kind == "null" else old.txt


def fields(rel: Relation, c: Command) -> Relation:
    if c["exclude"]:
        gone = [n for n in c["names"] if n in rel.public]
        return rel.with_(df=rel.df.drop(*[n for n in gone]), flat=rel.flat - set(gone)) if gone else rel
    names = [*c["names"]]
    if "_time" in rel.public and "_time" not in names and not rel.closed:
        names.append("_time")
    return rel.keep(names)


def table(rel: Relation, c: Command) -> Relation:
    return rel.keep(c["names"]).with_(closed=True)


def rename(rel: Relation, c: Command) -> Relation:
    for a, b in c["pairs"]:
        if a == b:
            continue
        if a not in rel.public and rel.field(a).kind == "null":
            if b in rel.public:
                rel = rel.set({b: F.lit(None).cast(rel.df.schema[b].dataType)})
            continue
        v, flat = rel.field(a), rel.flat
        cols = [v.col.alias(b) if n == a else ident(n) for n in rel.df.columns if n != b]
        if a not in rel.public:
            cols.append(v.col.alias(b))
        rel = rel.with_(df=rel.df.select(*cols), flat=frozenset(b if x == a else x for x in flat if x != b))
    return rel


def fillnull(rel: Relation, c: Command) -> Relation:
    out = {}
    for n in c["names"]:
        v = rel.field(n)
        out[n] = F.lit(c["value"]) if v.kind == "null" else F.coalesce(v.txt, F.lit(c["value"]))
    return rel.set(out)


def addtotals(rel: Relation, c: Command) -> Relation:
    total = F.lit(0.0)
    for n in c["names"]:
        total = total + F.coalesce(rel.field(n).num, F.lit(0.0))
    return rel.set({c["dest"]: total})


def strcat(rel: Relation, c: Command) -> Relation:
    parts = [F.lit(p.value) if isinstance(p, Literal) else rel.field(p.name).txt for p in c["parts"]]
    if not c["all"]:
        return rel.set({c["dest"]: F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])})
    joined = F.concat(*parts)
    return rel.set({c["dest"]: F.when(joined.isNotNull(), joined).otherwise(_old_text(rel, c["dest"]))})


def addinfo(rel: Relation, c: Command) -> Relation:
    ctx = rel.ctx
    return rel.set({
        "info_min_time": F.lit(ctx.earliest if ctx.earliest is not None else 0.0), "info_max_time": F.lit(ctx.latest).cast("double"),
        "info_search_time": F.lit(float(ctx.now)), "info_sid": F.lit(ctx.sid),
    })


SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def time_bin(ts: Column, seconds: int) -> Column:
    """The start of the slot of so many seconds, counted from the epoch, that holds a time."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(us - F.pmod(us, F.lit(seconds * 1_000_000)))


def bin_(rel: Relation, c: Command) -> Relation:
    v, (n, unit) = rel.field(c["field"]), c["span"]
    if v.kind == "time":
        if unit not in SECONDS:
            raise SearchError("SPL_UNSUPPORTED_BIN_SYNTAX", "a span in seconds, minutes, hours or days is expected", c.start, c.end)
        return rel.set({c["alias"]: time_bin(v.col, n * SECONDS[unit])})
    if unit:
        raise SearchError("SPL_UNSUPPORTED_BIN_SYNTAX", "a plain number is expected for a field that isn't a time", c.start, c.end)
    if v.kind == "number" and v.integral:
        x = v.col.cast("bigint")
        return rel.set({c["alias"]: x - F.pmod(x, F.lit(n).cast("bigint"))})
    lower = F.floor(v.num / F.lit(float(n))) * F.lit(float(n))
    if v.kind == "string":  # texts that spell no number pass through
        return rel.set({c["alias"]: F.when(v.num.isNotNull(), txt(lower, "number")).otherwise(v.col)})
    return rel.set({c["alias"]: F.when(v.num.isNotNull(), lower.cast("double")) if v.kind == "number" else v.col})


def nomv(rel: Relation, c: Command) -> Relation:
    v = rel.field(c["field"])
    if v.kind not in ("mv", "null"):
        raise SearchError("SPL_UNSUPPORTED_NOMV_SYNTAX", "nomv needs a list", c.start, c.end)
    return rel.with_(flat=rel.flat | {c["field"]})


__all__ = ["PRIVATE", "div", "search_predicate"]
