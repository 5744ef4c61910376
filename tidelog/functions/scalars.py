"""Expressions of ``eval`` and ``where`` as Spark columns. All are built-in expressions; there is no UDF."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.values import num, number_text, txt
from tidelog.plans.errors import SearchError
from tidelog.plans.nodes import Binary, Call, Compare, Field, Literal, Logic, Member, Negate, Not
from tidelog.plans.parser import checked_pattern, is_boolean

INF = float("inf")


@dataclass
class Value:
    """A compiled expression: the column, its kind, and the literal behind it if there is one."""

    col: Column
    kind: str
    literal: object = None
    integral: bool = False

    @property
    def num(self) -> Column:
        return num(self.col, self.kind)

    @property
    def txt(self) -> Column:
        return txt(self.col, self.kind, self.integral)


class _Token:
    start = end = 0


def fail(name: str, message: str) -> SearchError:
    return SearchError("SPL_INVALID_FUNCTION_ARGUMENTS", f"{name}: {message}")


def java_pattern(pattern: str) -> str:
    """The pattern for Spark: ``$`` is the end of the text only, not before a last line break."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\$", r"\1\\z", re.sub(r"\(\?P<", "(?<", pattern))


class Compiler:
    """Compiles expressions over the columns that ``field`` resolves. ``now`` is epoch seconds, ``zone`` an IANA name."""

    def __init__(self, field, now: float, zone: str = "UTC"):
        self.field, self.now, self.zone = field, now, zone

    # conditions -----------------------------------------------------------------------------------------------------
    def predicate(self, node) -> Column:
        """A three-valued condition."""
        if isinstance(node, Logic):
            parts = [self.predicate(p) for p in node.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if node.op == "and" else out | p
            return out
        if isinstance(node, Not):
            return ~self.predicate(node.arg)
        if isinstance(node, Compare):
            return self.compare(node.op, self.value(node.left), self.value(node.right))
        if isinstance(node, Member):
            v = self.value(node.value)
            out = None
            for o in node.options:
                e = self.compare("=", v, self.value(o))
                out = e if out is None else out | e
            return ~out if node.negated else out
        if is_boolean(node):
            return self.value(node).col
        raise SearchError("SPL_EXPECTED_PREDICATE", "a condition is expected; values aren't taken for truth")

    def compare(self, op: str, a: Value, b: Value) -> Column:
        if "null" in (a.kind, b.kind) or "mv" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        if a.kind == "bool" or b.kind == "bool":
            if a.kind == b.kind and op in ("=", "!="):
                return a.col == b.col if op == "=" else a.col != b.col
            return F.lit(None).cast("boolean")

        def test(x: Column, y: Column) -> Column:
            return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

        plain = {"number", "time"}
        if a.kind in plain and b.kind in plain:
            if a.kind == b.kind == "time":
                return test(a.col.cast("timestamp"), b.col.cast("timestamp"))
            x, y = a.col.cast("double") if a.kind == "number" else a.num, b.col.cast("double") if b.kind == "number" else b.num
            if a.integral and b.integral:
                return test(a.col, b.col)
            return test(x, y) & ~F.isnan(x) & ~F.isnan(y) if op != "!=" else test(x, y) | F.isnan(x) | F.isnan(y)
        for v in (a, b):  # a literal that spells no number makes it a comparison of texts
            if isinstance(v.literal, str) and not re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", v.literal):
                return test(a.txt, b.txt)
        x, y = a.num, b.num
        both = x.isNotNull() & y.isNotNull()
        return F.when(a.col.isNull() | b.col.isNull(), F.lit(None).cast("boolean")).when(both, test(x, y)).otherwise(test(a.txt, b.txt))

    # values ---------------------------------------------------------------------------------------------------------
    def value(self, node) -> Value:
        if isinstance(node, Literal):
            v = node.value
            if v is None:
                return Value(F.lit(None).cast("string"), "null")
            return Value(F.lit(v), "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "number", v, isinstance(v, int))
        if isinstance(node, Field):
            return self.field(node.name)
        if isinstance(node, Negate):
            n = self.value(node.arg)
            return Value(F.lit(0.0) - n.num, "number")
        if isinstance(node, Binary):
            return self._binary(node)
        if isinstance(node, Call):
            return getattr(self, "_" + {"if": "if_", "len": "len_", "round": "round_"}.get(node.name, node.name))(*node.args)
        return Value(self.predicate(node), "bool")

    def _binary(self, node: Binary) -> Value:
        a, b = self.value(node.left), self.value(node.right)
        if node.op == ".":
            return Value(F.concat(a.txt, b.txt), "string")
        x, y = (v.col.cast("double") if v.kind == "number" else v.num for v in (a, b))
        if node.op == "+":
            out = x + y
        elif node.op == "-":
            out = x - y
        elif node.op == "*":
            out = x * y
        elif node.op == "/":
            return Value(F.try_divide(x, y), "number")
        else:
            out = F.try_mod(x, y)
        return Value(out + F.lit(0.0), "number")

    def _same(self, values: list[Value]) -> tuple[list[Column], str, bool]:
        """Columns of one kind for a choice between values; different kinds meet as texts."""
        kinds = {v.kind for v in values if v.kind != "null"}
        if len(kinds) <= 1:
            kind = kinds.pop() if kinds else "null"
            integral = all(v.integral for v in values if v.kind != "null")
            if kind == "number":
                return [F.lit(None).cast("bigint" if integral else "double") if v.kind == "null" else v.col.cast("bigint" if integral else "double") for v in values], kind, integral
            if kind in ("null", "string"):
                return [v.col.cast("string") for v in values], "string" if kind == "string" else "null", False
            like = next(v for v in values if v.kind == kind)
            return [F.when(F.lit(False), like.col) if v.kind == "null" else v.col for v in values], kind, False
        return [v.col if v.kind == "null" else v.txt for v in values], "string", False

    def _if_(self, p, a, b) -> Value:
        (x, y), kind, whole = self._same([self.value(a), self.value(b)])
        return Value(F.when(self.predicate(p), x).otherwise(y), kind, integral=whole)

    def _case(self, *args) -> Value:
        cols, kind, whole = self._same([self.value(a) for a in args[1::2]])
        out = None
        for p, c in zip(args[::2], cols):
            out = F.when(self.predicate(p), c) if out is None else out.when(self.predicate(p), c)
        return Value(out, kind, integral=whole)

    def _coalesce(self, *args) -> Value:
        cols, kind, whole = self._same([self.value(a) for a in args])
        return Value(F.coalesce(*cols), kind, integral=whole)

    def _isnull(self, x) -> Value:
        return Value(self.value(x).col.isNull(), "bool")

    def _isnotnull(self, x) -> Value:
        return Value(self.value(x).col.isNotNull(), "bool")

    def _tonumber(self, x) -> Value:
        return Value(self.value(x).num, "number")

    def _tostring(self, x) -> Value:
        v = self.value(x)
        return Value(F.when(v.col, F.lit("True")).when(~v.col, F.lit("False")) if v.kind == "bool" else v.txt, "string")

    def _text(self, x) -> Column:
        v = self.value(x)
        return v.col if v.kind == "string" else F.lit(None).cast("string") if v.kind in ("mv", "null") else v.txt

    def _lower(self, x) -> Value:
        return Value(F.lower(self._text(x)), "string")

    def _upper(self, x) -> Value:
        return Value(F.upper(self._text(x)), "string")

    def _len_(self, x) -> Value:
        return Value(F.length(self._text(x)).cast("bigint"), "number", integral=True)

    def _substr(self, s, start, length=None) -> Value:
        """Positions count from 1, negative ones from the end; 0 is the place before the first character. A negative
        length takes the characters before the start."""
        text, p = self._text(s), self.value(start).num.cast("bigint")
        n = F.length(text).cast("bigint")
        at = F.when(p < 0, n + p + 1).otherwise(p)  # may lie before the text
        if length is None:
            lo, hi = at, n + 1
        else:
            k = self.value(length).num.cast("bigint")
            lo, hi = F.when(k < 0, at + k).otherwise(at), F.when(k < 0, at).otherwise(at + k)
        lo, hi = F.greatest(lo, F.lit(1)), F.least(hi, n + 1)
        taken = F.substring(text, lo.cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
        return Value(F.when(p.isNull() | text.isNull(), F.lit(None).cast("string")).otherwise(taken), "string")

    def _literal(self, node, name: str) -> str:
        if not (isinstance(node, Literal) and isinstance(node.value, str)):
            raise fail(name, "a quoted text is expected")
        return node.value

    def _replace(self, s, pattern, by) -> Value:
        p = java_pattern(checked_pattern(self._literal(pattern, "replace"), _Token))
        to = re.sub(r"\\(\d)", r"${\1}", self._literal(by, "replace").replace("$", r"\$"))
        return Value(F.regexp_replace(self._text(s), F.lit(p), F.lit(re.sub(r"\$\{(\d)\}", r"$\1", to))), "string")

    def _match(self, s, pattern) -> Value:
        return Value(self._text(s).rlike(java_pattern(checked_pattern(self._literal(pattern, "match"), _Token))), "bool")

    def _like(self, s, pattern) -> Value:
        p = self._literal(pattern, "like")
        return Value(self._text(s).like(re.sub(r"\\(?![%_\\])", r"\\\\", p)), "bool")

    def _round_(self, x, digits=None) -> Value:
        p = 0
        if digits is not None:
            if not (isinstance(digits, Literal) and isinstance(digits.value, int) and 0 <= digits.value <= 18):
                raise fail("round", "a number of digits from 0 to 18 is expected")
            p = digits.value
        n = self.value(x).num
        return Value(F.rint(n * F.lit(10.0**p)) / F.lit(10.0**p), "number")

    def _whole(self, x, up: bool) -> Value:
        # by doubles all along: the built-in functions give 64-bit integers, which would lose the sign of -0
        n = self.value(x).num
        r = F.rint(n)
        return Value(F.when(r < n, r + 1).otherwise(r) if up else F.when(r > n, r - 1).otherwise(r), "number")

    def _ceil(self, x) -> Value:
        return self._whole(x, True)

    def _floor(self, x) -> Value:
        return self._whole(x, False)

    # time -----------------------------------------------------------------------------------------------------------
    def _now(self) -> Value:
        return Value(F.lit(float(self.now)), "number")

    def _stamp(self, x) -> Column:
        """A value as a timestamp: a time, or epoch seconds."""
        v = self.value(x)
        return v.col.cast("timestamp") if v.kind == "time" else F.timestamp_micros(F.round(v.num * F.lit(1e6)).cast("bigint"))

    def _relative_time(self, t, spec) -> Value:
        from tidelog.functions.times import relative_local

        local = F.convert_timezone(F.current_timezone(), F.lit(self.zone), self._stamp(t).cast("timestamp_ntz"))
        moved = relative_local(local, self._literal(spec, "relative_time"))
        back = F.convert_timezone(F.lit(self.zone), F.lit("UTC"), moved).cast("timestamp_ntz")
        return Value(F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), back).cast("timestamp")) / F.lit(1e6), "number")

    def _strftime(self, t, fmt) -> Value:
        from tidelog.functions.times import strftime

        ts = self._stamp(t)
        return Value(strftime(ts, F.convert_timezone(F.current_timezone(), F.lit(self.zone), ts.cast("timestamp_ntz")), self._literal(fmt, "strftime"), self.zone), "string")

    def _strptime(self, s, fmt) -> Value:
        from tidelog.functions.times import strptime

        return Value(strptime(self._text(s), self._literal(fmt, "strptime"), self.zone), "number")

    # multivalues ----------------------------------------------------------------------------------------------------
    def _list(self, x) -> Column:
        """A value as a list; null stays null."""
        v = self.value(x)
        if v.kind == "mv":
            return v.col
        return F.when(v.col.isNotNull(), F.array(v.txt))

    def _mvcount(self, x) -> Value:
        v = self.value(x)
        n = F.size(F.filter(v.col, lambda m: m.isNotNull())) if v.kind == "mv" else F.when(v.col.isNotNull(), F.lit(1))
        return Value(F.nullif(n.cast("bigint"), F.lit(0).cast("bigint")), "number", integral=True)

    def _mvsort(self, x) -> Value:
        return Value(F.array_sort(self._list(x)), "mv")

    def _split(self, s, delim) -> Value:
        d, text = self._literal(delim, "split"), self._text(s)
        if d:
            return Value(F.split(text, re.escape(d) if d.isascii() else "\\Q" + d + "\\E", -1), "mv")
        return Value(F.when(text == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(text, "", -1), lambda c: c != "")), "mv")

    def _mvappend(self, *args) -> Value:
        lists = [F.coalesce(self._list(a), F.array().cast("array<string>")) for a in args]
        missing = None
        for a in args:
            gone = self._list(a).isNull()
            missing = gone if missing is None else missing & gone
        return Value(F.when(~missing, F.concat(*lists)), "mv")

    def _mvdedup(self, x) -> Value:
        return Value(F.array_distinct(self._list(x)), "mv")

    def _mvindex(self, x, i, j=None) -> Value:
        def whole(n) -> int:
            sign = 1
            while isinstance(n, Negate):
                n, sign = n.arg, -sign
            if not (isinstance(n, Literal) and isinstance(n.value, int) and not isinstance(n.value, bool)):
                raise fail("mvindex", "whole numbers are expected")
            return sign * n.value

        items, a = self._list(x), whole(i)
        n = F.size(items)
        if j is None:
            return Value(F.when(items.isNotNull(), F.get(items, F.lit(a) if a >= 0 else n + a)), "string")
        b = whole(j)
        lo, hi = (F.lit(k) if k >= 0 else n + k for k in (a, b))
        good = items.isNotNull() & (lo >= 0) & (lo < n) & (hi >= lo)
        return Value(F.when(good, F.slice(items, F.when(good, lo + 1).otherwise(1), F.when(good, F.least(hi, n - 1) - lo + 1).otherwise(0))), "mv")

    def _mvjoin(self, x, delim) -> Value:
        return Value(F.array_join(self._list(x), self._literal(delim, "mvjoin"), "null"), "string")

    def _mvzip(self, a, b, delim=None) -> Value:
        d = self._literal(delim, "mvzip") if delim is not None else ","
        x, y = self._list(a), self._list(b)
        n = F.least(F.size(x), F.size(y))
        pairs = F.zip_with(F.slice(x, F.lit(1), F.greatest(n, F.lit(0))), F.slice(y, F.lit(1), F.greatest(n, F.lit(0))), lambda p, q: F.concat(F.coalesce(p, F.lit("null")), F.lit(d), F.coalesce(q, F.lit("null"))))
        return Value(F.when(x.isNotNull() & y.isNotNull(), pairs), "mv")

    def _mvfind(self, x, pattern) -> Value:
        p = java_pattern(checked_pattern(self._literal(pattern, "mvfind"), _Token))
        at = F.array_position(F.transform(self._list(x), lambda m: F.coalesce(m, F.lit("null")).rlike(p)), F.lit(True))
        return Value(F.nullif(at.cast("bigint"), F.lit(0).cast("bigint")) - 1, "number", integral=True)


__all__ = ["Compiler", "Value", "java_pattern", "number_text"]
