"""Values as a search sees them: numbers in texts, canonical texts, and one order over both.

Every column of a relation has a kind, taken from its Spark type: number, string, bool, time, mv (a list of texts)
or null. Texts are dynamic: one that spells a finite number counts as that number where a number is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.common import PRIVATE

#: Fixed value: what a text has to look like to count as a number.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


_END = PRIVATE + "end"


def parsed_whole(text: Column) -> Column:
    """A JSON text as a variant; null if it is none or has anything behind its value, which the parser by itself lets pass."""
    both = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(f',"{_END}":1}}')))
    return F.when(F.variant_get(both, f"$.{_END}", "int") == 1, F.variant_get(both, "$.v", "variant"))


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.ArrayType):
        return "mv"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    if isinstance(dtype, T.NullType):
        return "null"
    return "string"


def num(c: Column, kind: str) -> Column:
    """The double that a value counts as, else null. Times count as epoch seconds; flags, lists and non-finite
    numbers don't count."""
    if kind == "number":
        d = c.cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)
    if kind == "time":
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    if kind == "string":
        return F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.lit(None).cast("double")


def number_text(c: Column) -> Column:
    """A number's canonical text: whole ones without a fraction, others in their shortest form."""
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    return F.when(whole, F.when(whole, d).cast("decimal(20,0)").cast("string")).otherwise(d.cast("string"))


def txt(c: Column, kind: str, integral: bool = False) -> Column:
    """A value's canonical text: numbers plainly, flags as true and false, times as epoch seconds, lists by lines."""
    if kind == "number":
        return c.cast("string") if integral else number_text(c)
    if kind == "bool":
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    if kind == "time":
        return number_text(num(c, "time"))
    if kind == "mv":
        return F.array_join(c, "\n", "null")
    return c.cast("string")


def order_key(c: Column, kind: str) -> list[Column]:
    """Columns that put mixed values in order when sorted in turn: numbers first by value, then texts bytewise; null
    values are null in every one of them."""
    if kind in ("number", "bool", "time"):
        return [c]
    if kind == "mv":
        return [txt(c, kind)]
    n = num(c, kind)
    return [F.when(c.isNotNull(), n.isNull()), n, F.when(n.isNull(), c.cast("string"))]


def mixed_struct(c: Column, kind: str, text: Column) -> Column:
    """One comparable struct for least and greatest: (is text, number, text), null for null values."""
    n = num(c, kind)
    return F.when(c.isNotNull(), F.struct(n.isNull().alias("t"), n.alias("n"), F.when(n.isNull(), text).alias("s"), text.alias("v")))
