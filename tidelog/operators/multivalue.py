"""Lists: making them from texts and JSON, and expanding rows by them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, rows_at_most
from tidelog.functions.values import parsed_whole
from tidelog.plans.errors import DataError, SearchError
from tidelog.plans.nodes import Command
from tidelog.plans.relation import Order, Relation

#: Members of one list; rows of one expansion in a session with ceilings.
MEMBERS, EXPANDED = 1000, 10_000


def _capped(items: Column) -> Column:
    return F.when(F.size(items) > MEMBERS, F.raise_error(F.lit(f"a list has more than {MEMBERS} members"))).otherwise(items)


def makemv(rel: Relation, c: Command) -> Relation:
    v = rel.field(c["field"])
    if v.kind not in ("string", "null"):
        raise SearchError("SPL_UNSUPPORTED_MAKEMV_SYNTAX", "makemv needs a text", c.start, c.end)
    items = F.split(v.col, "\\Q" + c["delim"].replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    if not c["allowempty"]:
        items = F.filter(items, lambda x: x != "")
    return rel.set({c["field"]: _capped(items)})


def mvexpand(rel: Relation, c: Command) -> Relation:
    """A row per member in order; null gives one row with null, an empty list none."""
    v = rel.field(c["field"])
    if v.kind != "mv":
        return rel.set({c["field"]: v.col})
    made, rel = rel.fresh("p")
    items = F.slice(v.col, 1, c["limit"]) if c["limit"] else v.col
    items = F.when(v.col.isNull(), F.array(F.lit(None).cast("string"))).otherwise(items)
    names = [n for n in rel.df.columns if n != c["field"]]
    df = rel.df.select(*[F.col(f"`{n}`") for n in names], F.posexplode(items).alias(made, c["field"]))
    if rel.ctx.ceilings and not rows_at_most(df, EXPANDED):
        raise DataError(f"mvexpand gives more than {EXPANDED} rows")
    order = [n for n in rel.df.columns] if c["field"] in rel.df.columns else [*names, c["field"]]
    return rel.with_(df=df.select(*[F.col(f"`{n}`") for n in order], made), order=(*rel.order, Order(made)), flat=rel.flat - {c["field"]})


def leaf(found: Column) -> Column:
    """A scalar of a JSON document as text, an explicit null as null. Objects and arrays fail the search."""
    inner = F.schema_of_variant(found).rlike("^(OBJECT|ARRAY)")
    return F.when(inner, F.raise_error(F.lit("spath reaches an object or an array"))).otherwise(found.cast("string"))


def spath(rel: Relation, c: Command) -> Relation:
    """A value from JSON text by path; without a match the output keeps what it had.

    With ``{}`` in the path, a list of all members, depth first: missing keys and what isn't an array are passed over,
    explicit nulls stay, a matched empty array is an empty list, and an output that is no list can't be kept. A path
    that ends at an object, or with ``{}`` at a nested array, fails the search rather than giving part of a list.
    """
    text, path = rel.field(c["input"]).txt, c["path"]
    steps = re.findall(r"([\w@$-]+)|\{(\d*)\}", path)
    old, document = rel.field(c["output"]), parsed_whole(text)
    if "{}" not in path:
        found = F.try_variant_get(document, "$" + "".join(f"['{name}']" if name else f"[{index}]" for name, index in steps), "variant")
        return rel.set({c["output"]: F.when(found.isNotNull(), leaf(found)).otherwise(F.lit(None).cast("string") if old.kind == "null" else old.txt)})
    items, run = F.array(document), ""

    def down(kind: str) -> Column:
        return F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$" + run, kind)), lambda x: x.isNotNull())

    for name, index in steps:
        if name or index:
            run += f"['{name}']" if name else f"[{index}]"
        else:
            lists = down("array<variant>")
            items, run = F.flatten(lists), ""
    found = down("variant") if run else items
    hit = (F.size(found) > 0) if run else F.size(lists) > 0
    before = old.col if old.kind == "mv" else F.lit(None).cast("array<string>")
    if old.kind not in ("mv", "null"):
        before = F.when(old.col.isNotNull(), F.raise_error(F.lit("spath can't put a list beside the output's single values"))).otherwise(before)
    return rel.set({c["output"]: F.when(hit, F.transform(_capped(found), leaf)).otherwise(before)})


__all__ = ["PRIVATE", "makemv"]
