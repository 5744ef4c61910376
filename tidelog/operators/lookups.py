"""Enrichment from small immutable tables by exact text keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, ident, rows_at_most
from tidelog.plans.errors import DataError, SearchError
from tidelog.plans.nodes import Command
from tidelog.plans.relation import Relation

#: Rows, columns and key columns of a lookup table.
ROWS, COLUMNS, KEYS = 100_000, 64, 4


@dataclass(frozen=True)
class Lookup:
    """A table of text cells whose key columns are unique together."""

    name: str
    df: DataFrame
    keys: tuple[str, ...]


def make_lookup(name: str, df: DataFrame, keys: list[str] | tuple[str, ...]) -> Lookup:
    """A lookup from any table; its cells become texts. Its size is checked here, which is what lets it be broadcast."""
    if not 1 <= len(keys) <= KEYS or len(df.columns) > COLUMNS:
        raise DataError(f"a lookup has 1 to {KEYS} keys and at most {COLUMNS} columns")
    texts = df.select(*[ident(c).cast("string").alias(c) for c in df.columns])
    if not rows_at_most(texts, ROWS):
        raise DataError(f"lookup {name} has more than {ROWS} rows")
    if texts.groupBy(*[ident(k) for k in keys]).count().where("count > 1").limit(1).count():
        raise DataError(f"lookup {name} has a key twice")
    return Lookup(name, texts, tuple(keys))


def attach(rel: Relation, table: Lookup, keys, outs, new: bool, gate: Column | None = None) -> Relation:
    """Left join that never changes the rows: at most one match a key. ``gate`` says for which rows it applies."""
    names = {k: f"{PRIVATE}lk{i}" for i, (k, _) in enumerate(keys)} | {o: f"{PRIVATE}lo{i}" for i, (o, _) in enumerate(outs) if o not in dict(keys)}
    right = table.df.select(*[ident(c).alias(n) for c, n in names.items()], F.lit(True).alias(PRIVATE + "hit"))
    made = {f"{PRIVATE}lf{i}": (v.col if (v := rel.field(f)).kind == "string" else F.lit(None).cast("string")) for i, (_, f) in enumerate(keys)}
    base = rel.set(made)
    cond = gate if gate is not None else F.lit(True)
    for i in range(len(keys)):
        cond = cond & (F.col(f"{PRIVATE}lf{i}") == F.col(f"{PRIVATE}lk{i}"))
    joined = rel.with_(df=base.df.join(F.broadcast(right), cond, "left"))  # its rows were counted in make_lookup
    out = {}
    for o, dest in outs:
        old = rel.field(dest)
        text = F.lit(None).cast("string") if old.kind == "null" else old.txt if old.kind != "mv" or not new else old.col
        found = F.col(names[o])
        if new:
            out[dest] = F.coalesce(old.col, F.when(F.col(PRIVATE + "hit"), found)) if old.kind == "string" else F.when(F.col(PRIVATE + "hit"), found) if old.kind == "null" else F.coalesce(old.txt, F.when(F.col(PRIVATE + "hit"), found))
        else:
            out[dest] = F.when(F.col(PRIVATE + "hit"), found).otherwise(text)
    done = joined.set(out)
    return done.with_(df=done.df.drop(*names.values(), *made, PRIVATE + "hit"))


def lookup(rel: Relation, c: Command) -> Relation:
    table = (rel.ctx.lookups or {}).get(c["name"])
    if table is None:
        raise SearchError("SPL_UNKNOWN_LOOKUP", f"there is no lookup {c['name']}", c.start, c.end)
    missing = {k for k, _ in c["keys"]} | {o for o, _ in c["outs"]}
    missing -= set(table.df.columns)
    if missing or set(table.keys) != {k for k, _ in c["keys"]}:
        raise SearchError("SPL_UNSUPPORTED_LOOKUP_SYNTAX", "the lookup's keys and columns don't fit", c.start, c.end)
    return attach(rel, table, c["keys"], c["outs"], c["new"])
