"""From a search's text to a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, ident
from tidelog.functions.ranges import resolve_range
from tidelog.operators import charts, grouping, lookups, multivalue, ordering, rows
from tidelog.plans import knowledge
from tidelog.plans.errors import SearchError
from tidelog.plans.nodes import Call, Command, Field, FieldTest, Logic, Measure, Not, Search
from tidelog.plans.parser import parse
from tidelog.plans.relation import KEY, TIME, Context, Order, Relation
from tidelog.sources.catalog import Catalog, prune

#: Every command's lowering: from a relation to a relation.
LOWERING = {
    "search": rows.search, "where": rows.where, "eval": rows.eval_, "regex": rows.regex, "rex": rows.rex, "fields": rows.fields, "table": rows.table, "rename": rows.rename,
    "fillnull": rows.fillnull, "addtotals": rows.addtotals, "strcat": rows.strcat, "addinfo": rows.addinfo, "bin": rows.bin_, "nomv": rows.nomv, "sort": ordering.sort, "head": ordering.head,
    "tail": ordering.tail, "reverse": ordering.reverse, "dedup": ordering.dedup, "accum": ordering.accum, "delta": ordering.delta, "streamstats": ordering.streamstats, "stats": grouping.stats,
    "eventstats": grouping.eventstats, "top": grouping.top, "rare": grouping.rare, "timechart": charts.timechart, "chart": charts.chart, "makemv": multivalue.makemv, "mvexpand": multivalue.mvexpand,
    "spath": multivalue.spath, "lookup": lookups.lookup,
}
#: Commands that end the events, and those that end them in a series over time.
TRANSFORMING, TIMED = {"stats", "top", "rare", "chart", "table"}, {"timechart"}


@dataclass(frozen=True)
class Plan:
    """What a search is going to do, known without touching data."""

    search: Search
    indexes: tuple[str, ...]
    result_kind: str
    fields: tuple[str, ...]
    stages: tuple[str, ...]


def result_kind(commands: Sequence[Command]) -> str:
    """events, statistics or time-series: what the last command that changes it makes of the result."""
    kind = "events"
    for c in commands:
        if c.name in TIMED:
            kind = "time-series"
        elif c.name in TRANSFORMING:
            kind = "statistics"
        elif c.name not in LOWERING:
            return "invalid"
    return kind


def index_scope(node, names: Sequence[str], shared: Sequence[str] = ()) -> list[str]:
    """The bindings that a base predicate can match: an AND narrows, an OR widens, a negation tells nothing. A name
    that isn't a binding's may be an index inside one of the ``shared`` tables."""
    if isinstance(node, FieldTest) and node.field == "index" and node.op == "=":
        return prune(names, [node.value]) or list(shared)
    if isinstance(node, Logic):
        scopes = [index_scope(p, names, shared) for p in node.parts]
        if node.op == "or":
            return [n for n in names if any(n in s for s in scopes)]
        return [n for n in names if all(n in s for s in scopes)]
    return list(names)


def referenced(node) -> set[str]:
    """The fields that a part of a search reads."""
    if isinstance(node, Field):
        return {node.name}
    if isinstance(node, FieldTest):
        return {node.field}
    if isinstance(node, Measure):
        return referenced(node.arg)
    if isinstance(node, Logic | Call | Not) or hasattr(node, "__dataclass_fields__"):
        return set().union(*[referenced(getattr(node, f)) for f in node.__dataclass_fields__]) if hasattr(node, "__dataclass_fields__") else set()
    if isinstance(node, list | tuple):
        return set().union(set(), *[referenced(x) for x in node])
    return set()


def reads(c: Command) -> set[str]:
    """The fields that a command names."""
    names = referenced(tuple(c.args.values()))
    for key in ("by", "names", "field", "row", "col", "input"):
        value = c.args.get(key) or ()
        names |= {value} if isinstance(value, str) else {x for x in value if isinstance(x, str)}
    return names


class Session:
    """Searches over a catalog of indexes, with lookups and knowledge objects."""

    def __init__(self, spark: SparkSession, catalog: Catalog, *, zone: str = "UTC", default_index: str | None = None, ceilings: bool = False):
        """With ``ceilings``, aggregates and expansions of more than interactive size fail; without, only those that are
        part of a command's definition do, and everything else grows with the data."""
        self.spark, self.catalog, self.zone, self.default_index, self.ceilings = spark, catalog, zone, default_index, ceilings
        self.lookups: dict[str, lookups.Lookup] = {}
        self.knowledge: list[knowledge.Knowledge] = []

    def add_lookup(self, name: str, df: DataFrame, keys: Sequence[str]) -> None:
        self.lookups[name] = lookups.make_lookup(name, df, list(keys))

    def add_knowledge(self, *objects: knowledge.Knowledge) -> None:
        self.knowledge += objects

    def plan(self, source: str) -> Plan:
        """Parses and checks a search; raises ``SearchError``."""
        parsed = parse(source)
        indexes = index_scope(parsed.base, self.catalog.names(), [n for n, b in self.catalog.bindings.items() if b.by_index_column]) if parsed.base is not None else self.catalog.names()
        names = referenced(parsed.base)
        for c in parsed.commands:
            names |= reads(c)
        return Plan(parsed, tuple(indexes), result_kind(parsed.commands), tuple(sorted(names)), ("scan", *(["filter"] if parsed.base is not None else []), *[c.name for c in parsed.commands]))

    def validate(self, source: str) -> dict:
        """The predicted shape of a search's result, or what is wrong with it; reads no data."""
        try:
            p = self.plan(source)
        except SearchError as e:
            return {"ok": False, "code": e.code, "message": e.message, "start": e.start, "end": e.end}
        return {"ok": True, "result_kind": p.result_kind, "fields": list(p.fields), "indexes": list(p.indexes), "stages": list(p.stages)}

    def relation(
        self, source: str, earliest: str | None = None, latest: str | None = None, *, now: float | None = None, sid: str = "search", tenant: str | None = None,
        indexed_until: float | None = None, visible_until: int | None = None, upto: int | None = None,
    ) -> Relation:
        """The relation at the end of a search, or after its first ``upto`` commands."""
        now = time.time() if now is None else now
        p = self.plan(source)
        lo, hi = resolve_range(earliest, latest, now, self.zone)
        ctx = Context(now, self.zone, lo, hi, sid, self.lookups, self.ceilings)
        scoped = p.indexes
        if len(scoped) == len(self.catalog.bindings) and self.default_index:
            scoped = (self.default_index,)
        if not scoped:
            raise SearchError("SPL_UNKNOWN_INDEX", "no index fits the search")
        frames = [self.catalog.scan(self.spark, n, earliest=lo, latest=hi, tenant=tenant, indexed_until=indexed_until, visible_until=visible_until, now=now) for n in scoped]
        df = frames[0]
        for other in frames[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        bindings = [self.catalog.bindings[n] for n in scoped]
        order = (Order(TIME, True), Order(KEY, True)) if any(b.time for b in bindings) else (Order(KEY, True),)
        rel = Relation(df, order, ctx, json_root=bindings[0].json if len({b.json for b in bindings}) == 1 else None)
        rel = knowledge.apply(rel, knowledge.resolve(self.knowledge, scoped))
        if p.search.base is not None:
            rel = rel.with_(df=rel.df.where(rows.search_predicate(rel, p.search.base)))
        for c in p.search.commands[:upto]:
            rel = LOWERING[c.name](rel, c)
        return rel

    def search(self, source: str, earliest: str | None = None, latest: str | None = None, *, ordered: bool = True, flat: bool = False, **options) -> DataFrame:
        """The result of a search. With ``ordered`` it is sorted in its established order; ``flat`` shows lists that
        ``nomv`` marked as lines of text."""
        rel = self.relation(source, earliest, latest, **options)
        df = rel.df.orderBy(*rel.sort_exprs()) if ordered and rel.order else rel.df
        cols = [F.array_join(ident(c), "\n", "null").alias(c) if flat and c in rel.flat else ident(c) for c in rel.public]
        return df.select(*cols)

    def explain(self, source: str, *args, **options) -> str:
        """The formatted physical plan of a search."""
        df = self.search(source, *args, **options)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


__all__ = ["PRIVATE", "Session"]
