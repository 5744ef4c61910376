"""Reusable knowledge about fields, applied before a search's base predicate.

Stages run in a fixed order - extractions, aliases, calculated fields, automatic lookups - and each stage sees what the
one before it completed, never its own siblings; so every stage is one projection.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.scalars import java_pattern
from tidelog.functions.values import parsed_whole
from tidelog.operators.multivalue import leaf
from tidelog.plans.errors import SearchError
from tidelog.plans.parser import _TOKEN, Cursor, Expressions
from tidelog.plans.relation import Relation

#: Fixed value: stages of automatic lookups.
MAX_LOOKUPS = 16
SCOPES = ("private", "app", "global")


@dataclass(frozen=True)
class Selector:
    """For which events an object holds: every named dimension has to fit one of its patterns (``*``, ``?`` and ``\\``)."""

    index: tuple[str, ...] = ()
    host: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    sourcetype: tuple[str, ...] = ()

    def column(self, rel: Relation) -> Column | None:
        out = None
        for name in ("index", "host", "source", "sourcetype"):
            patterns = getattr(self, name)
            if patterns:
                value = rel.field(name)
                hit = F.coalesce(value.txt.rlike("(?s)^(?:" + "|".join(map(glob_pattern, patterns)) + ")\\z"), F.lit(False))
                out = hit if out is None else out & hit
        return out

    def possible(self, indexes: Sequence[str]) -> bool:
        """Whether it can hold for any of these indexes."""
        return not self.index or any(re.fullmatch(glob_pattern(p), i, re.S) for p in self.index for i in indexes)


def glob_pattern(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += {"*": ".*", "?": "."}.get(glob[i], re.escape(glob[i]))
        i += 1
    return out


@dataclass(frozen=True)
class Knowledge:
    """One object. ``kind`` is extract, json, alias, calc or lookup; ``spec`` is its kind's content:
    extract {pattern}, json {path, output}, alias {source, target}, calc {target, expression},
    lookup {table, keys, outputs, new}. ``overwrite`` says whether present values are replaced."""

    kind: str
    name: str
    spec: dict
    selector: Selector = field(default_factory=Selector)
    scope: str = "global"
    overwrite: bool = True


def resolve(objects: Sequence[Knowledge], indexes: Sequence[str]) -> list[Knowledge]:
    """Of objects with one kind and name the first in scope (private, app, global) wins whole; those whose selector
    can't hold for the searched indexes go first."""
    best: dict[tuple[str, str], Knowledge] = {}
    for o in objects:
        if not o.selector.possible(indexes):
            continue
        key = (o.kind, o.name)
        if key not in best or SCOPES.index(o.scope) < SCOPES.index(best[key].scope):
            best[key] = o
    return sorted(best.values(), key=lambda o: o.name)


def _put(rel: Relation, o: Knowledge, target: str, value: Column, found: Column) -> Column:
    old = rel.field(target)
    before = F.lit(None).cast("string") if old.kind == "null" else old.txt
    applies = found if (gate := o.selector.column(rel)) is None else gate & found
    if not o.overwrite:
        applies = applies & before.isNull()
    return F.when(applies, value).otherwise(before)


def _stage(rel: Relation, objects: Sequence[Knowledge], make) -> Relation:
    out: dict[str, Column] = {}
    for o in objects:
        for target, value in make(o).items():
            if target in out:
                raise SearchError("SPL_AMBIGUOUS_KNOWLEDGE_FIELD", f"two objects of one stage write {target}")
            out[target] = value
    return rel.set(out)


def apply(rel: Relation, objects: Sequence[Knowledge]) -> Relation:
    """The relation with all stages applied."""
    of = lambda *kinds: [o for o in objects if o.kind in kinds]

    def extract(o: Knowledge) -> dict[str, Column]:
        if o.kind == "json":
            value = F.try_variant_get(parsed_whole(rel.field("_raw").txt), "$." + o.spec["path"], "variant")
            if not o.spec.get("strict"):  # an object or array is no value, or fails the search, as the definition says
                value = F.when(~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), value)
            return {o.spec["output"]: _put(rel, o, o.spec["output"], leaf(value), value.isNotNull())}
        pattern = java_pattern(o.spec["pattern"])
        names = [m[1] for m in re.finditer(r"\\.|\(\?<([A-Za-z_]\w*)>|\((?!\?)", pattern) if not m[0].startswith("\\")]
        plain = re.sub(r"\(\?<[A-Za-z_]\w*>", "(", pattern)
        text = rel.field("_raw").txt
        return {n: _put(rel, o, n, F.regexp_extract(text, plain, i + 1), text.rlike(plain)) for i, n in enumerate(names) if n}

    rel = _stage(rel, of("extract", "json"), extract)
    rel = _stage(rel, of("alias"), lambda o: {o.spec["target"]: _put(rel, o, o.spec["target"], rel.field(o.spec["source"]).txt.cast("string"), rel.field(o.spec["source"]).col.isNotNull())})

    def calc(o: Knowledge) -> dict[str, Column]:
        c = Cursor(o.spec["expression"], 0, _TOKEN, "eval")
        node = Expressions(c).predicate()
        c.finish()
        v = rel.compiler.value(node)
        gate = o.selector.column(rel)
        if gate is None and o.overwrite:
            return {o.spec["target"]: v.col}
        return {o.spec["target"]: _put(rel, o, o.spec["target"], v.txt, F.lit(True))}

    rel = _stage(rel, of("calc"), calc)
    from tidelog.operators.lookups import attach

    automatic = of("lookup")
    if len(automatic) > MAX_LOOKUPS:
        raise SearchError("SPL_QUERY_TOO_COMPLEX", "too many automatic lookups")
    written: set[str] = set()
    for o in automatic:
        if written & {f for _, f in o.spec["keys"]}:
            raise SearchError("SPL_AMBIGUOUS_LOOKUP_FIELD", "an automatic lookup can't read what another wrote")
        rel = attach(rel, rel.ctx.lookups[o.spec["table"]], o.spec["keys"], o.spec["outputs"], o.spec.get("new", False), o.selector.column(rel))
        written |= {d for _, d in o.spec["outputs"]}
    return rel
