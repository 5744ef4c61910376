"""What else can be asked about a search: its timeline, its fields, a field's values, and completions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, div, ident, rows_at_most
from tidelog.plans.engine import LOWERING, Session, reads, referenced
from tidelog.plans.errors import DataError, SearchError
from tidelog.plans.parser import ALIASES, COMMANDS, FUNCTIONS, PLAIN_AGGREGATES
from tidelog.plans.relation import TIME, Relation

#: Slots of a timeline by default and at most, and the digits with which their lengths in seconds begin.
DEFAULT_SLOTS, MOST_SLOTS, NICE = 100, 1000, (1, 2, 5)
#: Fields of a catalog; values that a summary shows, that it may find, and their bytes. Beyond them it fails.
CATALOG_FIELDS, SUMMARY_VALUES, SUMMARY_DIFFERENT, SUMMARY_BYTES = 10_000, 100, 10_000, 256 * 1024


def timeline(session: Session, source: str, earliest: str, latest: str, *, slots: int = DEFAULT_SLOTS, **options) -> DataFrame:
    """Events per slot over the whole range, slots without events included: ``slot_start, slot_end, n, is_partial``.

    Slots are 1, 2 or 5 times a power of ten seconds long, as short as ``slots`` of them allow. Only searches whose result is
    events have a timeline.
    """
    if not 1 <= slots <= MOST_SLOTS:
        raise SearchError("SPL_INVALID_TIMELINE", f"1 to {MOST_SLOTS} slots are expected")
    if session.plan(source).result_kind != "events":
        raise SearchError("SPL_INVALID_TIMELINE", "the search doesn't end in events")
    rel = session.relation(source, earliest, latest, **options)
    lo, hi = rel.ctx.earliest, rel.ctx.latest
    if lo is None or hi is None:
        raise SearchError("SPL_INVALID_TIMELINE", "a timeline needs a closed range")
    span = next((s for s in (d * 10**e for e in range(11) for d in NICE) if math.ceil(hi / s) - math.floor(lo / s) <= slots), None)
    if span is None:
        raise SearchError("SPL_INVALID_TIMELINE", f"the range doesn't fit into {slots} slots")
    first, last = math.floor(lo / span) * span, math.ceil(hi / span) * span
    us = F.unix_micros(F.col(TIME).cast("timestamp"))
    counts = rel.df.groupBy(div(us - F.pmod(us, F.lit(span * 1_000_000)), F.lit(1_000_000)).alias(PRIVATE + "at")).agg(F.count(F.lit(1)).alias(PRIVATE + "n"))
    grid = session.spark.range(first, last, span)
    return grid.join(F.broadcast(counts), F.col("id") == F.col(PRIVATE + "at"), "left").select(  # one row per slot
        F.col("id").alias("slot_start"), (F.col("id") + span).alias("slot_end"), F.coalesce(PRIVATE + "n", F.lit(0)).alias("n"),
        ((F.col("id") < F.lit(lo)) | (F.col("id") + span > F.lit(hi))).alias("is_partial"),
    )


def _json_fields(rel: Relation) -> DataFrame | None:
    """A row per event and field of its JSON: ``field`` and the value's ``type``, which tells an explicit null from others."""
    root = rel.json_root
    if root is None or rel.closed or root not in rel.df.columns:
        return None
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    names = {"VOID": "null", "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "bool", "OBJECT": "object", "ARRAY": "list"}
    typed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), kind), F.lit("null"))
    return rel.df.select(F.explode(F.from_json(ident(root), "map<string, variant>")).alias("field", "v")).select("field", typed.alias("type"))


def field_catalog(session: Session, source: str, *args, **options) -> DataFrame:
    """Per field of the result: ``field, kind, types, n_events, n_present, n_null, n_missing``; fields inside the events'
    JSON too, with the types observed and an explicit null apart from a missing field (a column's nulls count as null).

    Columns are counted in one pass over the data, whatever their number. More than ``CATALOG_FIELDS`` fields are an error.
    """
    rel = session.relation(source, *args, **options)
    names = rel.public
    inner = _json_fields(rel)
    found = inner.where(~F.col("field").isin(names)) if inner is not None else None
    if len(names) > CATALOG_FIELDS or (found is not None and not rows_at_most(found.select("field").distinct(), CATALOG_FIELDS - len(names))):
        raise DataError(f"there are more than {CATALOG_FIELDS} fields")
    counts = rel.df.agg(F.count(F.lit(1)).alias(PRIVATE + "all"), *[F.count(ident(n)).alias(f"{PRIVATE}n{i}") for i, n in enumerate(names)])
    rows = counts.select(PRIVATE + "all", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(rel.kind(n)).alias("kind"), F.col(f"{PRIVATE}n{i}").alias("n")) for i, n in enumerate(names)])).alias("x"))
    out = rows.select("x.field", "x.kind", F.when(F.col("x.n") > 0, F.col("x.kind")).otherwise("").alias("types"), F.col(PRIVATE + "all").alias("n_events"), F.col("x.n").alias("n_present"), (F.col(PRIVATE + "all") - F.col("x.n")).alias("n_null"), F.lit(0).cast("long").alias("n_missing"))
    if found is not None:
        types = F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type")))), ",")  # of a handful
        per = found.groupBy("field").agg(F.count(F.lit(1)).alias("p"), F.count_if(F.col("type") == "null").alias("z"), types.alias("types"))
        every = F.col(PRIVATE + "all")
        out = out.unionAll(per.crossJoin(F.broadcast(counts.select(every))).select("field", F.lit("dynamic"), "types", every, F.col("p") - F.col("z"), "z", every - F.col("p")))  # one row
    return out


def field_summary(session: Session, source: str, field: str, *args, values: int = SUMMARY_VALUES, **options) -> DataFrame:
    """The commonest values of a field: ``value, n, percent`` of the events that have it. A field with more than
    ``SUMMARY_DIFFERENT`` different values, or with one of more than ``SUMMARY_BYTES``, has no summary: it is an error."""
    if not 1 <= values <= SUMMARY_VALUES:
        raise SearchError("SPL_INVALID_FIELD_SUMMARY", f"1 to {SUMMARY_VALUES} values are expected")
    rel = session.relation(source, *args, **options)
    v = rel.field(field)
    rows = rel.df.select((F.explode(v.col) if v.kind == "mv" else v.txt.cast("string")).alias("value")).where("value is not null")
    rows = rows.select(F.when(F.octet_length("value") > SUMMARY_BYTES, F.raise_error(F.lit("a value is too long for a summary"))).otherwise(F.col("value")).alias("value"))
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if not rows_at_most(counts, SUMMARY_DIFFERENT):
        raise DataError(f"{field} has more than {SUMMARY_DIFFERENT} different values")
    total = counts.agg(F.sum("n").alias("all"))
    return counts.orderBy(F.desc("n"), "value").limit(values).crossJoin(F.broadcast(total)).select("value", "n", (100.0 * F.col("n") / F.col("all")).alias("percent"))  # one row


def suggestions(session: Session, text: str, limit: int = 20) -> list[dict]:
    """Completions for the end of a search being written: commands after a bar, functions and fields elsewhere, and
    indexes after ``index=``. Prefix matches come first, in order of kind and name."""
    import re

    stage = re.split(r"\|", text)[-1]
    word = re.search(r"[\w.:@-]*$", stage)[0]
    before = stage[: len(stage) - len(word)]
    if before.rstrip().endswith("index="):
        pool = [("index", n) for n in session.catalog.names()]
    elif "|" in text and not before.strip():
        pool = [("command", n) for n in COMMANDS]
    else:
        names: list[str] = []
        if session.default_index:
            names = [c for c in session.catalog.scan(session.spark, session.default_index).columns if not c.startswith(PRIVATE)]
        pool = [("field", n) for n in names]
        if "|" in text:
            pool += [("function", n) for n in (*FUNCTIONS, *PLAIN_AGGREGATES, *ALIASES)]
    low = word.lower()
    seen = dict.fromkeys(pool)
    ranked = sorted((not n.lower().startswith(low), k, n) for k, n in seen if low in n.lower())
    return [{"kind": k, "text": n} for _, k, n in ranked[:limit]]


def read_statistics(session: Session, source: str, *args, **options) -> dict:
    """What a search reads and gives: ``files`` and ``bytes`` of its scan as planned, ``matched_events`` and
    ``produced_rows`` as counted by running it."""
    matched, whole = session.relation(source, *args, upto=0, **options), session.relation(source, *args, **options)
    seen = Observation()
    got = matched.df.observe(seen, F.count(F.lit(1)).alias("n"))
    got.write.format("noop").mode("overwrite").save()
    scans = [session.catalog.bindings[n].read(session.spark) for n in session.plan(source).indexes]
    size = sum(int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in scans)
    return {"files": sum(len(x.inputFiles()) for x in scans), "bytes": size, "matched_events": seen.get["n"], "produced_rows": whole.df.count()}


def inspect(session: Session, source: str) -> list[dict]:
    """The stages of a search without its literals: what runs, and which fields it reads."""
    p = session.plan(source)
    out = [{"stage": "scan", "reads": list(p.indexes)}]
    if p.search.base is not None:
        out.append({"stage": "filter", "reads": sorted(referenced(p.search.base))})
    return out + [{"stage": c.name, "reads": sorted(reads(c))} for c in p.search.commands if c.name in LOWERING]
