"""timechart and chart: aggregates on a grid of time or rows, split into series."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, div, ident, rows_at_most
from tidelog.functions.values import order_key
from tidelog.operators.grouping import aggregate
from tidelog.operators.rows import SECONDS
from tidelog.plans.errors import DataError, SearchError
from tidelog.plans.nodes import Command, Measure
from tidelog.plans.relation import TIME, Order, Relation

#: Series beside NULL and OTHER, rows of a chart, slots of a time chart, bytes of a label.
SERIES, ROWS, SLOTS, LABEL_BYTES = 10, 10_000, 10_000, 256
NULL, OTHER = "NULL", "OTHER"
_AXIS, _LABEL, _VALUE = PRIVATE + "axis", PRIVATE + "label", PRIVATE + "cell"


def _counts(m: Measure) -> bool:
    return m.func == "count"


def _labels(rel: Relation, m: Measure) -> tuple[list[str], bool, bool]:
    """The names of the series to show, whether some rows have none, and whether others are left over. At most
    SERIES + 2 rows reach the driver."""
    cells = aggregate(rel, [replace(m, alias=_VALUE)], [_AXIS, _LABEL])
    score = F.sum(F.coalesce(F.col(_VALUE).cast("double"), F.lit(0.0)))
    scores = cells.groupBy(_LABEL).agg(score.alias("s"))
    rank = F.when(F.isnan("s"), F.lit(None)).otherwise(F.col("s"))
    best = scores.where(F.col(_LABEL).isNotNull()).orderBy(rank.desc_nulls_last(), F.col(_LABEL)).limit(SERIES + 1).collect()
    nulls = bool(rel.df.where(F.col(_LABEL).isNull()).limit(1).count())
    names = [r[0] for r in best[:SERIES]]
    for n in names:
        if n in ("", NULL, OTHER) or len(n.encode()) > LABEL_BYTES:
            raise DataError(f"a series can't be named {n[:40]!r}")
    return sorted(names, key=lambda x: x.encode()), nulls, len(best) > SERIES


def _split(rel: Relation, m: Measure) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Cells with a column per series, from the raw rows relabelled, so what is merged into OTHER is merged exactly."""
    names, nulls, more = _labels(rel, m)
    label = F.when(F.col(_LABEL).isNull(), F.lit(NULL)).when(F.col(_LABEL).isin(names), F.concat(F.lit("="), F.col(_LABEL))).otherwise(F.lit(OTHER))
    cells = aggregate(rel.set({_LABEL: label}), [replace(m, alias=_VALUE)], [_AXIS, _LABEL])
    shown = ["=" + n for n in names] + [NULL] * nulls + [OTHER] * more
    wide = cells.groupBy(_AXIS).pivot(_LABEL, shown).agg(F.first(_VALUE)) if shown else cells.select(_AXIS).distinct()
    public = [(s, ("VALUE_" if s[1:].startswith("_") else "") + s[1:] if s.startswith("=") else s) for s in shown]
    return wide, public


def _cell(c: Column, m: Measure) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint") if _counts(m) else c


def timechart(rel: Relation, c: Command) -> Relation:
    """One row per slot from the first to the last of the range, or of the data where the range is open; none for no events."""
    if not rel.is_events:
        raise SearchError("SPL_UNSUPPORTED_TIMECHART_SYNTAX", "timechart needs events with a time", c.start, c.end)
    m, span = c["measure"], c["span"][0] * SECONDS[c["span"][1]]
    us = F.unix_micros(F.col(TIME).cast("timestamp"))
    base = rel.set({_AXIS: div(us - F.pmod(us, F.lit(span * 1_000_000)), F.lit(1_000_000))})
    base = base.with_(df=base.df.where(F.col(_AXIS).isNotNull()))
    lo, hi = base.df.agg(F.min(_AXIS), F.max(_AXIS)).first()
    if lo is not None:
        if rel.ctx.earliest is not None:
            lo = math.floor(rel.ctx.earliest / span) * span
        if rel.ctx.latest is not None:
            hi = max(lo, (math.ceil(rel.ctx.latest / span) - 1) * span)
        if (hi - lo) // span + 1 > SLOTS:
            raise DataError(f"the range has more than {SLOTS} slots")
    grid = rel.df.sparkSession.range(0 if lo is None else lo, 0 if lo is None else hi + 1, span).select(F.col("id").alias(PRIVATE + "slot"))
    if c["by"] is None:
        cells, shown = aggregate(base, [replace(m, alias=_VALUE)], [_AXIS]), [(_VALUE, m.alias)]
    else:
        v = base.field(c["by"])
        base = base.set({_LABEL: v.txt.cast("string")})
        cells, shown = _split(base, m)
    df = grid.join(cells, F.col(PRIVATE + "slot") == F.col(_AXIS), "left")
    df = df.select(F.timestamp_seconds(PRIVATE + "slot").alias("_time"), *[_cell(ident(a), m).alias(b) for a, b in shown])
    return rel.grouped(df, ["_time"])


def chart(rel: Relation, c: Command) -> Relation:
    m, row = c["measure"], c["row"]
    r, v = rel.field(row), rel.field(c["col"])
    if v.kind == "mv" or r.kind == "mv":
        raise SearchError("SPL_UNSUPPORTED_CHART_SYNTAX", "lists can't be axes", c.start, c.end)
    base = rel.set({_AXIS: r.col, _LABEL: v.txt.cast("string")})
    base = base.with_(df=base.df.where(F.col(_AXIS).isNotNull()))
    wide, shown = _split(base, m)
    if not rows_at_most(wide, ROWS):
        raise DataError(f"the chart has more than {ROWS} rows")
    df = wide.select(ident(_AXIS).alias(row), *[_cell(ident(a), m).alias(b) for a, b in shown if b != row])
    out = rel.grouped(df, [])
    made, order = {}, []
    for key in order_key(ident(row), r.kind):
        k, out = out.fresh("c")
        made[k] = key
        order.append(Order(k))
    return out.set(made).with_(order=tuple(order))
