"""Grouped aggregates: stats, eventstats, top and rare.

All measures that combine before the shuffle go into one aggregation. Those that can't - lists in order, different or
commonest values, and measures of multivalue fields - are aggregated by themselves and joined by group, on one row a group.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, ident, rows_at_most
from tidelog.functions.scalars import Value
from tidelog.functions.values import mixed_struct
from tidelog.operators.ordering import _same
from tidelog.operators.skewed_keys import exact_quantiles
from tidelog.plans.errors import DataError, SearchError
from tidelog.plans.nodes import Command, Field, Measure
from tidelog.plans.parser import is_boolean
from tidelog.plans.relation import KEY, TIME, Relation

#: Entries of ``list``, of ``values``, and points of a sparkline.
LIST_ENTRIES, VALUES_ENTRIES, POINTS = 100, 10_000, 100
#: Fixed values of a session with ceilings: values that ``dc`` counts, and bytes of a list's texts.
DISTINCT, LIST_BYTES = 100_000, 512 * 1024
PERCENTILE_ACCURACY = 10_000
#: Up to this many rows an exact percentile's buffer holds all values; beyond it ranks are resolved by histograms. Both
#: give the same value.
SMALL_ROWS = 1_000_000
#: The error that is stated for an estimated distinct count, and from which count on.
ESTDC_FROM, ESTDC_ERROR = 1000, 0.002872621298570349
#: Slots that a sparkline without span may have, in seconds.
LADDER = (1, 5, 10, 30, 60, 300, 600, 1800, 3600, 86_400, 2_592_000)
_UNIT_S = {"us": 1e-6, "ms": 1e-3, "cs": 1e-2, "ds": 1e-1, "s": 1, "m": 60, "h": 3600, "d": 86_400, "mon": 2_592_000}


def measure_value(rel: Relation, m: Measure) -> Value | None:
    if m.arg is None:
        return None
    if is_boolean(m.arg) and not isinstance(m.arg, Field):
        return Value(rel.compiler.predicate(m.arg), "bool")
    return rel.compiler.value(m.arg)


def expand_wildcards(rel: Relation, measures: Sequence[Measure], by: Sequence[str]) -> list[Measure]:
    """``avg(*)`` and the like, once for every public field that the pattern fits and that isn't a group."""
    out = []
    for m in measures:
        if m.wildcard is None:
            out.append(m)
            continue
        names = [c for c in rel.public if fnmatch.fnmatchcase(c, m.wildcard) and c not in by]
        if m.func not in ("count", "dc", "estdc", "values", "list", "mode", "first", "last", "min", "max", "earliest", "latest"):
            names = [c for c in names if rel.kind(c) in ("number", "string", "time")]
        if not names:
            raise SearchError("SPL_NO_MATCHING_STATS_FIELDS", f"no field fits {m.wildcard}")
        func = m.alias.split("(")[0] if "(" in m.alias else m.func
        out += [replace(m, arg=Field(c), wildcard=None, alias=m.alias.replace("*", c, 1) if "(" not in m.alias else f"{func}({c})") for c in names]
    return out


class _Builder:
    """Inputs to project before an aggregation, aggregates, and what to make of them afterwards."""

    def __init__(self, rel: Relation, allnum: bool = False):
        self.rel, self.allnum = rel, allnum
        self.inputs: dict[str, Column] = {}
        self.aggs: dict[str, Column] = {}
        self._seen: dict[str, str] = {}

    def input(self, col: Column) -> str:
        # one input for the same expression, however many measures use it
        key = str(col._jc.toString()) if hasattr(col, "_jc") else str(col)
        if key not in self._seen:
            self._seen[key] = f"{PRIVATE}m{len(self.inputs)}"
            self.inputs[self._seen[key]] = col
        return self._seen[key]

    def agg(self, col: Column) -> Column:
        name = f"{PRIVATE}a{len(self.aggs)}"
        self.aggs[name] = col
        return F.col(name)

    def build(self, m: Measure, v: Value | None) -> Column:
        """The measure's value from the aggregates (a column over the grouped rows)."""
        f = m.func
        if v is None:
            return self.agg(F.count(F.lit(1)))
        if f == "count":
            if v.kind == "bool" and not isinstance(m.arg, Field):
                return self.agg(F.count_if(F.col(self.input(v.col))))
            return self.agg(F.count(F.col(self.input(v.col))))
        text = self.input(v.txt) if f in ("dc", "estdc", "estdc_error") else None
        if f == "dc":
            n = self.agg(F.count_distinct(F.col(text)))
            return F.when(n > DISTINCT, F.raise_error(F.lit(f"dc counts more than {DISTINCT} values"))).otherwise(n) if self.rel.ctx.ceilings else n
        if f in ("estdc", "estdc_error"):
            n = self.agg(F.expr(f"hll_sketch_estimate(hll_sketch_agg(`{text}`, 17))"))
            n = F.coalesce(n, F.lit(0))
            return n if f == "estdc" else F.when(n < ESTDC_FROM, F.lit(0.0)).otherwise(F.lit(ESTDC_ERROR))
        if f in ("min", "max"):
            if v.kind in ("number", "time", "bool"):
                return self.agg((F.min if f == "min" else F.max)(F.col(self.input(v.col))))
            s = self.input(mixed_struct(v.col, "string" if v.kind == "null" else v.kind, v.txt))
            return self.agg((F.min if f == "min" else F.max)(F.col(s)))["v"]
        if f in ("earliest", "latest", "earliest_time", "latest_time", "rate"):
            return self._by_time(f, v)
        if f in ("first", "last"):
            return self._by_order(f, v)
        return self._numeric(m, v)

    def _numeric(self, m: Measure, v: Value) -> Column:
        f, x = m.func, F.col(self.input(v.num if v.kind != "number" else v.col.cast("double")))
        if f in ("perc", "upperperc", "exactperc", "median"):
            x = F.col(self.input(v.num))
        out = {
            "sum": lambda: self.agg(F.sum(x)), "avg": lambda: self.agg(F.avg(x)), "sumsq": lambda: self.agg(F.sum(x * x)), "range": lambda: self.agg(F.max(x) - F.min(x)),
            "stdevp": lambda: self.agg(F.stddev_pop(x)), "varp": lambda: self.agg(F.var_pop(x)),
            "stdev": lambda: self.agg(F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))), "var": lambda: self.agg(F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.var_samp(x))),
            "median": lambda: self.agg(F.percentile_approx(x, 0.5, PERCENTILE_ACCURACY)), "perc": lambda: self.agg(F.percentile_approx(x, float(m.param or 0.5), PERCENTILE_ACCURACY)),
            "exactperc": lambda: self.agg(F.expr(f"percentile_disc({m.param}) WITHIN GROUP (ORDER BY `{self.input(v.num)}`)")),
            "upperperc": lambda: self._upper(m, x),
        }[f]()
        if self.allnum:
            every, eligible = self.agg(F.count(F.col(self.input(v.col)))), self.agg(F.count(F.col(self.input(v.num))))
            return F.when(every == eligible, out)
        return out

    def _upper(self, m: Measure, x: Column) -> Column:
        p = float(m.param or 0.5)
        both = self.agg(F.percentile_approx(x, [p, min(1.0, p + 0.01)], PERCENTILE_ACCURACY))
        return F.when(self.agg(F.approx_count_distinct(x)) <= 1000, both[0]).otherwise(both[1])

    def _by_time(self, f: str, v: Value) -> Column:
        if not self.rel.is_events:
            raise SearchError("SPL_UNSUPPORTED_AGGREGATE", f"{f} needs events with a time")
        x = v.num if f == "rate" else v.col
        s = F.col(self.input(F.when(x.isNotNull(), F.struct(F.col(TIME).alias("t"), F.col(KEY).alias("k"), x.alias("v")))))
        if f == "rate":
            lo, hi = self.agg(F.min(s)), self.agg(F.max(s))
            seconds = (F.unix_micros(hi["t"].cast("timestamp")) - F.unix_micros(lo["t"].cast("timestamp"))) / F.lit(1e6)
            return F.try_divide(hi["v"] - lo["v"], seconds)
        got = self.agg((F.min if f.startswith("earliest") else F.max)(s))
        return F.unix_micros(got["t"].cast("timestamp")) / F.lit(1e6) if f.endswith("_time") else got["v"]

    def _by_order(self, f: str, v: Value) -> Column:
        order = self.rel.order
        if not order:
            return self.agg(F.first(F.col(self.input(v.col)), ignorenulls=True))
        s = F.col(self.input(F.when(v.col.isNotNull(), F.struct(*[ident(o.column).alias(f"k{i}") for i, o in enumerate(order)], v.col.alias("v")))))
        down = order[0].desc
        return self.agg((F.max if (f == "first") == down else F.min)(s))["v"]


def uniform(rel: Relation) -> bool:
    """Whether all keys of the order run one way, nulls last when falling and first when rising, as structs compare."""
    return all(o.desc == rel.order[0].desc and o.nulls_last == o.desc for o in rel.order)


def _listed(rel: Relation, groups: Sequence[str], v: Value, n: int, last: bool) -> DataFrame:
    """The first (or last) ``n`` values per group in the established order, as an array. Rows beyond them are
    dropped before the shuffle."""
    value, rank = PRIVATE + "lv", PRIVATE + "lr"
    order = [o.flipped() if last else o for o in rel.order]
    w = Window.partitionBy(*[ident(g) for g in groups] or [F.lit(0)]).orderBy(*([o.expr() for o in order] or [F.lit(0)]))
    df = rel.df.withColumn(value, v.col if v.kind != "mv" else v.col).where(F.col(value).isNotNull())
    df = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
    got = F.transform(F.array_sort(F.collect_list(F.struct(rank, value))), lambda s: s[value])
    return df.groupBy(*[ident(g) for g in groups]).agg((F.slice(F.flatten(got), 1, n) if v.kind == "mv" else got).alias(PRIVATE + "list"))


def _values(rel: Relation, groups: Sequence[str], text: Column) -> DataFrame:
    """The different values per group in order, as an array; more than ``VALUES_ENTRIES`` are an error. Values are made
    different before the shuffle, and no more of a group than would be one too many are ever gathered."""
    value, rank = PRIVATE + "lv", PRIVATE + "lr"
    each = rel.df.select(*[ident(g) for g in groups], text.cast("string").alias(value)).where(F.col(value).isNotNull()).distinct()
    w = Window.partitionBy(*[ident(g) for g in groups] or [F.lit(0)]).orderBy(value)
    got = F.transform(F.array_sort(F.collect_list(F.struct(rank, value))), lambda s: s[value])
    few = F.when(F.count(F.lit(1)) > VALUES_ENTRIES, F.raise_error(F.lit(f"values has more than {VALUES_ENTRIES} entries"))).otherwise(got)
    return each.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= VALUES_ENTRIES + 1).groupBy(*[ident(g) for g in groups]).agg(few.alias(PRIVATE + "list"))


def _mode(rel: Relation, groups: Sequence[str], text: Column) -> DataFrame:
    """The commonest value per group, of equally common ones the least: values are counted first, then compared."""
    value = PRIVATE + "lv"
    counts = rel.df.select(*[ident(g) for g in groups], text.alias(value)).where(F.col(value).isNotNull()).groupBy(*[ident(g) for g in groups], value).agg((-F.count(F.lit(1))).alias("c"))
    return counts.groupBy(*[ident(g) for g in groups]).agg(F.min(F.struct("c", value))[value].alias(PRIVATE + "list"))


def _sparkline(rel: Relation, groups: Sequence[str], m: Measure) -> DataFrame:
    """Per group a list of a mark and one value per slot of the search's range, or of the data's where it is open.
    More than ``POINTS`` slots are an error; without a span it is the shortest of a fixed list that needs no more."""
    if not rel.is_events:
        raise SearchError("SPL_UNSUPPORTED_AGGREGATE", "sparkline needs events with a time")
    time = F.unix_micros(F.col(TIME).cast("timestamp"))
    earliest, latest = rel.ctx.earliest, rel.ctx.latest
    if earliest is None or latest is None:
        lo, hi = rel.df.agg(F.min(time), F.max(time)).first()
        lo, hi = (0, 1) if lo is None else (lo, hi + 1)
    else:
        lo, hi = round(earliest * 1_000_000), round(latest * 1_000_000)
    lo, hi = (lo if earliest is None else round(earliest * 1_000_000)), (hi if latest is None else round(latest * 1_000_000))
    ends = lambda span: (lo // span, max(-(-hi // span) - 1, lo // span))
    points = lambda span: ends(span)[1] - ends(span)[0] + 1
    if m.span:
        span = int(m.span[0] * _UNIT_S[m.span[1] or "s"] * 1_000_000)
    else:
        span = next((s * 1_000_000 for s in LADDER if points(s * 1_000_000) <= POINTS), LADDER[-1] * 1_000_000)
    if points(span) > POINTS:
        raise DataError(f"the sparkline has {points(span)} points, more than {POINTS}")
    first, last = ends(span)
    slot = PRIVATE + "sp"
    inner = aggregate(rel.with_(df=rel.df.withColumn(slot, F.floor(time / F.lit(span)).cast("bigint"))), [replace(m.inner, alias=PRIVATE + "sv")], [*groups, slot])
    keyed = F.map_from_entries(F.collect_list(F.struct(F.col(slot), F.col(PRIVATE + "sv").cast("string"))))
    per = inner.where(F.col(slot).isNotNull()).groupBy(*[ident(g) for g in groups]).agg(keyed.alias("m"))
    empty = "0" if m.inner.func in ("count", "dc") else ""
    line = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(empty)))
    return per.select(*[ident(g) for g in groups], F.concat(F.array(F.lit("##__SPARKLINE__##")), line).alias(PRIVATE + "list"))


def aggregate(rel: Relation, measures: Sequence[Measure], groups: Sequence[str], allnum: bool = False) -> DataFrame:
    """One row per group with the measures' values under their aliases. ``groups`` are columns of ``rel.df``."""
    build = _Builder(rel, allnum)
    outs: dict[str, Column] = {}
    apart: list[tuple[Measure, DataFrame]] = []
    for m in measures:
        v = measure_value(rel, m)
        if m.func == "sparkline":
            apart.append((m, _sparkline(rel, groups, m)))
        elif m.func == "exactperc" and v.kind != "mv" and not allnum and not rows_at_most(rel.df.select(F.lit(1)), SMALL_ROWS):
            exact = exact_quantiles(rel.df, [ident(g) for g in groups], v.num, [float(m.param or 0.5)])
            apart.append((m, exact.select(*[F.col(f"key.g{i}").alias(g) for i, g in enumerate(groups)], F.col("quantiles")[0].alias(PRIVATE + "list"))))
        elif m.func in ("values", "mode"):
            text, source = v.txt, rel
            if v.kind == "mv":
                source, text = rel.with_(df=rel.df.withColumn(PRIVATE + "fx", F.explode(v.col))), F.col(PRIVATE + "fx")
            apart.append((m, (_values if m.func == "values" else _mode)(source, groups, text)))
        elif m.func == "list" or (m.func in ("first", "last") and v.kind != "mv" and not (not rel.order or uniform(rel))):
            apart.append((m, _listed(rel, groups, v, LIST_ENTRIES if m.func == "list" else 1, m.func == "last")))
        elif v is not None and v.kind == "mv" and m.func == "count":
            outs[m.alias] = F.coalesce(build.agg(F.sum(F.size(F.filter(v.col, lambda x: x.isNotNull())))), F.lit(0)).cast("bigint")
        elif v is not None and v.kind == "mv":
            flat = rel.with_(df=rel.df.withColumn(PRIVATE + "fx", F.explode(v.col)))
            inner = _Builder(flat, allnum)
            out = inner.build(replace(m, arg=Field("x")), Value(F.col(PRIVATE + "fx"), "string"))
            flat = flat.set(inner.inputs)
            apart.append((m, flat.df.groupBy(*[ident(g) for g in groups]).agg(*[c.alias(n) for n, c in inner.aggs.items()]).select(*[ident(g) for g in groups], out.alias(PRIVATE + "list"))))
        else:
            outs[m.alias] = build.build(m, v)
    base = rel.set(build.inputs).df
    aggs = [c.alias(n) for n, c in build.aggs.items()] or [F.count(F.lit(1)).alias(PRIVATE + "none")]
    got = base.groupBy(*[ident(g) for g in groups]).agg(*aggs)
    names: dict[str, str] = {}
    for i, (m, df) in enumerate(apart):
        names[m.alias] = f"{PRIVATE}l{i}"
        df = df.withColumnRenamed(PRIVATE + "list", names[m.alias])
        got = _left(got, df, groups) if groups else got.join(df, how="left", on=F.lit(True))
    cols = []
    for m in measures:
        if m.alias in names:
            c = F.col(names[m.alias])
            if m.func in ("first", "last"):
                c = F.get(c, F.lit(0))
            elif m.func == "values":
                c = F.coalesce(c, F.array().cast("array<string>"))
            if m.func in ("values", "list") and rel.ctx.ceilings:
                size = F.aggregate(c.cast("array<string>"), F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)))
                c = F.when(size > LIST_BYTES, F.raise_error(F.lit(f"{m.func} has more than {LIST_BYTES} bytes"))).otherwise(c)
            cols.append(c.alias(m.alias))
        else:
            cols.append(outs[m.alias].alias(m.alias))
    return got.select(*[ident(g) for g in groups], *cols)


def _left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = {k: f"{PRIVATE}j{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    cond = None
    for k, n in names.items():
        e = ident(k).eqNullSafe(ident(n))
        cond = e if cond is None else cond & e
    return left.join(right, cond, "left").drop(*names.values())


def group_rows(rel: Relation, by: Sequence[str], once: bool = False) -> tuple[Relation, list[str]]:
    """The relation with its group columns under private names: lists are expanded to a row per member and rows
    without a value in any of them are left out."""
    cols, kinds = {}, []
    for i, name in enumerate(by):
        v = rel.field(name)
        cols[f"{PRIVATE}g{i}"] = v.col
        kinds.append(v.kind)
    rel = rel.set(cols)
    df = rel.df
    for n, kind in zip(cols, kinds):
        if kind == "mv":
            df = df.withColumn(n, F.explode(F.array_distinct(F.col(n)) if once else F.col(n)))
        df = df.where(F.col(n).isNotNull())
    return rel.with_(df=df), list(cols)


def stats(rel: Relation, c: Command) -> Relation:
    by = list(c["by"])
    measures = expand_wildcards(rel, c["measures"], by)
    grouped, keys = group_rows(rel, by, c["dedup_splitvals"])
    df = aggregate(grouped, measures, keys, c["allnum"])
    df = df.select(*[ident(k).alias(n) for k, n in zip(keys, by)], *[ident(m.alias) for m in measures])
    return rel.grouped(df, by)


def eventstats(rel: Relation, c: Command) -> Relation:
    """The measure of every row's group beside the row. It is an aggregation joined back, not a window: a group of
    any size is combined before the shuffle, and no group has to fit in a task."""
    m, by = c["measure"], list(c["by"])
    base = rel.set({f"{PRIVATE}g{i}": rel.field(n).col for i, n in enumerate(by)})
    keys = [f"{PRIVATE}g{i}" for i in range(len(by))]
    named = replace(m, alias=PRIVATE + "es")
    source = base.df
    for k in keys:
        source = source.where(F.col(k).isNotNull())
    got = aggregate(base.with_(df=source), [named], keys)
    df = base.df.join(got.withColumnsRenamed({k: k + "r" for k in keys}), on=[base.df[k] == F.col(k + "r") for k in keys], how="left") if keys else base.df.crossJoin(F.broadcast(got))  # one row
    done = rel.with_(df=df).set({m.alias: F.col(PRIVATE + "es")})
    return done.with_(df=done.df.drop(PRIVATE + "es", *keys, *[k + "r" for k in keys]))


def _frequency(rel: Relation, c: Command, most: bool) -> Relation:
    by = list(c["names"])
    grouped, keys = group_rows(rel, by)
    counts = grouped.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias(PRIVATE + "all"))
    df = counts.crossJoin(F.broadcast(total))  # one row
    df = df.select(*[ident(k).alias(n) for k, n in zip(keys, by)], "count", (F.lit(100.0) * F.col("count") / F.col(PRIVATE + "all")).alias("percent"))
    out = rel.grouped(df, [])
    first, out = out.fresh("c")
    made = {first: F.col("count")}
    from tidelog.plans.relation import Order

    order = [Order(first, most)]
    for n in by:
        k, out = out.fresh("t")
        made[k] = out.field(n).txt
        order.append(Order(k, True))
    out = out.set(made).with_(order=tuple(order))
    return out.with_(df=out.df.orderBy(*out.sort_exprs()).limit(c["n"])) if c["n"] else out


def top(rel: Relation, c: Command) -> Relation:
    return _frequency(rel, c, True)


def rare(rel: Relation, c: Command) -> Relation:
    return _frequency(rel, c, False)


__all__ = ["_same", "aggregate"]
