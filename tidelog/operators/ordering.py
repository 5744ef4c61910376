"""Commands that depend on the established order of rows.

A whole relation in one order would be one task. Rows are put into ranges of the order instead, as many as there are
shuffle partitions and of like size, and written once in that order, so that every later step sees the same ranges. A
row's number is its place in its range plus the rows of the ranges before, of which there is one count a range. Running
aggregates add up the same way. Finite frames are cut into blocks of numbered rows that carry along as many rows of
the block before as the frame reaches back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, cut, div, ident
from tidelog.functions.values import mixed_struct, order_key
from tidelog.plans.nodes import Command, Measure
from tidelog.plans.relation import KEY, TIME, Order, Relation

SLOT, PLACE, NUMBER, BLOCK = PRIVATE + "slot", PRIVATE + "at", PRIVATE + "rn", PRIVATE + "blk"
BLOCK_ROWS = 200_000


def sort(rel: Relation, c: Command) -> Relation:
    order: list[Order] = []
    columns: dict[str, Column] = {}
    for name, desc in c["keys"]:
        v = rel.field(name)
        for i, key in enumerate(order_key(v.col, v.kind if v.kind != "null" else "string")):
            made, rel = rel.fresh("s")
            columns[made] = key
            order.append(Order(made, desc if i or v.kind != "string" else desc))
    rel = rel.set(columns)
    rel = rel.with_(order=tuple(order) + tuple(o for o in rel.order))
    return _first(rel, c["limit"]) if c["limit"] else rel


def _first(rel: Relation, n: int) -> Relation:
    return rel.with_(df=rel.df.orderBy(*rel.sort_exprs()).limit(n) if rel.order else rel.df.limit(n))


def head(rel: Relation, c: Command) -> Relation:
    return _first(rel, c["n"])


def tail(rel: Relation, c: Command) -> Relation:
    return _first(reverse(rel, c), c["n"])


def reverse(rel: Relation, c: Command) -> Relation:
    return rel.with_(order=tuple(o.flipped() for o in rel.order))


def dedup(rel: Relation, c: Command) -> Relation:
    df, keys = rel.df, [rel.field(n) for n in c["names"]]
    for k in keys:
        df = df.where(k.col.isNotNull())
    made, rel = rel.fresh("n")
    w = Window.partitionBy(*[k.col for k in keys]).orderBy(*(rel.sort_exprs() or [F.lit(0)]))
    # the planner keeps only the first rows of each key before the shuffle
    return rel.with_(df=df.withColumn(made, F.row_number().over(w)).where(F.col(made) <= c["n"]).drop(made))


# numbering and running aggregates -----------------------------------------------------------------------------------
def _ranged(rel: Relation) -> DataFrame:
    """The rows in ranges of the order: ``SLOT``, the range, rising with the order, and ``PLACE``, the place in it from 0.
    Where there is no order, a hash of the row makes one; rows that are equal in it stand in any order, but in one."""
    keys = rel.sort_exprs() or [F.xxhash64(*[ident(c).cast("string") for c in rel.df.columns])]
    df = rel.df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits for the row's place
    df = cut(df.withColumn(PLACE, at))
    return df.withColumn(SLOT, F.shiftright(PLACE, 33)).withColumn(PLACE, F.col(PLACE).bitwiseAND(F.lit(2**33 - 1)))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join on keys that may be null; the right side's keys are dropped."""
    names = {k: f"{PRIVATE}j{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    cond = None
    for k, n in names.items():
        e = ident(k).eqNullSafe(ident(n))
        cond = e if cond is None else cond & e
    return left.join(right, cond).drop(*names.values())


def numbered(rel: Relation, groups: Sequence[str] = ()) -> Relation:
    """The relation with the number of every row (from 1) in the established order, by groups if there are any."""
    df, keys = _ranged(rel), [*groups, SLOT]
    counts = df.groupBy(*[ident(k) for k in keys]).agg(F.count(F.lit(1)).alias(PRIVATE + "c"))
    # one row per range, and per group in it
    before = Window.partitionBy(*[ident(g) for g in groups] or [F.lit(0)]).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn(PRIVATE + "c", F.coalesce(F.sum(PRIVATE + "c").over(before), F.lit(0)))
    if groups:
        w = Window.partitionBy(*[ident(k) for k in keys]).orderBy(PLACE)
        df = df.withColumn(NUMBER, F.row_number().over(w).cast("bigint"))
    else:
        df, shift = df.withColumn(NUMBER, F.col(PLACE) + 1), F.broadcast(shift)
    df = _same(df, shift, keys)
    return rel.with_(df=df.withColumn(NUMBER, F.col(NUMBER) + F.col(PRIVATE + "c")).drop(PRIVATE + "c", SLOT, PLACE))


def _blocked(rel: Relation, groups: Sequence[str], reach: int) -> DataFrame:
    """Numbered rows in blocks, each with the last ``reach`` rows of the block before it (marked as not its own)."""
    size = max(BLOCK_ROWS, reach)
    df = numbered(rel, groups).df
    own = div(F.col(NUMBER) - 1, F.lit(size))
    spill = (F.col(NUMBER) - 1) % size >= size - reach
    return df.withColumn(BLOCK, F.explode(F.when(spill, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn(PRIVATE + "own", F.col(BLOCK) == own)


def delta(rel: Relation, c: Command) -> Relation:
    p, made = c["p"], PRIVATE + "x"
    base = rel.set({made: rel.field(c["field"]).num})
    df = _blocked(base, (), p)
    w = Window.partitionBy(BLOCK).orderBy(NUMBER)
    df = df.withColumn(made, F.col(made) - F.lag(made, p).over(w)).where(PRIVATE + "own").drop(BLOCK, PRIVATE + "own", NUMBER)
    rel = rel.with_(df=df)
    return rel.set({c["alias"]: F.col(made)}).with_(df=rel.set({c["alias"]: F.col(made)}).df.drop(made))


class _Running:
    """One running measure: its input, its aggregate over rows, and how two parts make one."""

    def __init__(self, rel: Relation, m: Measure, i: int):
        self.m, self.names = m, []
        self.inputs: dict[str, Column] = {}
        name = f"{PRIVATE}r{i}"
        if m.func == "count" and m.arg is None:
            self.add(name, F.lit(1), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
            self.out = lambda s: F.coalesce(s[0], F.lit(0)).cast("bigint")
            return
        from tidelog.plans.parser import is_boolean

        if m.func == "count" and is_boolean(m.arg):
            self.add(name, F.when(rel.compiler.predicate(m.arg), 1).otherwise(0), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
            self.out = lambda s: F.coalesce(s[0], F.lit(0)).cast("bigint")
            return
        v = rel.compiler.value(m.arg)
        plus = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        if m.func == "count":
            n = F.size(F.filter(v.col, lambda x: x.isNotNull())) if v.kind == "mv" else F.when(v.col.isNotNull(), 1)
            self.add(name, n.cast("bigint"), F.sum, plus)
            self.out = lambda s: F.coalesce(s[0], F.lit(0)).cast("bigint")
        elif m.func in ("sum", "avg"):
            self.add(name, v.num, F.sum, plus)
            if m.func == "avg":
                self.add(name + "n", F.when(v.num.isNotNull(), 1).cast("bigint"), F.sum, plus)
            self.out = (lambda s: s[0]) if m.func == "sum" else (lambda s: s[0] / s[1])
        elif m.func in ("min", "max"):
            plain = v.kind in ("number", "time", "bool")
            x = v.col if plain else mixed_struct(v.col, "string" if v.kind == "null" else v.kind, v.txt)
            self.add(name, x, F.min if m.func == "min" else F.max, F.least if m.func == "min" else F.greatest)
            self.out = (lambda s: s[0]) if plain else (lambda s: s[0]["v"])
        else:
            x = F.when(v.col.isNotNull(), F.struct(F.col(TIME).alias("t"), F.col(KEY).alias("k"), v.col.alias("v")))
            self.add(name, x, F.min if m.func == "earliest" else F.max, F.least if m.func == "earliest" else F.greatest)
            self.out = lambda s: s[0]["v"]

    def add(self, name: str, col: Column, agg, both) -> None:
        self.inputs[name] = col
        self.names.append((name, agg, both))


def _along(rel: Relation, measures: Sequence[Measure], by: Sequence[str], current: bool, window: int) -> Relation:
    runs = [_Running(rel, m, i) for i, m in enumerate(measures)]
    inputs = {n: c for r in runs for n, c in r.inputs.items()}
    base = rel.set(inputs | {f"{PRIVATE}b{i}": rel.field(g).col for i, g in enumerate(by)})
    groups = [f"{PRIVATE}b{i}" for i in range(len(by))]
    last = 0 if current else -1
    if window:
        df = _blocked(base, groups, window)
        w = Window.partitionBy(*[ident(g) for g in groups], BLOCK).orderBy(NUMBER).rowsBetween(last - window + 1, last)
        df = df.select("*", *[agg(n).over(w).alias(n + "o") for r in runs for n, agg, _ in r.names]).where(PRIVATE + "own").drop(BLOCK, PRIVATE + "own", NUMBER)
        state = {n: F.col(n + "o") for r in runs for n, _, _ in r.names}
    else:
        df = _ranged(base)
        keys = [*groups, SLOT]
        before = Window.partitionBy(*[ident(g) for g in groups] or [F.lit(0)]).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
        parts = [(n, agg, both) for r in runs for n, agg, both in r.names]
        prior = df.groupBy(*[ident(k) for k in keys]).agg(*[agg(n).alias(n + "p") for n, agg, _ in parts])
        prior = prior.select(*[ident(k) for k in keys], *[agg(n + "p").over(before).alias(n + "p") for n, agg, _ in parts])
        w = Window.partitionBy(*[ident(k) for k in keys]).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, last)
        df = _same(df.select("*", *[agg(n).over(w).alias(n + "o") for n, agg, _ in parts]), prior if groups else F.broadcast(prior), keys)
        state = {n: both(F.col(n + "p"), F.col(n + "o")) for n, _, both in parts}
    known = None
    for g in groups:
        known = F.col(g).isNotNull() if known is None else known & F.col(g).isNotNull()
    out = {}
    for r in runs:
        value = r.out([state[n] for n, _, _ in r.names])
        out[r.m.alias] = value if known is None else F.when(known, value)
    done = rel.with_(df=df).set(out)
    extra = [c for c in done.df.columns if c.startswith(PRIVATE) and c not in rel.df.columns]
    return done.with_(df=done.df.drop(*extra), serial=rel.serial)


def streamstats(rel: Relation, c: Command) -> Relation:
    return _along(rel, c["measures"], c["by"], c["current"], c["window"])


def accum(rel: Relation, c: Command) -> Relation:
    from tidelog.plans.nodes import Field

    return _along(rel, [Measure("sum", Field(c["field"]), c["alias"])], (), True, 0)
