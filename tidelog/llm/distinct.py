"""Distinct counts over identifier sets too large to hold, from mergeable registers.

Every identifier is hashed to 64 bits: the low ``p`` bits choose one of m = 2^p registers, the number of trailing
zeros of the rest is its rank. A register keeps the highest rank seen and two indicator bits that say whether the
two ranks below it were seen as well - one byte. Registers merge without loss, by taking the union of the ranks they
stand for. The estimate is the maximum of the likelihood of all register states; its standard error is about
0.76 / sqrt(m) (1.2 percent at p = 12), against 1.04 / sqrt(m) for registers without indicator bits, which
would need 6 bits each for that: some 28 percent less space for equal error.

While a sketch is made or merged it is a set of rows ``(group, reg, state)``, so that no group, however large, is
handled in one task. It is kept packed, a row per group and ``BLOCK`` registers with a byte for each: ``block`` and
``regs``. Blocks without any register seen are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, ident

P = 12
#: Registers of a packed row, and the byte of one that has seen nothing; a state s is the byte s + 1 above that.
BLOCK, NOTHING = 256, -128
_MASK = PRIVATE + "mask"


def standard_error(p: int = P) -> float:
    """Relative standard error of an estimate with 2^p registers."""
    return 0.761 / 2 ** (p / 2)


def _register(value: Column, p: int) -> tuple[Column, Column]:
    """Register number, and the rank as a mask with one bit."""
    h = F.xxhash64(value)
    rest = F.shiftrightunsigned(h, p)
    zeros = F.least(F.bit_count(rest.bitwiseAND(-rest) - 1), F.lit(64 - p))
    return h.bitwiseAND(F.lit(2**p - 1)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), zeros.cast("int"))


def _state(mask: Column) -> Column:
    """The byte of a register from the ranks seen: 4 times the highest, plus 2 and 1 for the two below it."""
    top = F.length(F.bin(mask)) - 1
    two = F.when(top >= 2, F.call_function("shiftright", mask, top - 2).bitwiseAND(F.lit(3)).cast("int"))
    return (top * 4 + F.coalesce(two, F.when(top == 1, mask.bitwiseAND(F.lit(1)).cast("int") * 2), F.lit(0))).cast("short")


def _mask(state: Column) -> Column:
    """The ranks that a register's byte stands for."""
    s = state.cast("int")
    top = F.call_function("shiftright", s, F.lit(2))
    bits = (s.bitwiseAND(F.lit(3)) + 4).cast("long")
    return F.call_function("shiftright", F.call_function("shiftleft", bits, top), F.lit(2))


def _pack(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows of registers as blocks of bytes; what lies between two registers seen is filled up."""
    entry = F.struct(F.col("reg").bitwiseAND(F.lit(BLOCK - 1)).alias("r"), (F.col("state") + F.lit(NOTHING + 1)).cast("tinyint").alias("b"))
    got = rows.groupBy(*[ident(g) for g in groups], "ident", F.shiftright("reg", BLOCK.bit_length() - 1).alias("block")).agg(F.array_sort(F.collect_list(entry)).alias(_MASK))
    e, gap = F.col(_MASK), lambda n: F.array_repeat(F.lit(NOTHING).cast("tinyint"), n)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(e, i - 1)["r"])
    filled = F.flatten(F.transform(e, lambda x, i: F.concat(gap(x["r"] - before(i) - 1), F.array(x["b"]))))
    regs = F.concat(filled, gap(F.lit(BLOCK - 1) - F.element_at(e, -1)["r"]))
    return got.select(*[ident(g) for g in groups], "ident", "block", regs.alias("regs"))


def registers(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Packed sketches as rows of the registers that have seen something: ``groups, ident, reg, state``."""
    at, byte = PRIVATE + "at", PRIVATE + "byte"
    rows = sketches.select(*[ident(g) for g in groups], "ident", "block", F.posexplode("regs").alias(at, byte)).where(F.col(byte) != NOTHING)
    return rows.select(*[ident(g) for g in groups], "ident", (F.col("block") * BLOCK + F.col(at)).alias("reg"), (F.col(byte).cast("int") - F.lit(NOTHING + 1)).cast("short").alias("state"))


def sketch(df: DataFrame, groups: Sequence[str], identifiers: Sequence[str], p: int = P) -> DataFrame:
    """The sketches of every identifier column in every group: ``groups, ident, block, regs``.

    Null identifiers aren't identifiers and don't count; the empty string is one. Null groups are groups of their
    own. Values are compared byte for byte. Repeated rows change nothing; an empty table gives no rows. Each task
    sends at most one row per group and register, and (group, reg) spreads a hot group over all tasks; packing then
    moves one row per register seen, whatever the rows behind it.
    """
    if not 8 <= p <= 18:
        raise ValueError("p lies between 8 and 18")
    each = []
    for c in identifiers:
        reg, mask = _register(ident(c).cast("string"), p)
        each.append(F.when(ident(c).isNotNull(), F.struct(F.lit(c).alias("ident"), reg.alias("reg"), mask.alias(_MASK))))
    rows = df.select(*[ident(g) for g in groups], F.explode(F.array(*each)).alias(PRIVATE + "e")).where(F.col(PRIVATE + "e").isNotNull())
    rows = rows.select(*[ident(g) for g in groups], F.col(PRIVATE + "e.ident").alias("ident"), F.col(PRIVATE + "e.reg").alias("reg"), F.col(f"{PRIVATE}e.{_MASK}").alias(_MASK))
    return _pack(rows.groupBy(*[ident(g) for g in groups], "ident", "reg").agg(_state(F.bit_or(_MASK)).alias("state")), groups)


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches merged to coarser groups (or sketches of several days put together): the same as if the rows
    behind them had been sketched in one."""
    rows = registers(sketches, groups)
    return _pack(rows.groupBy(*[ident(g) for g in groups], "ident", "reg").agg(_state(F.bit_or(_mask(F.col("state")))).alias("state")), groups)


def merge_all_unions(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of every combination of groups and of their unions (a cube); null in a group column stands for all of
    its values. Group columns must not be null themselves."""
    rows, keys = registers(sketches, groups), [ident(g) for g in groups]
    fixed = [F.col("ident"), F.col("reg")]
    sets = [[*s, *fixed] for n in range(len(keys) + 1) for s in itertools.combinations(keys, n)]
    return _pack(rows.groupingSets(sets, *keys, *fixed).agg(_state(F.bit_or(_mask(F.col("state")))).alias("state")), groups)


def estimate(sketches: DataFrame, groups: Sequence[str], p: int = P) -> DataFrame:
    """``groups, ident, estimate`` (a double): the maximum-likelihood count of every sketch.

    A register's likelihood depends on its byte only, so registers are first counted by byte (at most 256 rows a
    group); the maximum is then found by bisection of its derivative on a logarithmic scale.
    """
    top = 64 - p
    counts = registers(sketches, groups).groupBy(*[ident(g) for g in groups], "ident", "state").agg(F.count(F.lit(1)).alias("c"))
    # of a register with highest rank u: ranks above u and unset bits below it weren't seen (their chances add up in a),
    # u and set bits were (each adds a term to the list b)
    s = F.col("state").cast("int")
    u, b1, b2 = F.call_function("shiftright", s, F.lit(2)), F.call_function("shiftright", s, F.lit(1)).bitwiseAND(F.lit(1)), s.bitwiseAND(F.lit(1))

    def chance(rank: Column) -> Column:
        return F.when(rank < F.lit(top), F.pow(F.lit(2.0), -(rank + 1))).otherwise(F.pow(F.lit(2.0), F.lit(-top)))

    above = F.when(u < top, F.pow(F.lit(2.0), -(u + 1))).otherwise(F.lit(0.0))
    a = above + F.when((u >= 1) & (b1 == 0), chance(u - 1)).otherwise(0.0) + F.when((u >= 2) & (b2 == 0), chance(u - 2)).otherwise(0.0)
    terms = F.filter(F.array(chance(u), F.when((u >= 1) & (b1 == 1), chance(u - 1)), F.when((u >= 2) & (b2 == 1), chance(u - 2))), lambda x: x.isNotNull())
    per = counts.groupBy(*[ident(g) for g in groups], "ident").agg(
        F.sum("c").alias("regs"), F.sum(F.col("c") * a).alias("a"), F.collect_list(F.struct(F.col("c").cast("double").alias("c"), terms.alias("t"))).alias("b"),
    )
    m = float(2**p)
    per = per.withColumn("a", F.col("a") + (F.lit(m) - F.col("regs")))
    flat = F.flatten(F.transform("b", lambda x: F.transform(x["t"], lambda r: F.struct(x["c"].alias("c"), r.alias("r")))))
    # equal ranks add up, so that the bisection runs over at most 65 terms
    ranks = F.array_distinct(F.transform("flat", lambda x: x["r"]))
    per = per.withColumn("flat", flat).withColumn("terms", F.transform(ranks, lambda r: F.struct(r.alias("r"), F.aggregate(F.filter("flat", lambda x: x["r"] == r), F.lit(0.0), lambda acc, x: acc + x["c"]).alias("c"))))

    def slope(lam: Column) -> Column:  # positive below the maximum
        return F.aggregate("terms", F.lit(0.0), lambda acc, x: acc + x["c"] * x["r"] / F.expm1(F.least(lam * x["r"], F.lit(700.0)))) - F.col("a")

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = slope(F.pow(F.lit(2.0), mid)) > 0
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(F.lit(-30.0).alias("lo"), F.lit(60.0).alias("hi")), step, lambda acc: F.pow(F.lit(2.0), (acc["lo"] + acc["hi"]) / 2) * F.lit(m))
    return per.select(*[ident(g) for g in groups], "ident", found.alias("estimate"))
