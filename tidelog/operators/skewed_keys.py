"""Totals and exact quantiles per key when a few keys hold most rows.

No task ever sees the values of a key together. Every pass over the data reduces rows to histograms - counts per key
and leading bits of the value, combined before the shuffle - and their running sums give, for each key and rank, the
one bucket that holds the rank. The next pass splits that bucket by further bits, until a bucket is a single value.
Buckets are values shifted right, which keeps their order over the whole range of 64-bit integers.

The same selection finds the values that hold a share of all rows: in the order of their hashes such a value can't lie
between two ranks that are the share apart, so the selected ranks name every one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, cut, ident, rows_at_most

#: Keys' intervals are broadcast up to this many rows (some 20 MB). Beyond it rows are counted by key and bucket first
#: and the counts meet the intervals by key and interval, of which each has no more than a pass's buckets.
BROADCAST_ROWS = 200_000

#: Bits of the hash by which ``heavy_keys`` orders values, and bits resolved in its first pass.
HASH_BITS, FIRST_BITS = 32, 16

_B, _PRE, _KV = PRIVATE + "b", PRIVATE + "pre", PRIVATE + "kv"


def _long_form(df: DataFrame, key_fields: Sequence[str], value: Column) -> DataFrame:
    """One row per row and key field: key_field, key_value, and ``v``, which is computed from the row or the key."""
    kv = F.col("k.key_value")
    return df.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("key_field"), ident(k).cast("string").alias("key_value")) for k in key_fields])).alias("k"), value.alias("v"),
    ).select("k.key_field", "k.key_value", F.coalesce(F.concat(F.lit("="), kv), F.lit("")).alias(_KV), "v")


def key_totals(df: DataFrame, key_fields: Sequence[str], value: str) -> DataFrame:
    """Per key field and value: ``n`` rows, ``n_values`` not-null values, their ``total``, ``lo`` and ``hi``.

    Combined before the shuffle, so a hot key sends one row per task. A null key is a key. ``total`` is a decimal,
    which doesn't overflow.
    """
    return _long_form(df, key_fields, ident(value).cast("long")).groupBy("key_field", "key_value").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_values"), F.sum(F.col("v").cast("decimal(20,0)")).alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"),
    )


def _bucket(v: Column, shift: int) -> Column:
    return F.lit(0).cast("long") if shift > 63 else F.call_function("shiftright", v, F.lit(shift))


def _histogram(long: DataFrame, open_: DataFrame | None, was: int, to: int) -> DataFrame:
    """Counts of the values by their bits above ``to``, in the open intervals (values that agree in the bits above ``was``)."""
    rows = long.select("key_field", _KV, _bucket(F.col("v"), was).alias(_PRE), _bucket(F.col("v"), to).alias(_B))
    count = lambda x: x.groupBy("key_field", _KV, _PRE, _B).agg(F.count(F.lit(1)).alias("c"))
    if open_ is None:
        return count(rows)
    intervals = open_.select("key_field", _KV, _PRE).distinct()
    if rows_at_most(intervals, BROADCAST_ROWS):
        return count(rows.join(F.broadcast(intervals), ["key_field", _KV, _PRE], "left_semi"))
    return count(rows).join(intervals, ["key_field", _KV, _PRE], "left_semi")


def _narrow(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The state with every interval replaced by the bucket in it that holds the rank; ``at`` rows lie in the bucket."""
    w = Window.partitionBy("key_field", _KV, _PRE).orderBy(_B)  # as many rows as a pass has buckets
    runs = counts.withColumn("upto", F.sum("c").over(w))
    hit = state.drop("at").join(runs, ["key_field", _KV, _PRE]).where("rank <= upto and rank > upto - c")
    return hit.select("key_field", _KV, "qi", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col(_B).alias(_PRE), F.col("c").alias("at"))


def _steps(bits: int, buckets: int) -> Iterator[tuple[int, int]]:
    """Pairs of bits that are open before and after a pass: as few passes as the buckets allow, of equal work."""
    passes = max(1, math.ceil(bits / max(1, buckets.bit_length() - 1)))
    ends = [64, *[bits - round(bits * (i + 1) / passes) for i in range(passes)]]
    return zip(ends, ends[1:])


def keyed_selection(
    df: DataFrame, key_fields: Sequence[str], value: str, quantiles: Sequence[float], buckets: int = 2048,
) -> DataFrame:
    """Totals and exact nearest-rank quantiles of an integer column for every value of every key field.

    One row per key: ``key_field, key_value, n, n_values, total, lo, hi`` and ``quantiles``, an array of the values
    at the ranks ceil(q * n_values), in the order of ``quantiles``; null for a key without values. Null keys are keys
    of their own, the empty string too; ties and repeated rows count as often as they occur; an empty table gives no
    rows; other columns are ignored. Any 64-bit integers will do. Each pass divides the intervals by up to ``buckets``.
    """
    totals = cut(key_totals(df, key_fields, value))
    q = F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(x)).alias("q")) for i, x in enumerate(quantiles)]))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("q.q") * F.col("n_values"), 6))).cast("long")
    kv = F.coalesce(F.concat(F.lit("="), F.col("key_value")), F.lit(""))
    state = totals.where("n_values > 0").select("key_field", kv.alias(_KV), "n_values", q.alias("q")).select("key_field", _KV, F.col("q.qi").alias("qi"), rank.alias("rank"), F.lit(0).cast("long").alias(_PRE))
    lo, hi = totals.agg(F.min("lo"), F.max("hi")).first()
    if lo is None:
        return totals.withColumn("quantiles", F.lit(None).cast("array<bigint>"))
    bits = 1 + max((x if x >= 0 else ~x).bit_length() for x in (lo, hi))  # with the sign
    long = _long_form(df, key_fields, ident(value).cast("long")).where("v is not null")
    first = True
    for was, to in _steps(bits, buckets):
        state = cut(_narrow(state, _histogram(long, None if first else state, was, to)))
        first = False
    found = state.groupBy("key_field", _KV).agg(F.array_sort(F.collect_list(F.struct("qi", F.col(_PRE).alias("v")))).alias("f"))
    found = found.select(F.col("key_field"), F.col(_KV), F.col("f.v").alias("quantiles"))
    return totals.withColumn(_KV, kv).join(found, ["key_field", _KV], "left").select(*totals.columns, "quantiles")


def heavy_keys(df: DataFrame, key_fields: Sequence[str], share: float) -> DataFrame:
    """The values, neither null nor empty, that hold at least ``share`` of all rows: ``key_field, key_value, n``.

    Values are ordered by ``HASH_BITS`` bits of a hash. One that holds the share of all rows covers a rank that is a
    multiple of it, so the selection of these ranks - at most 1 / ``share`` a field - finds its hash, and the count of
    the last histogram says whether that hash is frequent enough. The frequent hashes' values are then counted as
    they are written, which parts values of the same hash. Every row counts, repeated rows as often as they occur; an
    empty table gives no rows; other columns are ignored.
    """
    if not 0 < share <= 1:
        raise ValueError("share lies between 0 and 1")
    kv = F.col("key_value")
    rows = _long_form(df, key_fields, F.lit(None).cast("long")).withColumn("v", F.when(kv != "", F.pmod(F.xxhash64(kv), F.lit(2**HASH_BITS))))
    hashed = rows.withColumn(_KV, F.lit(""))
    rough = HASH_BITS - FIRST_BITS
    counts = cut(_histogram(hashed, None, 64, rough))  # values that don't count have the bucket null
    sums = counts.groupBy("key_field").agg(F.sum("c").alias("n"), F.sum(F.when(F.col(_B).isNotNull(), F.col("c"))).alias("n_values"))
    least = F.ceil(F.round(F.lit(float(share)) * F.col("n"), 6)).cast("long")
    ranks = F.when(F.col("n_values") >= F.col("least"), F.sequence(F.col("least"), F.col("n_values"), F.col("least")))
    sums = sums.withColumn("least", F.greatest(least, F.lit(1)))
    state = sums.select("key_field", F.lit("").alias(_KV), F.posexplode(ranks).alias("qi", "rank")).withColumn(_PRE, F.lit(0).cast("long"))
    state = cut(_narrow(state, counts.where(F.col(_B).isNotNull())))
    state = cut(_narrow(state, _histogram(hashed, state, rough, 0)))
    limits = sums.select("key_field", "least")
    frequent = state.join(F.broadcast(limits), "key_field").where("at >= least").select("key_field", F.col(_PRE).alias("v"), "least").distinct()
    # at most 1 / share rows a field
    return rows.join(F.broadcast(frequent), ["key_field", "v"]).groupBy("key_field", "key_value").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least")).where("n >= least").drop("least")


def exact_quantiles(df: DataFrame, groups: Sequence[Column], value: Column, quantiles: Sequence[float], buckets: int = 2048) -> DataFrame:
    """Exact nearest-rank quantiles of any numeric column per group: ``key``, a struct of the groups, and ``quantiles``.

    As in ``keyed_selection``, but the bucket of a rank is narrowed to the least and the greatest value found in it,
    until these are one. The first pass divides by sign and power of two, the others evenly, so that with 2048 buckets
    seven passes resolve any doubles. Nulls and NaN don't count, so a group of nothing else has no row; null groups
    are groups of their own; an empty table gives no rows.
    """
    key = F.struct(*[g.alias(f"g{i}") for i, g in enumerate(groups)]) if groups else F.struct(F.lit(0).alias("g0"))
    long = df.select(key.alias("key"), value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    q = F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(x)).alias("q")) for i, x in enumerate(quantiles)]))
    totals = cut(long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("q.q") * F.col("n"), 6))).cast("long")
    state = totals.select("key", "n", "lo", "hi", q.alias("q")).select("key", F.col("q.qi").alias("qi"), rank.alias("rank"), "lo", "hi")
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, so that no difference overflows
    even = F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias(_B)
    size = F.abs("v")
    power = F.signum("v") * F.when(size == 0, F.lit(0)).when(size == F.lit(float("inf")), F.lit(4000)).otherwise(F.floor(F.log2(size)) + 2000)
    bucket = power.cast("long").alias(_B)
    w = Window.partitionBy("key", "lo", "hi").orderBy(_B)  # as many rows as there are buckets
    while not (open_ := state.where("hi > lo")).isEmpty():
        intervals, rows, on = open_.select("key", "lo", "hi").distinct(), long, ["key"]
        if rows_at_most(intervals, BROADCAST_ROWS):
            intervals = F.broadcast(intervals)
        else:  # the rows of a key, equal ones too, are spread by where they stand
            rows, on = rows.withColumn(_PRE, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(16))), ["key", _PRE]
            intervals = intervals.withColumn(_PRE, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        counts = rows.join(intervals, on).where("v between lo and hi").groupBy("key", "lo", "hi", bucket).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("l"), F.max("v").alias("h"))
        hit = open_.join(counts.withColumn("upto", F.sum("c").over(w)), ["key", "lo", "hi"]).where("rank <= upto and rank > upto - c")
        closer = hit.select("key", "qi", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("l").alias("lo"), F.col("h").alias("hi"))
        state, bucket = cut(closer.unionByName(state.where("hi <= lo"))), even
    return state.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("qi", "lo"))), lambda x: x["lo"]).alias("quantiles"))
