"""Percentiles with relative rank error, from sketches that merge over partitions and days.

A sketch is a stack of compactors; an item in level h stands for 2^h values. When a level is full, the lower part of
its sorted items is compacted: every other one moves up a level, the rest is dropped. The upper part stays as it is,
and how far down a compaction reaches follows a schedule, so items near the top are hardly ever compacted and the
rank error shrinks in proportion to the distance from the top: the error of an estimated rank r (0..1) is about
``relative_error(k) * (1 - r)`` standard deviations' worth. Extreme high percentiles are the best known; at the
median half of the bound is left. Merging concatenates the levels and compacts again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.common import PRIVATE, cut, ident

K = 64
_SECTIONS = 3


def relative_error(k: int = K) -> float:
    """Standard error of an estimated rank, as a part of its distance from the top rank."""
    return (0.0512 / _SECTIONS) ** 0.5 * 3 / k


class RankSketch:
    """Mergeable sketch of 64-bit integers that protects high ranks."""

    __slots__ = ("k", "n", "levels", "state", "size", "sections")

    def __init__(self, k: int = K):
        self.k, self.n = k, 0
        self.levels: list[list[np.ndarray]] = []
        self.state: list[int] = []
        self.size: list[float] = []
        self.sections: list[int] = []

    def _level(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append([])
            self.state.append(0)
            self.size.append(float(self.k))
            self.sections.append(_SECTIONS)

    def _capacity(self, h: int) -> int:
        return 2 * self.sections[h] * max(4, 2 * round(self.size[h] / 2))

    def update(self, values: np.ndarray) -> None:
        """Add values (an integer array, any order)."""
        if len(values):
            self._level(0)
            self.levels[0].append(np.asarray(values, dtype=np.int64))
            self.n += len(values)
            self._compress()

    def merge(self, other: RankSketch) -> None:
        """Take in another sketch of the same ``k``."""
        if other.levels:
            self._level(len(other.levels) - 1)
        for h, parts in enumerate(other.levels):
            self.levels[h].extend(parts)
            self.state[h] |= other.state[h]
            if other.sections[h] > self.sections[h]:
                self.sections[h], self.size[h] = other.sections[h], other.size[h]
        self.n += other.n
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            if sum(map(len, self.levels[h])) >= self._capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        items = np.sort(np.concatenate(self.levels[h]))
        # the more trailing ones the count of compactions has, the more sections are compacted
        reach = 1
        while self.state[h] >> (reach - 1) & 1:
            reach += 1
        reach = min(reach, self.sections[h])
        section = max(4, 2 * round(self.size[h] / 2))
        keep = self._capacity(h) // 2 + (self.sections[h] - reach) * section
        low = (len(items) - keep) & ~1
        # which half moves up alternates by a fixed mix of level and count: results are repeatable and errors cancel
        coin = (self.state[h] * 0x9E3779B97F4A7C15 + h * 0xBF58476D1CE4E5B9 + self.n * 0x94D049BB133111EB) >> 33 & 1
        self._level(h + 1)
        self.levels[h + 1].append(items[coin:low:2])
        self.levels[h] = [items[low:]]
        self.state[h] += 1
        if self.state[h] >= 2 ** (self.sections[h] - 1) and self.size[h] / 2**0.5 >= 4:
            self.size[h] /= 2**0.5
            self.sections[h] *= 2

    def quantiles(self, qs: Sequence[float]) -> list[int | None]:
        """The item at rank ceil(q * n), for every q; None of an empty sketch."""
        if not self.n:
            return [None] * len(qs)
        items = np.concatenate([np.concatenate(x) if x else np.empty(0, np.int64) for x in self.levels])
        weights = np.concatenate([np.full(sum(map(len, x)), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        upto = np.cumsum(weights[order])
        at = np.searchsorted(upto, [max(1, int(np.ceil(round(q * int(upto[-1]), 6)))) for q in qs])
        return [int(x) for x in items[order][np.minimum(at, len(items) - 1)]]

    def to_bytes(self) -> bytes:
        out = [struct.pack("<HqB", self.k, self.n, len(self.levels))]
        for h, parts in enumerate(self.levels):
            items = np.concatenate(parts) if parts else np.empty(0, np.int64)
            out.append(struct.pack("<qdHI", self.state[h], self.size[h], self.sections[h], len(items)) + items.astype("<i8").tobytes())
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> RankSketch:
        k, n, levels = struct.unpack_from("<HqB", data, 0)
        self, at = cls(k), struct.calcsize("<HqB")
        self.n = n
        for _ in range(levels):
            state, size, sections, count = struct.unpack_from("<qdHI", data, at)
            at += struct.calcsize("<qdHI")
            self.levels.append([np.frombuffer(data, "<i8", count, at).astype(np.int64)])
            at += 8 * count
            self.state.append(state)
            self.size.append(size)
            self.sections.append(sections)
        return self


#: Sketches that a task holds at once; beyond it they are sent on and begun anew. Merging puts them together again, within
#: the same error; at sizes below it a partition's sketch of a group is one.
OPEN_SKETCHES = 20_000


def sketch(df: DataFrame, groups: Sequence[str], metrics: Sequence[str], k: int = K) -> DataFrame:
    """One partial sketch per partition, group and metric: ``groups, metric, sketch`` (binary).

    Metrics are integer columns; null and negative values mean unknown and don't count, so a group without a known
    value has no row. Null groups are groups of their own; ties and repeated rows count as often as they occur; an
    empty table gives no rows; other columns are ignored. Values stay in their partition: nothing is shuffled.
    """
    rows = df.select(*[ident(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)], *[ident(m).cast("long").alias(f"m{i}") for i, m in enumerate(metrics)])
    names, fields = [*groups], [f"g{i}" for i in range(len(groups))]
    schema = T.StructType([*[T.StructField(g, T.StringType()) for g in names], T.StructField("metric", T.StringType()), T.StructField("sketch", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, RankSketch] = {}

        def flush() -> pa.RecordBatch:
            keys = list(held)
            cols = [pa.array([key[i] for key in keys], pa.string()) for i in range(len(names) + 1)]
            out = pa.RecordBatch.from_arrays([*cols, pa.array([held[key].to_bytes() for key in keys], pa.binary())], names=[*names, "metric", "sketch"])
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            code, parts = np.zeros(batch.num_rows, np.int64), []
            for i in range(len(names)):
                coded = batch.column(i).dictionary_encode(null_encoding="encode")
                parts.append((coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)))
                code = code * len(parts[-1][0]) + parts[-1][1]
            order = np.argsort(code, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), batch.num_rows]
            columns = [batch.column(len(names) + i).fill_null(-1).to_numpy(zero_copy_only=False)[order] for i in range(len(metrics))]
            for start, end in zip(edges, edges[1:]):
                key = tuple(words[at[order[start]]] for words, at in parts)
                for metric, column in zip(metrics, columns):
                    values = column[start:end]
                    values = values[values >= 0]
                    if len(values):
                        held.setdefault((*key, metric), RankSketch(k)).update(values)
            if len(held) > OPEN_SKETCHES:
                yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(build, schema)


def merge(sketches: DataFrame, groups: Sequence[str], fan_in: int = 32) -> DataFrame:
    """One sketch per group and metric, of coarser groups too.

    The partials, small beside the data, are written once and the largest group's are counted. They merge as a tree:
    every round puts together about ``fan_in`` sketches of a group, in as many rounds as that takes, so no task merges
    more of them however many partitions made them.
    """
    keys = [*groups, "metric"]
    names = [f"g{i}" for i in range(len(keys))]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("salt", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        parts = iter(sorted(frame["sketch"]))  # in an order of their own, not that of arrival
        total = RankSketch.from_bytes(next(parts))
        for x in parts:
            total.merge(RankSketch.from_bytes(x))
        return pd.DataFrame({n: [frame[n].iloc[0]] for n in [*names, "salt"]} | {"sketch": [total.to_bytes()]})

    rows = cut(sketches.select(*[ident(c).cast("string").alias(n) for c, n in zip(keys, names)], "sketch"))
    parts = rows.groupBy(*names).count().agg(F.max("count")).first()[0] or 1
    salt = F.xxhash64(F.monotonically_increasing_id())
    while True:
        parts = -(-parts // fan_in)
        rows = rows.withColumn("salt", F.pmod(salt, F.lit(parts))).groupBy(*names, "salt").applyInPandas(one, schema)
        if parts == 1:
            return rows.select(*[F.col(n).alias(c) for c, n in zip(keys, names)], "sketch")
        salt = F.col("salt")  # numbers below the last round's parts


def percentiles(sketches: DataFrame, groups: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``groups, metric, n, values``: the number of values of every sketch and its percentiles in the order of ``qs``."""

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("values", T.ArrayType(T.LongType()))]))
    def read(data: pd.Series) -> pd.DataFrame:
        got = [RankSketch.from_bytes(x) for x in data]
        return pd.DataFrame({"n": [s.n for s in got], "values": [s.quantiles(qs) for s in got]})

    rows = sketches.select(*[ident(g) for g in groups], "metric", read("sketch").alias(PRIVATE + "r"))
    return rows.select(*[ident(g) for g in groups], "metric", F.col(PRIVATE + "r.n").alias("n"), F.col(PRIVATE + "r.values").alias("values"))


def once_each(df: DataFrame, identity: str, columns: Sequence[str | Column]) -> DataFrame:
    """One row of ``columns`` per value of ``identity``; of copies that differ, the greatest in the order of the
    columns, null being least. A null identity identifies nothing: each such row stays."""
    cols = [ident(c).alias(c) if isinstance(c, str) else c for c in columns]
    rows = df.select(ident(identity).alias(PRIVATE + "id"), F.struct(*cols).alias(PRIVATE + "row"))
    known = rows.where(F.col(PRIVATE + "id").isNotNull()).groupBy(PRIVATE + "id").agg(F.max(PRIVATE + "row").alias(PRIVATE + "row"))
    return known.select(PRIVATE + "row.*").unionAll(rows.where(F.col(PRIVATE + "id").isNull()).select(PRIVATE + "row.*"))
