"""Exactly one copy of every message that was delivered at least once.

Identities are split by their frequency, which one aggregation over 8-byte hashes of them gives. Rows of identities
that occur once pass as they are. Rows of repeated ones alone are ranked; the first rank is a mergeable minimum, so an
identity with a third of all rows is combined in every task before anything moves. Rows are then kept or dropped by
their own unique number, which spreads such an identity like any other rows.

Two identities with the same hash are both ranked, each by itself, which keeps both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, cut, ident, micros, rows_at_most

_H, _N, _KEEP, _SALT = PRIVATE + "h", PRIVATE + "n", PRIVATE + "keep", PRIVATE + "salt"

#: Repeated identities are broadcast up to this many (8 bytes each, some 70 MB as a table); beyond it rows meet them in
#: a shuffle in which the rows of one identity are spread over ``SPLIT`` tasks.
BROADCAST_ROWS = 1_000_000
SPLIT = 32


def _known(identity: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in identity:
        known = known & ident(c).isNotNull()
    return known


def _hash(identity: Sequence[str]) -> Column:
    """The identity's hash; null where a part of it is null."""
    return F.when(_known(identity), F.xxhash64(*[ident(c) for c in identity]))


def identity_frequencies(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Per identity the number of its copies, ``n``. Rows with a null in the identity aren't in it."""
    return df.where(_known(identity)).groupBy(*[ident(c) for c in identity]).agg(F.count(F.lit(1)).alias("n"))


class _Split:
    """The rows of a table by whether their identity occurs once or several times."""

    def __init__(self, df: DataFrame, identity: Sequence[str], prefer: str, row_id: str):
        self.df, self.identity, self.row_id = df, identity, row_id
        counts = df.where(_known(identity)).groupBy(_hash(identity).alias(_H)).agg(F.count(F.lit(1)).alias(_N))
        self.repeated = cut(counts.where(F.col(_N) > 1).select(_H))  # counted once, used by every step
        self.bounded = rows_at_most(self.repeated, BROADCAST_ROWS)
        narrow = df.where(_known(identity)).select(
            _hash(identity).alias(_H), *[ident(c).alias(f"{PRIVATE}i{i}") for i, c in enumerate(identity)],
            F.struct(F.coalesce(micros(prefer), F.lit(2**63 - 1)).alias("t"), ident(row_id).alias("r")).alias("s"),
        )
        self.ranked = self._of_repeated(narrow)
        ids = [f"{PRIVATE}i{i}" for i in range(len(identity))]
        self.first = self.ranked.groupBy(_H, *ids).agg(F.min("s").alias("s")).select(_H, F.col("s.r").alias(_KEEP))

    def _of_repeated(self, rows: DataFrame) -> DataFrame:
        if self.bounded:
            return rows.join(F.broadcast(self.repeated), _H, "left_semi")
        right = self.repeated.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
        return rows.withColumn(_SALT, F.pmod(F.hash("s"), F.lit(SPLIT))).join(right, [_H, _SALT], "left_semi").drop(_SALT)

    def dropped(self) -> DataFrame:
        rows = self.ranked.select(F.col("s.r").alias(_KEEP))
        return rows.join(self.first.select(_KEEP), _KEEP, "left_anti").select(F.col(_KEEP).alias(self.row_id))

    def kept(self) -> DataFrame:
        if not self.bounded:
            gone = self.dropped().withColumnRenamed(self.row_id, _KEEP)
            return self.df.join(gone, self.df[self.row_id] == gone[_KEEP], "left_anti")
        # a row per repeated identity, as few as were counted
        first = F.broadcast(self.first.groupBy(_H).agg(F.collect_list(_KEEP).alias(_KEEP)))
        rows = self.df.withColumn(_H, _hash(self.identity)).join(first, _H, "left")
        # singletons and rows without an identity meet nothing and pass, of repeated ones the first: both parts in one pass
        return rows.where(F.col(_KEEP).isNull() | F.array_contains(F.col(_KEEP), ident(self.row_id))).select(*[ident(c) for c in self.df.columns])


def kept_rows(df: DataFrame, identity: Sequence[str], prefer: str, row_id: str) -> DataFrame:
    """The row numbers to keep, in one column ``row_id``: those of singletons, the first in rank of every repeated
    identity, and every row without a full identity (a null can't be a redelivery of anything)."""
    names = list(dict.fromkeys([*identity, prefer, row_id]))
    return exactly_once(df.select(*[ident(c) for c in names]), identity, prefer, row_id).select(ident(row_id))


def dropped_rows(df: DataFrame, identity: Sequence[str], prefer: str, row_id: str) -> DataFrame:
    """The row numbers of all surplus copies: of every repeated identity all but the first in rank. ``row_id`` must be
    unique and not null; an empty table gives none."""
    return _Split(df, identity, prefer, row_id).dropped()


def exactly_once(df: DataFrame, identity: Sequence[str], prefer: str, row_id: str) -> DataFrame:
    """All columns of one copy per identity: the earliest ``prefer`` (null counts as latest), then the smallest ``row_id``.

    Rows with a null in the identity are all kept. Extra columns pass unchanged, whatever their names. Nothing but
    hashes and the narrow rows of repeated identities is shuffled, as long as these identities are at most
    ``BROADCAST_ROWS``; beyond it the rows are shuffled once, by their number.
    """
    return _Split(df, identity, prefer, row_id).kept()


def merge_new(stored: DataFrame, new: DataFrame, identity: Sequence[str], prefer: str, row_id: str) -> DataFrame:
    """One copy per identity over all stored and new messages; columns that only one side has are null in the other."""
    return exactly_once(stored.unionByName(new, allowMissingColumns=True), identity, prefer, row_id)


def copy_counts(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """How many identities have how many copies: ``copies``, ``identities``."""
    return identity_frequencies(df, identity).groupBy(F.col("n").alias("copies")).agg(F.count(F.lit(1)).alias("identities"))
