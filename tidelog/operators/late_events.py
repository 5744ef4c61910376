"""Per-period aggregates by event time that late records correct until a cut-off.

Rows are reduced to *partials*: one row per key, period and arrival batch with counts (and sums, minima and maxima
of chosen values). Partials are mergeable, so a period's aggregate is the sum of whatever partials exist, and a
batch that arrives later only adds rows. A record that arrives after its period's cut-off is refused: it is counted
as refused and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import PRIVATE, div, ident, micros

_P, _A = PRIVATE + "period", PRIVATE + "arrival"


@dataclass(frozen=True)
class Lateness:
    """Period length, the grace after a period's end within which a record is on time, the cut-off after the end,
    and the length of an arrival batch; all in seconds."""

    period_s: int = 3600
    grace_s: int = 300
    cutoff_s: int = 86_400
    batch_s: int = 3600


def _exact_floor(us: Column, seconds: int) -> Column:
    """Start, in epoch seconds, of the slot of ``seconds`` that holds the microsecond ``us``; times before 1970 go down too."""
    return div(us - F.pmod(us, F.lit(seconds * 1_000_000)), F.lit(1_000_000))


def first_arrivals(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], event_time: str, arrival: str, rule: Lateness,
    values: Sequence[str] = (),
) -> DataFrame:
    """One row per identity: the copy with the smallest arrival (nulls last; ties by period, keys and values).

    Rows with a null in the identity have no identity, so each of them stands for itself. Columns: keys, values,
    period start (epoch seconds) and arrival (epoch microseconds), under private names for the last two. The
    minimum is combined before the shuffle, so an identity that holds most rows costs no task more than others.
    """
    us = micros(event_time)
    whole = df.select(
        *[ident(c).alias(f"{PRIVATE}i{i}") for i, c in enumerate(identity)],
        F.coalesce(micros(arrival), F.lit(2**63 - 1)).alias(_A),
        _exact_floor(us, rule.period_s).alias(_P),
        *[ident(c).alias(f"{PRIVATE}k{i}") for i, c in enumerate(keys)],
        *[ident(c).alias(f"{PRIVATE}v{i}") for i, c in enumerate(values)],
    )
    ids = [f"{PRIVATE}i{i}" for i in range(len(identity))]
    body = [c for c in whole.columns if c not in ids]
    back = [F.col(_A), F.col(_P)]
    back += [F.col(f"{PRIVATE}k{i}") for i in range(len(keys))] + [F.col(f"{PRIVATE}v{i}") for i in range(len(values))]
    if not ids:
        return whole.select(*back)
    known = F.lit(True)
    for c in ids:
        known = known & F.col(c).isNotNull()
    once = whole.where(known).groupBy(*ids).agg(F.min(F.struct(*body)).alias("s")).select("s.*").select(*back)
    return once.unionAll(whole.where(~known).select(*back))


def period_partials(
    df: DataFrame, keys: Sequence[str], *, event_time: str, arrival: str, identity: Sequence[str] = (),
    values: Sequence[str] = (), rule: Lateness = Lateness(),
) -> DataFrame:
    """Mergeable partial aggregates, one row per keys, period and arrival batch.

    Columns: the keys, ``period_start`` and ``batch_start`` (epoch seconds), ``n_on_time``, ``n_late``,
    ``n_refused`` and, for every value column ``v``, ``sum_v``, ``min_v``, ``max_v`` and ``n_v`` over the accepted
    records. A null key is a key of its own. A record without event time belongs to the period null and one
    without arrival time to the batch null; both are counted as refused, so that every record is counted once.
    An empty table gives no rows; columns not named are ignored.
    """
    rows = first_arrivals(df, keys, identity, event_time, arrival, rule, values)
    end = (F.col(_P) + F.lit(rule.period_s)) * F.lit(1_000_000)
    known = F.col(_P).isNotNull() & (F.col(_A) < F.lit(2**63 - 1))
    accepted = known & (F.col(_A) <= end + F.lit(rule.cutoff_s * 1_000_000))
    late = accepted & (F.col(_A) > end + F.lit(rule.grace_s * 1_000_000))
    rows = rows.select(
        *[F.col(f"{PRIVATE}k{i}").alias(c) for i, c in enumerate(keys)],
        F.col(_P).alias("period_start"),
        F.when(F.col(_A) < F.lit(2**63 - 1), _exact_floor(F.col(_A), rule.batch_s)).alias("batch_start"),
        F.coalesce(accepted, F.lit(False)).alias(PRIVATE + "ok"), F.coalesce(late, F.lit(False)).alias(PRIVATE + "late"),
        *[F.col(f"{PRIVATE}v{i}") for i in range(len(values))],
    )
    ok, was_late = F.col(PRIVATE + "ok"), F.col(PRIVATE + "late")
    aggs = [F.count_if(ok & ~was_late).alias("n_on_time"), F.count_if(was_late).alias("n_late"), F.count_if(~ok).alias("n_refused")]
    for i, v in enumerate(values):
        x = F.when(ok, F.col(f"{PRIVATE}v{i}"))
        aggs += [F.sum(x).alias(f"sum_{v}"), F.min(x).alias(f"min_{v}"), F.max(x).alias(f"max_{v}"), F.count(x).alias(f"n_{v}")]
    return rows.groupBy(*[ident(c) for c in keys], "period_start", "batch_start").agg(*aggs)


def combine_partials(partials: DataFrame, keys: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """The aggregates of every period from the partials at hand: one row per keys and period, with
    ``n_accepted`` in place of ``n_on_time`` and ``n_batches`` for the number of batches that touched the period."""
    aggs = [
        F.sum(F.col("n_on_time") + F.col("n_late")).alias("n_accepted"), F.sum("n_late").alias("n_late"),
        F.sum("n_refused").alias("n_refused"), F.count(F.lit(1)).alias("n_batches"),
    ]
    for v in values:
        aggs += [F.sum(f"sum_{v}").alias(f"sum_{v}"), F.min(f"min_{v}").alias(f"min_{v}"), F.max(f"max_{v}").alias(f"max_{v}"), F.sum(f"n_{v}").alias(f"n_{v}")]
    return partials.groupBy(*[ident(c) for c in keys], "period_start").agg(*aggs)


_DAY = 86_400


class PeriodStore:
    """Partials kept in a folder, one sub-folder per merged batch, combined on read. Batch ids are texts, whatever they
    look like.

    ``merge`` reduces a batch to partials and writes them under its batch id; writing the same id again replaces
    it, so a retried batch changes nothing. The identities of a batch are kept beside the partials by the day of their
    period, so that a redelivery in a later batch counts nowhere again; a batch reads those of the days that it touches
    and no others, however many batches there were.
    """

    #: Days of a batch by which the known identities are read; a batch that touches more reads all of them.
    MOST_DAYS = 2000

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], *, event_time: str, arrival: str, identity: Sequence[str], values: Sequence[str] = (), rule: Lateness = Lateness(),
    ):
        self.spark, self.path, self.keys, self.identity, self.values = spark, path.rstrip("/"), list(keys), list(identity), list(values)
        self.event_time, self.arrival, self.rule = event_time, arrival, rule

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")
        except AnalysisException:
            return None

    def merge(self, batch: DataFrame, batch_id: str) -> None:
        """Add a batch. Batches come in order of arrival; within a batch any order will do."""
        day = div(micros(self.event_time) - F.pmod(micros(self.event_time), F.lit(_DAY * 1_000_000)), F.lit(_DAY * 1_000_000))
        new, seen = batch, self._read("seen")
        if seen is not None:
            days = [r[0] for r in batch.select(day.alias("d")).distinct().where("d is not null").limit(self.MOST_DAYS + 1).collect()]
            if len(days) <= self.MOST_DAYS:
                seen = seen.where(F.col("day").isin(days))
            seen = seen.where(F.col("batch_id") != F.lit(f"b-{batch_id}"))
            cond = [batch[c] == seen[f"id{i}"] for i, c in enumerate(self.identity)]
            new = batch.join(seen, cond, "left_anti")
        partials = period_partials(new, self.keys, event_time=self.event_time, arrival=self.arrival, identity=self.identity, values=self.values, rule=self.rule)
        partials.write.mode("overwrite").parquet(f"{self.path}/partials/batch_id=b-{batch_id}")
        known = F.lit(True)
        for c in self.identity:
            known = known & ident(c).isNotNull()
        ids = new.where(known).select(*[ident(c).alias(f"id{i}") for i, c in enumerate(self.identity)], day.alias("day")).distinct()
        # files by day, each of one task, however many days a batch's late records reach back
        ids.repartition("day", F.pmod(F.hash(*[f"id{i}" for i in range(len(self.identity))]), F.lit(8))).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/seen/batch_id=b-{batch_id}")

    def read(self) -> DataFrame:
        """The aggregates of every period, from all batches merged so far."""
        got = self._read("partials")
        if got is None:
            raise ValueError(f"nothing has been merged under {self.path}")
        return combine_partials(got, self.keys, self.values)

    def compact(self, into: str) -> None:
        """Write the aggregates of every period, without the batches, to another folder."""
        self.read().write.mode("overwrite").parquet(into)
