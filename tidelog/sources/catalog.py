"""Which tables stand behind an index, and what their columns mean to a search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.common import ident, table
from tidelog.plans.relation import KEY, NAME, TIME


@dataclass(frozen=True)
class Binding:
    """An index: its table, the event time, the columns that make an event unique, the raw text and a column of JSON
    whose paths count as fields. ``names`` gives columns their names in a search."""

    name: str
    read: object  # a function from the session to a DataFrame
    time: str | None = None
    keys: tuple[str, ...] = ()
    raw: str | None = None
    json: str | None = None
    names: dict = field(default_factory=dict)
    index_time: str | None = None
    visibility: str | None = None
    expires: str | None = None
    tenant: str | None = None
    by_index_column: str | None = None  # of a table that holds several indexes: the column with their names


class Catalog:
    """Indexes by name."""

    def __init__(self):
        self.bindings: dict[str, Binding] = {}

    def add(self, binding: Binding) -> None:
        self.bindings[binding.name] = binding

    def names(self) -> list[str]:
        return sorted(self.bindings)

    def scan(
        self, spark: SparkSession, name: str, *, earliest: float | None = None, latest: float | None = None, indexed_until: float | None = None,
        visible_until: int | None = None, tenant: str | None = None, now: float | None = None,
    ) -> DataFrame:
        """An index's events within a half-open range of event time, as far as they had been stored and made visible at
        a cut-off, of one tenant, without expired ones. All of it is conditions on columns, which reach the scan."""
        b = self.bindings[name]
        df = b.read(spark)
        if b.time and earliest is not None:
            df = df.where(ident(b.time) >= _literal(df, b.time, earliest))
        if b.time and latest is not None:
            df = df.where(ident(b.time) < _literal(df, b.time, latest))
        if b.index_time and indexed_until is not None:
            df = df.where(ident(b.index_time) <= _literal(df, b.index_time, indexed_until))
        if b.visibility and visible_until is not None:
            df = df.where(ident(b.visibility) <= F.lit(visible_until))
        if b.tenant and tenant is not None:
            df = df.where(ident(b.tenant) == F.lit(tenant))
        if b.expires and now is not None:
            df = df.where(ident(b.expires).isNull() | (ident(b.expires) > _literal(df, b.expires, now)))
        hidden = {b.tenant, b.visibility, b.expires, b.by_index_column} - {None}
        cols = [ident(c).alias(b.names.get(c, c)) for c in df.columns if c not in hidden]
        shown = {b.names.get(c, c) for c in df.columns if c not in hidden}
        if b.time and "_time" not in shown:
            cols.append(ident(b.time).alias("_time"))
        if b.raw and "_raw" not in shown:
            cols.append(ident(b.raw).alias("_raw"))
        if "index" not in shown:
            cols.append((ident(b.by_index_column) if b.by_index_column else F.lit(name)).alias("index"))
        cols.append(F.lit(name).alias(NAME))
        if b.time:
            cols += [ident(b.time).alias(TIME), F.concat_ws("\x1f", *[F.lpad(ident(k).cast("string"), 20, "0") if df.schema[k].dataType.typeName() in ("long", "integer") else ident(k).cast("string") for k in b.keys]).alias(KEY)]
        else:
            cols += [F.lit(None).cast("timestamp").alias(TIME), F.concat_ws("\x1f", *[F.lpad(ident(k).cast("string"), 20, "0") if df.schema[k].dataType.typeName() in ("long", "integer") else ident(k).cast("string") for k in b.keys]).alias(KEY)]
        return df.select(*cols)


def _literal(df: DataFrame, column: str, seconds: float):
    """A time as a literal of the column's own type, so that the comparison can be pushed down."""
    ts = F.timestamp_micros(F.lit(round(seconds * 1_000_000)))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")) if df.schema[column].dataType.typeName() == "timestamp_ntz" else ts


def parquet_folder(sf_dir: str) -> Catalog:
    """A catalog of the tables in a folder."""
    at = lambda name: (lambda spark: table(spark, sf_dir, name))
    catalog = Catalog()
    catalog.add(Binding("events", at("events"), time="ts", keys=("event_id",), raw="props", json="props"))
    catalog.add(Binding("lineitem", at("lineitem"), time="l_shipdate", keys=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    catalog.add(Binding("orders", at("orders"), time="o_orderdate", keys=("o_orderkey",)))
    for name, keys in {"customer": ("c_custkey",), "part": ("p_partkey",), "supplier": ("s_suppkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",)}.items():
        catalog.add(Binding(name, at(name), keys=keys))
    catalog.add(Binding("documents", at("documents"), time="published_at", keys=("doc_id",), raw="text"))
    catalog.add(Binding(
        "log_events", at("log_events"), keys=("event_id", "visibility_seq"), json="fields", names={"event_time": "_time", "index_time": "_indextime", "raw": "_raw"}, time="event_time",
        index_time="index_time", visibility="visibility_seq", tenant="tenant_id", by_index_column="index_name",
    ))
    return catalog


def prune(names: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The indexes that a scope names, with ``*`` as a wildcard; all of them without a scope."""
    import fnmatch

    return [n for n in names if any(fnmatch.fnmatchcase(n, w) for w in wanted)] if wanted else list(names)
