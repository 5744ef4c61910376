"""The relation that a command takes and gives: a DataFrame with its established order and what is known of it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.common import PRIVATE, ident
from tidelog.functions.scalars import Compiler, Value
from tidelog.functions.values import kind_of

#: Private columns of events: their time, unique key and binding, which commands can't change.
TIME, KEY, NAME = PRIVATE + "time", PRIVATE + "key", PRIVATE + "index"


@dataclass(frozen=True)
class Order:
    column: str
    desc: bool = False
    nulls_last: bool = True

    def flipped(self) -> Order:
        return Order(self.column, not self.desc, not self.nulls_last)

    def expr(self) -> Column:
        c = ident(self.column)
        if self.desc:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


@dataclass(frozen=True)
class Context:
    """What a search was admitted with: one clock reading (epoch seconds), time zone, range (epoch seconds or None), id,
    and whether results of more than interactive size are refused."""

    now: float
    zone: str = "UTC"
    earliest: float | None = None
    latest: float | None = None
    sid: str = "search"
    lookups: dict | None = None
    ceilings: bool = False


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    order: tuple[Order, ...]
    ctx: Context
    closed: bool = False
    json_root: str | None = None
    flat: frozenset = frozenset()  # lists shown by lines
    serial: int = 0

    def with_(self, **changes) -> Relation:
        return replace(self, **changes)

    @property
    def public(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(PRIVATE)]

    @property
    def private(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(PRIVATE)]

    @property
    def is_events(self) -> bool:
        return TIME in self.df.columns

    def kind(self, name: str) -> str:
        return kind_of(self.df.schema[name].dataType)

    def field(self, name: str) -> Value:
        """A field's value: a column, a path into the events' own JSON, or missing (null)."""
        if name in self.public:
            dtype = self.df.schema[name].dataType
            c = ident(name)
            if isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, T.StringType):
                c = c.cast("array<string>")
            return Value(c, kind_of(dtype), integral=isinstance(dtype, T.IntegralType))
        if self.json_root and not self.closed and self.json_root in self.df.columns:
            return Value(F.get_json_object(ident(self.json_root), "$." + name), "string")
        return Value(F.lit(None).cast("string"), "null")

    @property
    def compiler(self) -> Compiler:
        return Compiler(self.field, self.ctx.now, self.ctx.zone)

    def sort_exprs(self) -> list[Column]:
        return [o.expr() for o in self.order]

    def set(self, columns: dict[str, Column]) -> Relation:
        """The relation with columns set, all of them from the present ones."""
        if not columns:
            return self
        kept = [ident(c) if c not in columns else columns[c].alias(c) for c in self.df.columns]
        new = [v.alias(n) for n, v in columns.items() if n not in self.df.columns]
        return self.with_(df=self.df.select(*kept, *new), flat=self.flat - columns.keys())

    def keep(self, names: Iterable[str]) -> Relation:
        """Only these public columns, in this order, and the private ones; missing ones become null columns."""
        names = list(dict.fromkeys(names))
        cols = [self.field(n).col.alias(n) for n in names]
        return self.with_(df=self.df.select(*cols, *[ident(c) for c in self.private]), flat=self.flat & set(names))

    def fresh(self, what: str) -> tuple[str, Relation]:
        """A private column name that this relation hasn't used."""
        return f"{PRIVATE}{what}{self.serial}", self.with_(serial=self.serial + 1)

    def grouped(self, df: DataFrame, keys: list[str]) -> Relation:
        """A relation of a transforming command, in the order of its keys."""
        return Relation(df, tuple(Order(k) for k in keys), self.ctx, closed=True, serial=self.serial)
