"""The parts of a parsed search: expressions, predicates and commands."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any  # str, int, float, bool or None


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / % .
    left: Any
    right: Any


@dataclass(frozen=True)
class Negate:
    arg: Any


@dataclass(frozen=True)
class Compare:
    op: str  # = != < <= > >=
    left: Any
    right: Any


@dataclass(frozen=True)
class Member:
    value: Any
    options: tuple
    negated: bool = False


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    parts: tuple


@dataclass(frozen=True)
class Not:
    arg: Any


@dataclass(frozen=True)
class Term:
    """A bare word, or with ``phrase`` a quoted text, looked for in the raw text."""

    text: str
    phrase: bool = False


@dataclass(frozen=True)
class FieldTest:
    """``field op value`` of a base search; ``quoted`` says whether the value was written in quotes."""

    field: str
    op: str
    value: str
    quoted: bool = False


@dataclass(frozen=True)
class Measure:
    """One aggregate of a statistical command: ``arg`` is None for rows, a field name, or an expression."""

    func: str
    arg: Any
    alias: str
    param: float | None = None
    inner: Any = None  # of a sparkline: the measure per slot
    span: tuple | None = None
    wildcard: str | None = None


@dataclass(frozen=True)
class Command:
    name: str
    args: dict = field(default_factory=dict)
    start: int = 0
    end: int = 0

    def __getitem__(self, key: str) -> Any:
        return self.args[key]


@dataclass(frozen=True)
class Search:
    base: Any  # predicate or None
    commands: tuple
    source: str
