"""What the parser makes of a statement."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Parameter:
    index: int


@dataclass(frozen=True)
class Name:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # "-", "not"
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    of: Any
    negated: bool


@dataclass(frozen=True)
class In:
    of: Any
    items: tuple | None
    query: Any
    negated: bool


@dataclass(frozen=True)
class Between:
    of: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class Like:
    of: Any
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class Case:
    of: Any
    whens: tuple
    otherwise: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    query: Any
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any
    how: str
    on: Any


@dataclass(frozen=True)
class Select:
    items: tuple
    source: Any = None
    where: Any = None
    group: tuple = ()
    having: Any = None
    order: tuple = ()  # of (expression, descending)
    limit: Any = None
    offset: Any = None
    distinct: bool = False


@dataclass(frozen=True)
class Union:
    left: Any
    right: Any
    all: bool


@dataclass(frozen=True)
class With:
    parts: tuple  # of (name, column names or None, query)
    query: Any


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    size: int | None = None
    not_null: bool = False
    default: str | None = None
    primary: bool = False
    auto: bool = False


@dataclass(frozen=True)
class IndexSpec:
    name: str
    columns: tuple
    unique: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple
    primary: tuple = ()
    indexes: tuple = ()
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    table: str
    index: IndexSpec


@dataclass(frozen=True)
class DropIndex:
    table: str
    name: str | None  # None: the primary key


@dataclass(frozen=True)
class Alter:
    table: str
    action: str  # add, change, drop, default, rename
    column: str | None = None
    spec: ColumnSpec | None = None
    place: Any = None  # "first" or ("after", name)
    to: str | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple
    rows: tuple


@dataclass(frozen=True)
class Delete:
    targets: tuple
    source: Any
    where: Any = None
    order: tuple = ()
    limit: Any = None


@dataclass(frozen=True)
class Update:
    source: Any
    sets: tuple  # of (Name, expression)
    where: Any = None
    order: tuple = ()
    limit: Any = None


@dataclass
class Statement:
    """A statement with the number of its parameters."""

    tree: Any
    parameters: int = 0
    text: str = field(default="", compare=False)
