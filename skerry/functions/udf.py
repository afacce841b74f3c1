"""User functions, declared by a signature such as "str,int->str"."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.errors import EngineError

TYPES = {"str": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}


def parse_signature(signature: str) -> tuple[list[T.DataType], T.DataType]:
    """The argument types and the type of the result."""
    left, arrow, right = signature.partition("->")
    names = [n.strip().lower() for n in left.split(",")] if left.strip() else []
    if not arrow or right.strip().lower() not in TYPES or any(n not in TYPES for n in names):
        raise EngineError("bad format")
    return [TYPES[n] for n in names], TYPES[right.strip().lower()]


class Functions:
    """Names are without case and at most 64 bytes long. `vector` functions take and return pandas Series; others single values."""

    def __init__(self):
        self._known: dict[str, tuple[Callable, int, T.DataType]] = {}
        self._aggregates: dict[str, tuple[Callable, int, T.DataType]] = {}

    def register(self, name: str, function: Callable, signature: str, vector: bool = True) -> None:
        if not name or len(name.encode()) > 64:
            raise EngineError("bad format")
        arguments, result = parse_signature(signature)
        if vector:
            made = F.pandas_udf(_on_series(function), result)
        else:
            made = F.udf(function, result)
        self._known[name.lower()] = (made, len(arguments), result)

    def register_aggregate(self, name: str, function: Callable, signature: str) -> None:
        """An aggregate as a function of columns that gives an aggregate column, such as `lambda c: F.sqrt(F.sum(c * c))`.

        Made of Spark's own aggregates it starts, iterates, merges and ends as they do: it is combined before the shuffle, and no group has to fit into a task.
        """
        if not name or len(name.encode()) > 64:
            raise EngineError("bad format")
        arguments, result = parse_signature(signature)
        self._aggregates[name.lower()] = (function, len(arguments), result)

    def find_aggregate(self, name: str) -> tuple[Callable, int, T.DataType] | None:
        return self._aggregates.get(name.lower())

    def find(self, name: str) -> tuple[Callable, int, T.DataType] | None:
        return self._known.get(name.lower())


def _on_series(function: Callable) -> Callable:
    def call(*columns: pd.Series) -> pd.Series:
        return function(*columns)

    return call
