"""Column expressions with the dialect's rules. All run inside Spark; none is a Python function on rows.

Kinds: "int" (evaluated as bigint), "float" (double), "str", "bool" (shown as 1 and 0), "null", "other" (passed through).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "skerry 0.1.0"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(data_type, T.StringType):
        return "str"
    return "null" if isinstance(data_type, T.NullType) else "other"


def to_number(c: Column, kind: str) -> Column:
    """A number for arithmetic: text that is no number becomes NULL, never an error."""
    if kind == "str":
        return F.coalesce(c.try_cast("bigint").cast("double"), c.try_cast("double"))
    if kind == "bool":
        return c.cast("bigint")
    return c.cast("bigint") if kind == "int" else c.cast("double")


def number_kind(kind: str) -> str:
    return "int" if kind in ("int", "bool") else "float"


def divide(a: Column, ka: str, b: Column, kb: str) -> tuple[Column, str]:
    """Whole numbers divide towards zero, by zero to NULL; a float divisor of zero gives an infinity or NaN."""
    x, y = to_number(a, ka), to_number(b, kb)
    if number_kind(ka) == number_kind(kb) == "int":
        zero = F.lit(0).cast("bigint")
        return F.call_function("div", x, F.nullif(y, zero)), "int"
    x, y = x.cast("double"), y.cast("double")
    inf = F.lit(float("inf"))
    by_zero = F.when(x > 0, inf).when(x < 0, -inf).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, by_zero).otherwise(x / F.nullif(y, F.lit(0.0))), "float"


def compare(op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
    """=, <>, <, <=, >, >=. Text against a number compares as numbers."""
    if (ka == "str") != (kb == "str") and "null" not in (ka, kb) and "other" not in (ka, kb):
        a, b = (to_number(c, k).cast("double") for c, k in ((a, ka), (b, kb)))
    elif "bool" in (ka, kb):
        a, b = (c.cast("bigint") if k == "bool" else c for c, k in ((a, ka), (b, kb)))
    return {"=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)


def truthy(c: Column, kind: str) -> Column:
    """What a condition makes of a value: numbers but 0 hold, so do texts but the empty one; NULL stays NULL."""
    if kind == "bool":
        return c
    if kind == "str":
        return c != ""
    if kind in ("int", "float"):
        return c != 0
    return c.cast("boolean")


def shown(c: Column, kind: str) -> Column:
    """A value as a result column: conditions as 1 and 0."""
    return c.cast("int") if kind == "bool" else c


def text(c: Column, kind: str) -> Column:
    """How concat() spells a value: NULL as `NULL`, floats without a trailing `.0`."""
    if kind == "float":
        spelled = F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")
    elif kind == "bool":
        spelled = c.cast("int").cast("string")
    else:
        spelled = c.cast("string")
    return F.coalesce(spelled, F.lit("NULL"))


def concat(*parts: tuple[Column, str]) -> Column:
    return F.concat(*(text(c, k) for c, k in parts)) if parts else F.lit("")


def length(c: Column | None, kind: str = "null") -> Column:
    """Bytes of a text; NULL for anything else."""
    return F.octet_length(c).cast("bigint") if kind == "str" else F.lit(None).cast("bigint")


def ordered(c: Column, descending: bool = False) -> Column:
    """NULLs come last either way."""
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def last_row(c: Column, keys: list[Column]) -> Column:
    """The value in the group's last row by keys, NULL or not."""
    return F.max_by(F.struct(c.alias("v")), F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))))["v"]
