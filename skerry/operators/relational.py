"""The relational operators, over plain DataFrames. Catalyst chooses how each is carried out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.functions import exprs


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All of a Parquet table; filters and column choices made later reach the files."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def points(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """The rows with one of these keys; keys that aren't there give no row."""
    return df.filter(F.col(key).isin(list(values)))


def between(df: DataFrame, key: str, low=None, high=None, closed: tuple[bool, bool] = (True, False)) -> DataFrame:
    """The rows of a key range; either end may be open or missing. The range reaches the Parquet scan."""
    if low is not None:
        df = df.filter(F.col(key) >= low if closed[0] else F.col(key) > low)
    if high is not None:
        df = df.filter(F.col(key) <= high if closed[1] else F.col(key) < high)
    return df


def one_row(spark: SparkSession) -> DataFrame:
    """The source of a query without FROM."""
    return spark.range(1).select()


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """No rows."""
    return spark.createDataFrame([], schema)


def renamed(df: DataFrame, alias: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A relation under another name, its columns too if given."""
    return (df.toDF(*columns) if columns else df).alias(alias)


def joined(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Inner, left or right outer join on any condition; columns come left, then right."""
    return left.join(right, on, how)


def grouped(df: DataFrame, keys: Sequence[Column], aggregates: Sequence[Column], having: Column | None = None) -> DataFrame:
    """One row for each group (NULL is a key like others), or one row in all without keys."""
    if keys and not aggregates:
        raise EngineError("Group by clause without aggregator")
    out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    return out if having is None else out.filter(having)


def ordered(df: DataFrame, keys: Sequence[tuple[Column, bool]], ties: Sequence[str] = ()) -> DataFrame:
    """Sorted by (column, descending), NULLs last either way, then by the row's own key."""
    return df.orderBy(*(exprs.ordered(c, down) for c, down in keys), *(exprs.ordered(F.col(c)) for c in ties))


def limited(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET; a sort before them becomes a top-k."""
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def united(left: DataFrame, right: DataFrame, every: bool = True) -> DataFrame:
    """UNION by position under the left names; types must be of one class."""
    if len(left.columns) != len(right.columns):
        raise EngineError(f"Different number of columns, left is {len(left.columns)}, but right is {len(right.columns)}")
    for i, (a, b) in enumerate(zip(left.schema.fields, right.schema.fields, strict=True)):
        kinds = {exprs.kind_of(a.dataType), exprs.kind_of(b.dataType)} - {"null"}
        if len({"int" if k == "bool" else k for k in kinds}) > 1:
            raise EngineError(f"Column not compatible in column[{i}], left is {a.dataType.simpleString()}, but right is {b.dataType.simpleString()}")
    out = left.unionAll(right)
    return out if every else out.distinct()
