"""Files as relations, beyond what the dialect itself asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A file or folder; give a schema for json and csv to save a pass over the data."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is not one of {', '.join(FORMATS)}")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", **options: str) -> None:
    if kind not in FORMATS:
        raise ValueError(f"{kind} is not one of {', '.join(FORMATS)}")
    df.write.options(**options).format(kind).mode(mode).save(path)
