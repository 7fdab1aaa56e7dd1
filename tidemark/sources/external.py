"""Read-only tables over Parquet that something else wrote."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.schema import TableSchema
from ..operators.query import Query


def external(df_or_spark: DataFrame | SparkSession, path: str | None = None, name: str = "external") -> Query:
    """A query over a DataFrame, or over the Parquet at a path. There is no record id: ties of a sort are arbitrary."""
    df = df_or_spark if isinstance(df_or_spark, DataFrame) else df_or_spark.read.parquet(path)
    schema = replace(TableSchema.of(name, type(df.schema)([])), struct=df.schema)
    return Query(source=lambda predicate, query: df.limit(0) if query.scope in ("pending", "none") else df, schema=schema)
