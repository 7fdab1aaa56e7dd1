"""What callers do with a query's rows: grouping, sums, counts, distinct rows, unions and key-list joins, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_sum(df: DataFrame, keys: list[str], value: str | Column, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def group_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def group_count_having(df: DataFrame, keys: list[str], at_least: int, name: str = "n") -> DataFrame:
    return group_count(df, keys, name).where(F.col(name) >= at_least)


def total(df: DataFrame, value: str | Column, name: str = "total") -> DataFrame:
    return df.agg(F.sum(value).alias(name))


def extremes(df: DataFrame, value: str | Column) -> DataFrame:
    return df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def nested_groups(df: DataFrame, outer: str, inner: str, name: str = "n") -> DataFrame:
    """Groups within groups: counts by both keys, one row per outer key with its inner ones sorted."""
    return df.groupBy(outer, inner).agg(F.count("*").alias(name)).groupBy(outer).agg(F.sort_array(F.collect_list(F.struct(inner, name))).alias("groups"))


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def concat(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    return df.orderBy(F.rand(seed))


def semi_join(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose column is among another query's keys."""
    return df.join(keys.select(F.col(key).alias("key_")), F.col(column) == F.col("key_"), "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    return df.join(keys.select(F.col(key).alias("key_")), F.col(column) == F.col("key_"), "left_anti")


def lookup_join(df: DataFrame, other: DataFrame, column: str, key: str) -> DataFrame:
    """Rows with those of another query whose key they name, instead of a lookup a row. Clashing names of the other get its key's
    name in front."""
    fields = [F.col(c).alias(c if c not in df.columns else f"{key}_{c}") for c in other.columns]
    return df.join(other.select(F.col(key).alias("key_"), *fields), F.col(column) == F.col("key_")).drop("key_")


def signed_totals(inserted: DataFrame, deleted: DataFrame, keys: list[str], value: str | Column | None = None, name: str = "delta") -> DataFrame:
    """Sums (or counts) of inserted rows less those of deleted rows: what to add to a maintained summary."""
    measure = F.lit(1) if value is None else (F.col(value) if isinstance(value, str) else value)
    plus = inserted.groupBy(*keys).agg(F.sum(measure).alias(name))
    minus = deleted.groupBy(*keys).agg((-F.sum(measure)).alias(name))
    return plus.unionByName(minus).groupBy(*keys).agg(F.sum(name).alias(name)).where(F.col(name) != 0)
