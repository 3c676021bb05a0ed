"""Profiling and validity filters P1-P8.

All profiles are single-pass aggregations (one job, partial aggregation on
the map side, a single-row result), never per-column loops or collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P1 + P2: one row, ``<col>_nulls`` per column, all counted in one pass."""
    cols = cols or df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def numeric_id(col: str) -> Column:
    """The id as BIGINT, or null when it does not parse (``'007'`` -> 7, ``'1.5'`` -> null)."""
    return F.expr(f"try_cast(`{col}` as bigint)")


def is_valid_id(col: str) -> Column:
    """The id parses as a whole number."""
    return numeric_id(col).isNotNull()


def valid_id_counts(df: DataFrame, col: str = "article_id") -> DataFrame:
    """P3 + P4 report: rows with a parseable id and the rest (null or not a number)."""
    return df.agg(F.count_if(is_valid_id(col)).alias("valid_ids"),
                  F.count_if(~is_valid_id(col)).alias("invalid_ids"),
                  F.count("*").alias("total_rows"))


def invalid_id_rows(df: DataFrame, col: str = "article_id") -> DataFrame:
    """The rows that would be quarantined (reported, not silently dropped)."""
    return df.where(~is_valid_id(col))


def keep_valid_ids(df: DataFrame, col: str = "article_id") -> DataFrame:
    """P5."""
    return df.where(is_valid_id(col))


def drop_null_text(df: DataFrame, col: str = "article_text") -> DataFrame:
    """P6."""
    return df.na.drop(subset=[col])


def distinct_values(df: DataFrame, col: str = "bias") -> DataFrame:
    """Distinct values, null kept."""
    return df.select(col).distinct()


def cast_id(df: DataFrame, col: str = "article_id", mode: str = "quarantine") -> DataFrame:
    """String id -> BIGINT.

    ``mode='failfast'`` uses an ANSI cast that raises on a bad value (reference
    behaviour); ``'quarantine'`` (default) uses ``try_cast`` and drops the row,
    which callers report through ``invalid_id_rows``.
    """
    if mode == "failfast":
        return df.withColumn(col, F.col(col).cast("bigint"))
    return df.withColumn(col, numeric_id(col)).where(F.col(col).isNotNull())
