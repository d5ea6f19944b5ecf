"""Sinks. Every write stays distributed; no sink gathers rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemill.sources.names import sanitise


def write_keys(df: DataFrame, column: str, path: str) -> None:
    """Export the distinct values of one column (an identifier or name list)."""
    df.select(column).distinct().write.mode("overwrite").csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; missing values are written as ``NA``, empty text as ``""``."""
    flat = df.select(
        *[
            F.when(F.col(f"`{f.name}`").isNull(), F.lit("NA")).otherwise(F.col(f"`{f.name}`").cast("string")).alias(f.name)
            if isinstance(f.dataType, (T.StringType, T.DateType, T.NumericType, T.BooleanType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
    flat.write.mode("overwrite").csv(path, header=True, emptyValue='""')


def write_table(df: DataFrame, path: str, *, csv_copy: str | None = None) -> None:
    """Parquet as the canonical form, with repaired names, and optionally a CSV copy."""
    named = sanitise(df)
    named.write.mode("overwrite").parquet(path)
    if csv_copy:
        write_csv(df.sparkSession.read.parquet(path), csv_copy)
