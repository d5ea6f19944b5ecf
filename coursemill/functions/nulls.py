"""Missing-value rules that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict(agg: Callable[[Column], Column], value: Column) -> Column:
    """``agg(value)``, or null when any value of the group is null."""
    return F.when(F.count(F.lit(1)) == F.count(value), agg(value))


def nonblank(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def lacks_text(value: Column, needle: str) -> Column:
    """True when ``needle`` is not in ``value``; a missing value lacks everything."""
    return ~F.coalesce(value.contains(needle), F.lit(False))


def finite(value: Column) -> Column:
    """Null for NaN and both infinities."""
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def fill_zero(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Replace nulls by 0 in numeric columns and by ``"0"`` in text columns."""
    numeric = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    text = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]
    fills = {n: 0 for n in numeric} | {n: "0" for n in text}
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    return df.select(
        *[F.coalesce(quoted[c], F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c) if c in fills else quoted[c] for c in df.columns]
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Only the rows without a null in any column."""
    return df.na.drop("any")


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: how many rows hold a value and how many do not (one scan)."""
    counts = df.select(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
    )
    return counts.unpivot("_rows", df.columns, "column_name", "n_present").select(
        "column_name", "n_present", (F.col("_rows") - F.col("n_present")).alias("n_missing")
    )


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns without any value. Collects one row of counts to settle the schema."""
    row = df.select(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if row[c] > 0])
