"""Grouped reductions with explicit null and order rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.functions.nulls import strict


def rollup_plans(
    lines: DataFrame,
    keys: Iterable[str],
    sums: dict[str, str],
    maxima: dict[str, str],
    start: str,
    end: str,
) -> DataFrame:
    """Plan lines to one row per course: count, null-propagating sums and maxima, date range."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("numplans")]
    aggregates += [strict(F.sum, F.col(source)).alias(name) for name, source in sums.items()]
    aggregates += [strict(F.max, F.col(source)).alias(name) for name, source in maxima.items()]
    aggregates += [strict(F.min, F.col(start)).alias("start"), strict(F.max, F.col(end)).alias("end")]
    return lines.groupBy(*keys).agg(*aggregates)


def first_by_order(df: DataFrame, key: str, value: str, order: str, alias: str | None = None) -> DataFrame:
    """The value of each key's first row in ``order``."""
    return df.groupBy(key).agg(F.min_by(F.col(value), F.col(order)).alias(alias or value))


def modal_value(
    df: DataFrame, keys: Iterable[str], value: str, weight: Column | None = None, alias: str = "mode"
) -> DataFrame:
    """Most frequent non-null value per key, the lowest one on a tie.

    Counts per (key, value) first, so a hot key is spread over its values and combined map-side.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(weight if weight is not None else F.lit(1)).alias("_n"))
    )
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(alias))


def top_rows(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows with the largest ``by`` (a top-k report), ties by ``tie``."""
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)
