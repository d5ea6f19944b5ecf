"""Equi-joins used for identity, membership and dictionaries.

None carries a broadcast hint. Dictionaries and id lists are usually small, and then Spark (from
file statistics, or AQE from the measured shuffle) broadcasts them by itself; where one is not
small the same plan runs as a sort-merge join whose hot keys AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions.nulls import drop_incomplete


def remap_ids(df: DataFrame, changes: DataFrame, id_col: str, old: str, new: str) -> DataFrame:
    """Replace ``id_col`` by its new id where ``changes`` has one."""
    lookup = changes.select(F.col(old).alias("_old_id"), F.col(new).alias("_new_id")).distinct()
    joined = df.join(lookup, F.col(id_col) == F.col("_old_id"), "left")
    return joined.withColumn(id_col, F.coalesce("_new_id", id_col)).drop("_old_id", "_new_id")


def attach_surrogate(
    df: DataFrame, people: DataFrame, on: str, surrogate: str, complete_rows: bool = True
) -> DataFrame:
    """Add the surrogate id; by default rows with any missing value, or no match, are dropped."""
    ids = people.select(F.col(on), F.col(surrogate))
    joined = df.join(ids, on, "left")
    return drop_incomplete(joined) if complete_rows else joined


def keep_members(df: DataFrame, members: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(members, on, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(members, on, "left_anti")


def backfill(spine: DataFrame, features: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Every spine key once per feature row, or once with nulls where there is none."""
    keys = list(keys)
    return spine.select(*keys).join(features, keys, "left")


def map_values(df: DataFrame, column: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Substitute values through a one-to-one mapping; values it does not list pass through."""
    lookup = mapping.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    joined = df.join(lookup, F.col(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
