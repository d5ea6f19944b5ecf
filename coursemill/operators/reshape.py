"""Code-list explosion, the long feature store and its wide export."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.functions.nulls import nonblank
from coursemill.session import materialise

# Columns of the long feature store.
FEATURE, VALUE, FAMILY = "feature", "value", "family"


def explode_codes(
    df: DataFrame, column: str, separator: str, alias: str, max_slots: int | None = None
) -> DataFrame:
    """One row per code of a delimited list; blank and missing codes give none.

    ``max_slots`` keeps only the leading codes of each list.
    """
    codes = F.split(F.col(column), re.escape(separator))
    if max_slots is not None:
        codes = F.slice(codes, 1, max_slots)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(codes).alias(alias)).where(nonblank(F.col(alias)))


def longest_list(df: DataFrame, column: str, separator: str) -> DataFrame:
    """One row: the largest number of codes in any list."""
    return df.agg(F.max(F.size(F.split(F.col(column), re.escape(separator)))).alias("max_codes"))


def prefixed(prefix: str, name: Column, missing: str = "NA") -> Column:
    """Feature name with its family prefix; a missing name is spelled out."""
    return F.concat(F.lit(prefix), F.coalesce(name, F.lit(missing)))


def long_features(
    df: DataFrame, keys: Iterable[str], family: str, prefix: str, name: str, unique: bool = False
) -> DataFrame:
    """Distinct presence rows ``(keys, family, feature, value=1)``.

    ``unique`` says that (keys, name) are distinct already, which spares a shuffle of the result.
    """
    rows = df.select(*keys, F.lit(family).alias(FAMILY), prefixed(prefix, F.col(name)).alias(FEATURE))
    return (rows if unique else rows.distinct()).withColumn(VALUE, F.lit(1.0))


def pivot_indicators(long: DataFrame, keys: Iterable[str], names: list[str] | None = None) -> DataFrame:
    """Wide 0/1 export. Pass ``names`` to fix the columns and spare the discovery job."""
    keys = list(keys)
    if names is None:
        names = [r[0] for r in long.select(FEATURE).distinct().orderBy(FEATURE).collect()]
    wide = long.groupBy(*keys).pivot(FEATURE, names).agg(F.max(F.lit(1)))
    return wide.select(*keys, *[F.coalesce(quoted(n), F.lit(0)).alias(n) for n in names])


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def family_safe(long: DataFrame) -> DataFrame:
    """Rows whose feature name occurs in several families get it as ``feature.family``.

    The shared names are written to the shared folder while the plan is built: where they are few, Spark sees it and the
    rows stay where they are.
    """
    names = long.select(FAMILY, FEATURE).distinct()
    shared = names.groupBy(FEATURE).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(FEATURE, F.lit(True).alias("_shared"))
    shared = materialise(shared, "shared-names")
    renamed = F.when(F.col("_shared"), F.concat_ws(".", FEATURE, FAMILY)).otherwise(F.col(FEATURE))
    return long.join(shared, FEATURE, "left").withColumn(FEATURE, renamed).select(long.columns)
