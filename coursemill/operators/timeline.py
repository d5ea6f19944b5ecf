"""Aggregates over days before (or after) an anchor date, without joining events to anchors.

Events are first reduced to one row per (entity, day), which map-side combine does ahead of the
shuffle. Day rows and anchor rows are then stacked and each anchor reads its aggregates from a range
frame over days. An entity therefore costs one sort of at most (distinct event days + distinct
anchor days) rows: a bound set by the calendar and not by how many raw rows it holds.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursemill.functions.dates import day_number


@dataclass(frozen=True)
class Measure:
    """One aggregate of a day-grain column over the days around an anchor.

    ``how`` is ``sum``, ``max``, ``min`` or ``last`` (latest non-null). The frame covers ages (days
    before the anchor) from ``newest`` to ``oldest``; ``oldest=None`` has no bound. With
    ``after=True`` the frame covers all days strictly after the anchor instead.
    """

    name: str
    how: str
    column: str
    oldest: int | None = None
    newest: int = 0
    after: bool = False


def by_day(events: DataFrame, keys: Iterable[str], day: str, **aggregates: Column) -> DataFrame:
    """One row per entity and day. Rows without a day are dropped."""
    grouped = events.where(F.col(day).isNotNull()).groupBy(*keys, F.col(day).alias("day"))
    return grouped.agg(*[column.alias(name) for name, column in aggregates.items()])


_AGGREGATES = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def timeline_profile(
    anchors: DataFrame, daily: DataFrame, keys: Iterable[str], at: str, measures: Iterable[Measure]
) -> DataFrame:
    """One row per distinct (keys, ``at``) with every measure; null where its frame is empty."""
    keys, measures = list(keys), list(measures)
    used = sorted({m.column for m in measures if m.column != "day"})
    events = daily.select(*keys, "day", *used, day_number(F.col("day")).alias("_t"), F.lit(False).alias("_anchor"))
    stops = (
        anchors.select(*keys, F.col(at).alias("_at"))
        .where(F.col("_at").isNotNull())
        .distinct()
        .select(*keys, "_at", day_number(F.col("_at")).alias("_t"), F.lit(True).alias("_anchor"))
    )
    stacked = events.unionByName(stops, allowMissingColumns=True)
    forward = Window.partitionBy(*keys).orderBy("_t")
    backward = Window.partitionBy(*keys).orderBy(F.col("_t").desc())

    def frame(m: Measure):
        if m.after:
            return backward.rangeBetween(Window.unboundedPreceding, -1)
        low = Window.unboundedPreceding if m.oldest is None else -m.oldest
        return forward.rangeBetween(low, -m.newest)

    values = {m.name: _AGGREGATES[m.how](F.col(m.column)).over(frame(m)) for m in measures}
    return (
        stacked.select(*keys, "_at", "_anchor", *[v.alias(n) for n, v in values.items()])
        .where("_anchor")
        .select(*keys, F.col("_at").alias(at), *values)
    )
