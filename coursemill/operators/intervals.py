"""Point-in-interval and lookback joins on (key, time bucket).

An equi-join on the entity alone would meet every event of an entity with each of its intervals
before the dates are compared. Here the time axis is cut into fixed buckets, intervals are repeated
once per bucket they touch and a point has exactly one bucket, so that only near pairs meet, no pair
appears twice and the rows of a hot entity spread over as many tasks as it has buckets.

Intervals of any length, open-ended ones too, are cut into dyadic pieces instead: a piece of level k is
2^k buckets that start at a multiple of 2^k. An interval of n buckets has at most 2 log2(n) pieces, which do not
overlap, and a point lies in one piece of each level, so that again no pair appears twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.functions.dates import day_number

_BUCKET = "_bucket"


def _bucket(day: Column, width: int) -> Column:
    return F.floor(day_number(day) / F.lit(width)).cast("int")


def point_in_interval(
    points: DataFrame,
    intervals: DataFrame,
    keys: Iterable[str],
    point: str,
    low: str,
    high: str,
    bucket_days: int = 64,
) -> DataFrame:
    """Pairs with equal ``keys`` and ``low <= point <= high`` (dates). Empty intervals match nothing.

    Apart from ``keys`` the two frames must not share column names.
    """
    placed = points.where(F.col(point).isNotNull()).withColumn(_BUCKET, _bucket(F.col(point), bucket_days))
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn(
        _BUCKET,
        F.explode(F.sequence(_bucket(F.col(low), bucket_days), _bucket(F.col(high), bucket_days))),
    )
    near = placed.join(spread, [*keys, _BUCKET])
    return near.where(F.col(point).between(F.col(low), F.col(high))).drop(_BUCKET)


def days_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: Iterable[str], values: Iterable[str], point: str, low: str, high: str
) -> DataFrame:
    """Distinct (``keys``, ``point``, ``values``) for which an interval ``low`` to ``high`` of these values holds the point (dates).

    ``points`` are distinct (``keys``, ``point``). Only whether an interval holds a day matters, so all intervals of a key and its
    values become one 64-bit mask per 64 days: what meets the points is bounded by calendar and values, however many intervals
    a key has, and no pair appears twice.
    """
    keys, values, width = list(keys), list(values), 64
    first, last = day_number(F.col(low)), day_number(F.col(high))
    spread = intervals.where(F.col(low) <= F.col(high)).select(
        *keys, *values, first.alias("_first"), last.alias("_last"), F.explode(F.sequence(_bucket(F.col(low), width), _bucket(F.col(high), width))).alias(_BUCKET)
    )
    begin = F.greatest(F.col("_first") - F.col(_BUCKET) * width, F.lit(0))
    behind = F.lit(width - 1) - F.least(F.col("_last") - F.col(_BUCKET) * width, F.lit(width - 1))
    every = F.lit(-1).cast("long")
    mask = F.call_function("shiftleft", every, begin.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", every, behind.cast("int")))
    merged = spread.groupBy(*keys, _BUCKET, *values).agg(F.bit_or(mask).alias("_mask"))
    placed = points.where(F.col(point).isNotNull()).withColumn(_BUCKET, _bucket(F.col(point), width))
    met = placed.join(merged, [*keys, _BUCKET])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (day_number(F.col(point)) - F.col(_BUCKET) * width).cast("int"))
    return met.where(F.col("_mask").bitwiseAND(bit) != 0).drop(_BUCKET, "_mask")


# Buckets are numbered from here on, so that all dates from year 1 to 9999 have positive numbers.
_ORIGIN, _LEVELS = 1 << 20, 23


def dyadic_pieces(low: Column, high: Column) -> Column:
    """Array of (level, piece) that make up the buckets ``low`` to ``high``.

    Going up the levels, the rest runs from ceil(low / 2^k) to floor((high + 1) / 2^k); where an end is odd,
    its last piece belongs to this level.
    """
    first, behind = low.cast("long") + _ORIGIN, high.cast("long") + (_ORIGIN + 1)

    def at(k: int) -> list[Column]:
        left = F.shiftright(first + ((1 << k) - 1), k)
        right = F.shiftright(behind, k)
        rest = left < right
        piece = lambda number: F.struct(F.lit(k).alias("level"), number.alias("piece"))
        return [
            F.when(rest & (left % 2 == 1), piece(left)),
            F.when(rest & (right % 2 == 1), piece(right - 1)),
        ]

    return F.array_compact(F.array(*[p for k in range(_LEVELS) for p in at(k)]))


def point_in_any_interval(
    points: DataFrame,
    intervals: DataFrame,
    keys: Iterable[str],
    point: str,
    low: str,
    high: str,
    bucket_days: int = 64,
) -> DataFrame:
    """As ``point_in_interval``, for intervals of any length: each is at most some forty rows.

    Points are looked up on the levels that occur among the intervals, which a first pass over these collects from the
    distinct buckets they run between; where all are short these are the lowest few.
    """
    cut = intervals.where(F.col(low) <= F.col(high)).withColumn(
        "_p", F.explode(dyadic_pieces(_bucket(F.col(low), bucket_days), _bucket(F.col(high), bucket_days)))
    )
    spread = cut.select(*intervals.columns, F.col("_p.level").alias("_level"), F.col("_p.piece").alias("_piece"))
    ends = intervals.where(F.col(low) <= F.col(high)).select(
        _bucket(F.col(low), bucket_days).alias("_first"), _bucket(F.col(high), bucket_days).alias("_last")
    )
    pieces = ends.distinct().select(F.explode(dyadic_pieces(F.col("_first"), F.col("_last"))).alias("_p"))
    levels = F.coalesce(pieces.agg(F.sort_array(F.collect_set("_p.level"))).scalar(), F.array().cast("array<int>"))
    number = _bucket(F.col(point), bucket_days).cast("long") + _ORIGIN
    placed = points.where(F.col(point).isNotNull()).withColumn("_level", F.explode(levels))
    placed = placed.withColumn("_piece", F.call_function("shiftright", number, F.col("_level")))
    near = placed.join(spread, [*keys, "_level", "_piece"])
    return near.where(F.col(point).between(F.col(low), F.col(high))).drop("_level", "_piece")


def lookback_join(
    spine: DataFrame,
    events: DataFrame,
    keys: Iterable[str],
    start: str,
    day: str,
    oldest: int | None,
    newest: int = 0,
    bucket_days: int = 64,
) -> DataFrame:
    """Event rows with ``newest <= start - day <= oldest`` days, each with the course it precedes.

    ``oldest=None`` has no lower bound; such pairs cannot be bucketed and are joined on the entity,
    so reduce ``events`` to first dates beforehand (see ``plans.features.first_seen``).
    """
    keys = list(keys)
    if oldest is None:
        joined = events.join(spine, keys)
        return joined.where(F.col(day) <= F.date_sub(F.col(start), newest))
    windows = spine.withColumns(
        {"_low": F.date_sub(F.col(start), oldest), "_high": F.date_sub(F.col(start), newest)}
    )
    return point_in_interval(events, windows, keys, day, "_low", "_high", bucket_days).drop("_low", "_high")
