"""Exact global ranks and running totals without a single-task window.

An ordered window over a whole table (or a hot stratum) runs in one task. Rows are instead cut
into ordered buckets, numbered inside their bucket and shifted by the totals of the buckets before
it. Bucket totals are at most (groups x buckets) rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3  # leading hex digits, 4096 buckets unless asked for more


def join_null_safe(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Inner join in which a null key equals a null key; the keys come once."""
    keys = list(keys)
    other = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"_other_{k}" for k in keys])


def cumulative_totals(
    df: DataFrame,
    groups: Iterable[str],
    bucket: str,
    order: Iterable[Column],
    totals: dict[str, str],
    bucket_desc: bool = False,
    overall: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums: ``totals`` maps output names to summed columns.

    ``bucket`` must be monotone in ``order`` (falling when ``bucket_desc``). ``overall`` names the
    group total of some of the ``totals``, which comes with the bucket totals at no extra pass.
    ``df`` is read twice, so a costly one should be written first (``session.materialise``).
    """
    overall = overall or {}
    groups, order = list(groups), list(order)
    per_bucket = df.groupBy(*groups, bucket).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    b = F.col(bucket).desc() if bucket_desc else F.col(bucket)
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *groups,
        bucket,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
        *[F.sum(f"_sum_{n}").over(Window.partitionBy(*groups)).alias(name) for n, name in overall.items()],
    )
    within = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_local_{n}": F.sum(c).over(within) for n, c in totals.items()})
    joined = join_null_safe(local, offsets, [*groups, bucket])
    return joined.withColumns(
        {n: F.col(f"_before_{n}") + F.col(f"_local_{n}") for n in totals}
    ).drop(*[f"_before_{n}" for n in totals], *[f"_local_{n}" for n in totals])


def uniform_key(keys: Iterable[str], seed: int) -> Column:
    """Repeatable, evenly spread text key: md5 over the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffled_rank(
    df: DataFrame,
    keys: Iterable[str],
    seed: int,
    alias: str,
    groups: Iterable[str] = (),
    size: str | None = None,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Rank 1..n (per group) in the repeatable random order of ``uniform_key``; ``size`` names n."""
    placed = df.withColumns({"_u": uniform_key(keys, seed), "_one": F.lit(1)}).withColumn(
        "_b", F.substring("_u", 1, digits)
    )
    overall = {alias: size} if size else {}
    return cumulative_totals(placed, groups, "_b", [F.col("_u")], {alias: "_one"}, overall=overall).drop(
        "_u", "_b", "_one"
    )


def hash_split(
    df: DataFrame, keys: Iterable[str], stratum: str, fraction: float = 0.75, seed: int = 220, digits: int = HASH_DIGITS
) -> DataFrame:
    """Exact stratified split: adds ``is_train``, true for ceil(fraction * n) rows per stratum; null is a stratum."""
    ranked = shuffled_rank(df, keys, seed, "_rank", [stratum], size="_n", digits=digits)
    return ranked.withColumn("is_train", F.col("_rank") <= F.ceil(F.col("_n") * F.lit(fraction))).drop("_rank", "_n")
