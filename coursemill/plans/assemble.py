"""One row per course: eligibility, outcome, scalar features and the wide export."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions.dates import age_years
from coursemill.functions.nulls import drop_empty_columns, fill_zero
from coursemill.operators.joins import keep_members
from coursemill.operators.reshape import FAMILY, family_safe, pivot_indicators, quoted
from coursemill.plans.cohort import KEYS

# Fixed value: youngest age at the start of a course.
ADULT = 18


def course_table(
    spine: DataFrame,
    patients: DataFrame,
    admissions: DataFrame,
    ed: DataFrame,
    extras: Iterable[DataFrame] = (),
    addresses: DataFrame | None = None,
    min_age: float = ADULT,
    fill: bool = True,
) -> DataFrame:
    """Adult courses with outcome ``adm_ed`` and scalar features, patients in hospital left out.

    ``extras`` are further tables keyed by (pid, course). A table with several rows per course
    (all social answers, say) repeats the course, as does a patient with several addresses.
    """
    people = spine.join(patients, "pid", "left")
    adults = people.withColumn("age", age_years(F.col("start"), F.col("dob"))).where(F.col("age") >= min_age)
    if addresses is not None:
        adults = adults.join(addresses, "pid", "left")
    joined = reduce(lambda a, b: a.join(b, list(KEYS), "left"), [admissions, ed, *extras], adults)
    outcome = F.when((F.col("ed") == 1) | (F.col("admit") == 1), 1).otherwise(0)
    complete = joined.withColumn("adm_ed", outcome)
    # what is missing counts as zero, here and in the filter; the wide export fills only after it has
    # dropped the columns that hold nothing at all
    complete = fill_zero(complete, skip=KEYS) if fill else complete
    return complete.where(F.coalesce("notdisch", F.lit(0)) == 0).drop("notdisch")


def long_store(families: Iterable[DataFrame]) -> DataFrame:
    """All presence families stacked; no join, and no column per feature."""
    return reduce(lambda a, b: a.unionByName(b), families)


def eligible_features(store: DataFrame, courses: DataFrame) -> DataFrame:
    """Store rows of the courses that stayed in."""
    return keep_members(store, courses.select(*KEYS).distinct(), list(KEYS))


def wide_table(courses: DataFrame, store: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Wide export: scalars plus one 0/1 column per stored feature.

    ``courses`` are unfilled (``course_table(fill=False)``): columns without any value are dropped,
    which runs one job over them, and only then do missing values become zero. Feature names that
    several families share are told apart (``reshape.family_safe``).
    """
    wide = pivot_indicators(family_safe(store) if FAMILY in store.columns else store, KEYS, names)
    flags = [c for c in wide.columns if c not in KEYS]
    scalars = fill_zero(drop_empty_columns(courses), skip=KEYS)
    joined = scalars.join(wide, list(KEYS), "left")
    return joined.select(*[quoted(c) for c in scalars.columns], *[F.coalesce(quoted(c), F.lit(0)).alias(c) for c in flags])
