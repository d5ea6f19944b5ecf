"""From plan lines and charges to the course spine."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.functions.nulls import drop_incomplete, strict
from coursemill.functions.text import has_text, with_flags
from coursemill.operators.intervals import point_in_any_interval
from coursemill.operators.joins import keep_members, remap_ids
from coursemill.operators.rollups import rollup_plans

KEYS = ("pid", "course")

# Satellite machines (and blank) whose plan lines are left out.
EXCLUDED_MACHINES = ("TBCary", "TBMacon", "2100DRH", "21DHRH", "TBRaleigh", "", "21MPMC")

# Study window, a course must end after the first and start before the second day.
STUDY_AFTER, STUDY_BEFORE = "2012-12-31", "2017-01-01"

# Charge descriptions that are not treatments.
NON_TREATMENT = ("marker", "Ultrasound")

# Treatment technique by charge description.
TECHNIQUES: dict[str, dict[str, tuple[str, ...]]] = {
    "srssbrt": {
        "equals": (
            "Robotic SRS -SBRT Radiation Therapy- 1st treatment",
            "Steriotactic Body / SRT cranial  course not to exceed 5 fractions",
        ),
        "contains": ("Stereo",),
    },
    "conv": {"contains": ("Treatment Delivery",)},
    "imrtvmat": {
        "equals": (
            "Intensity modulated treatm delivery, single or multiple fields",
            "IMRT- Rapid Arc",
        )
    },
    "brachy": {"contains": ("Brachy", "HDR", "Insertion", "Interstitial", "marker")},
    "tbi": {"equals": ("Total Body Photon Irradiation",)},
    "tsi": {"equals": ("Total Body Electron Irradiation", "Total body -  Electron")},
}
EXCLUDED_TECHNIQUES = ("tbi", "brachy")

# Names of a plan report's amounts, as sums and maxima over the lines of a course.
PLAN_SUMS = {
    "planneddose": "planned_dose",
    "plannedfx": "planned_fractions",
    "fx": "delivered_fractions",
    "dose": "delivered_dose",
}
PLAN_MAXIMA = {"revisions": "revision"}


def course_cohort(
    plan_report: DataFrame,
    id_changes: DataFrame | None = None,
    excluded_machines: Iterable[str] = EXCLUDED_MACHINES,
    ends_after: str = STUDY_AFTER,
    starts_before: str = STUDY_BEFORE,
) -> DataFrame:
    """One row per (original id, course) inside the study window, with ids brought up to date."""
    # shuffled once, for the distinct lines and their roll-up
    lines = (
        plan_report.where(~F.col("machine").isin(list(excluded_machines)) & (F.col("delivered_dose") > 0))
        .repartition("patient_id", "course_id")
        .distinct()
    )
    courses = rollup_plans(
        lines, ["patient_id", "course_id"], PLAN_SUMS, PLAN_MAXIMA, "first_day", "last_day"
    ).where((F.col("end") > F.lit(ends_after).cast("date")) & (F.col("start") < F.lit(starts_before).cast("date")))
    if id_changes is not None:
        courses = remap_ids(courses, id_changes, "patient_id", "old_id", "new_id")
    return courses.withColumnsRenamed({"patient_id": "mrn", "course_id": "course"})


def edge_charges(core: DataFrame, edge: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """``core`` plus those ``edge`` rows whose patient is in ``core``."""
    extra = keep_members(edge, core.select(id_col).distinct(), id_col)
    return core.unionByName(extra, allowMissingColumns=True)


def treatment_rows(
    charges: DataFrame,
    non_treatment: Iterable[str] = NON_TREATMENT,
    techniques: Mapping[str, Mapping[str, Iterable[str]]] = TECHNIQUES,
) -> DataFrame:
    """Complete charges that are treatments, with technique flags. Filters and projections only."""
    treatments = drop_incomplete(charges).where(~has_text(F.col("description"), non_treatment))
    return with_flags(treatments, "description", techniques)


def identify(rows: DataFrame, people: DataFrame, id_changes: DataFrame | None = None) -> DataFrame:
    """Current record number ``mrn`` and surrogate ``pid`` in place of ``patient_id``; strangers go."""
    current = people.select(F.col("mrn").alias("_id"), "mrn", "pid")
    if id_changes is not None:
        # one table from any id to the current ones, so that the rows are shuffled for ids once
        moved = id_changes.select(F.col("old_id").alias("_id"), F.coalesce("new_id", "old_id").alias("mrn")).distinct()
        kept = current.join(moved.select("_id").distinct(), "_id", "left_anti")
        current = kept.unionByName(moved.join(people.select("mrn", "pid"), "mrn"))
    joined = rows.join(current, rows["patient_id"] == current["_id"])
    others = [c for c in rows.columns if c != "patient_id"]
    return joined.where(F.col("pid").isNotNull()).select("mrn", *others, "pid")


def treatment_charges(
    charges: DataFrame,
    people: DataFrame,
    id_changes: DataFrame | None = None,
    non_treatment: Iterable[str] = NON_TREATMENT,
    techniques: Mapping[str, Mapping[str, Iterable[str]]] = TECHNIQUES,
) -> DataFrame:
    """Row by row: treatments with technique flags under current ids."""
    return identify(treatment_rows(charges, non_treatment, techniques), people, id_changes)


def assign_courses(cohort: DataFrame, charges: DataFrame, on: str = "mrn") -> DataFrame:
    """Charges with every course of the same patient whose date range, open-ended or not, holds the service date."""
    return point_in_any_interval(charges, cohort, [on], "service_date", "start", "end")


def course_spine(
    cohort: DataFrame,
    treatments: DataFrame,
    people: DataFrame,
    id_changes: DataFrame | None = None,
    techniques: Iterable[str] = tuple(TECHNIQUES),
    excluded: Iterable[str] = EXCLUDED_TECHNIQUES,
) -> DataFrame:
    """One row per (pid, course) with dates, amounts, technique flags and usual attending.

    ``treatments`` come from ``treatment_rows``. The result equals a roll-up over
    ``assign_courses``, but charges are summed per patient, day and attending before anything is
    joined, and courses reduced to distinct date ranges, so that a patient with very many charges
    or courses meets at most one row per day and attending for each range. Courses without any
    charge, and those with an excluded technique, are left out. ``cohort`` is read twice: pass a
    written one (``session.materialise``).
    """
    techniques, excluded = list(techniques), list(excluded)
    per_day = treatments.groupBy("patient_id", "service_date", "attending").agg(
        F.count(F.lit(1)).alias("_charges"), *[F.max(t).alias(t) for t in techniques]
    )
    daily = identify(per_day, people, id_changes)
    ranges = cohort.select("mrn", "start", "end").distinct()
    per_range = (
        point_in_any_interval(daily, ranges, ["mrn"], "service_date", "start", "end")
        .groupBy("mrn", "pid", "start", "end", "attending")
        .agg(F.sum("_charges").alias("_charges"), *[F.max(t).alias(t) for t in techniques])
    )
    amounts = [c for c in PLAN_SUMS if c in cohort.columns]
    parts = cohort.select("mrn", "course", "start", "end", *amounts).join(per_range, ["mrn", "start", "end"])
    by_attending = parts.groupBy(*KEYS, "attending").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("_charges").alias("_charges"),
        *[strict(F.max, F.col(a)).alias(a) for a in amounts],
        *[F.max(t).alias(t) for t in techniques],
    )
    usual = F.min_by("attending", F.when(F.col("attending").isNotNull(), F.struct(-F.col("_charges"), "attending")))
    spine = by_attending.groupBy(*KEYS).agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        usual.alias("attending"),
        *[strict(F.max, F.col(a)).alias(a) for a in amounts],
        F.sum("_charges").alias("numcharge"),
        *[F.max(t).alias(t) for t in techniques],
    )
    for flag in excluded:
        spine = spine.where(F.col(flag) != 1)
    return spine.withColumn("duration", F.datediff("end", "start"))
