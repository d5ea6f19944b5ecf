"""Cohort queries: plan roll-up, identity, membership, flags, interval assignment, spine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import with_flags
from coursemill.functions.text import has_text
from coursemill.operators import attach_surrogate, drop_members, remap_ids
from coursemill.plans.cohort import (
    assign_courses,
    course_cohort,
    course_spine,
    edge_charges,
    treatment_charges,
    treatment_rows,
)
from coursemill.session import materialise
from coursemill.workload import roles
from coursemill.workload.registry import query

_COHORT = f"""{roles.PLANS}, {roles.PEOPLE},
course0 AS (
  SELECT patient_id, course_id AS course, count(*) AS numplans,
         CASE WHEN count(*) = count(planned_dose) THEN sum(planned_dose) END AS planneddose,
         CASE WHEN count(*) = count(planned_fractions) THEN sum(planned_fractions) END AS plannedfx,
         CASE WHEN count(*) = count(delivered_fractions) THEN sum(delivered_fractions) END AS fx,
         CASE WHEN count(*) = count(delivered_dose) THEN sum(delivered_dose) END AS dose,
         CASE WHEN count(*) = count(revision) THEN max(revision) END AS revisions,
         min(first_day) AS s, max(last_day) AS e
  FROM (SELECT DISTINCT * FROM plan_report WHERE machine NOT IN ('NO', ''))
  WHERE delivered_dose > 0 GROUP BY patient_id, course_id
  HAVING max(last_day) > DATE '1996-12-31' AND min(first_day) < DATE '2001-01-01'),
cohort AS (
  SELECT coalesce(new_id, patient_id) AS mrn, c.* EXCLUDE (patient_id)
  FROM course0 c LEFT JOIN id_change ON old_id = patient_id)"""

_CHARGED = f"""{roles.LINES}, {roles.CHARGES},
known AS (
  SELECT p.mrn, p.pid, service_date, description, attending
  FROM charge LEFT JOIN id_change ON old_id = patient_id
  JOIN person p ON p.mrn = coalesce(new_id, patient_id)
  WHERE attending IS NOT NULL),
treated AS (
  SELECT *, {roles.TECHNIQUES_SQL}
  FROM known WHERE description NOT LIKE '%gizmo%' AND description NOT LIKE '%cold plate%')"""


def _cohort(spark: SparkSession, sf: str, remap: bool = True) -> DataFrame:
    return course_cohort(
        roles.plan_report(spark, sf),
        roles.id_changes(spark, sf) if remap else None,
        roles.MACHINES,
        roles.ENDS_AFTER,
        roles.STARTS_BEFORE,
    )


def _treated(spark: SparkSession, sf: str) -> DataFrame:
    return treatment_charges(
        roles.charges(spark, sf),
        roles.people(spark, sf),
        roles.id_changes(spark, sf),
        roles.NON_TREATMENTS,
        roles.TECHNIQUE_RULES,
    )


_AMOUNTS = ("planneddose", "plannedfx", "fx", "dose")
_AMOUNTS_SQL = ", ".join(f"round({a}, 3) AS {a}" for a in _AMOUNTS)


def _rounded(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.round(c, 3) for c in columns})


@query(
    "plan_rollup",
    f"""WITH {_COHORT}
SELECT mrn, course, numplans, {_AMOUNTS_SQL}, round(revisions, 3) AS revisions, s AS start_day, e AS end_day FROM cohort""",
)
def plan_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = _rounded(_cohort(spark, sf), [*_AMOUNTS, "revisions"])
    return c.withColumnsRenamed({"start": "start_day", "end": "end_day"})


@query(
    "id_remap",
    f"""WITH {roles.LINES}, {roles.PEOPLE}, {roles.CHARGES}
SELECT p.mrn, p.pid, service_date, description, attending
FROM charge LEFT JOIN id_change ON old_id = patient_id JOIN person p ON p.mrn = coalesce(new_id, patient_id)
WHERE attending IS NOT NULL""",
)
def id_remap(spark: SparkSession, sf: str) -> DataFrame:
    current = remap_ids(roles.charges(spark, sf), roles.id_changes(spark, sf), "patient_id", "old_id", "new_id")
    return attach_surrogate(current.withColumnRenamed("patient_id", "mrn"), roles.people(spark, sf), "mrn", "pid")


@query(
    "semi_edge_rows",
    """WITH core AS (SELECT o_custkey AS patient_id, o_orderkey AS charge_id, o_orderdate AS d FROM orders
                     WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'),
edge AS (SELECT o_custkey AS patient_id, o_orderkey AS charge_id, o_orderpriority AS note FROM orders
         WHERE o_orderdate < TIMESTAMP '1997-01-01' OR o_orderdate >= TIMESTAMP '2001-01-01')
SELECT patient_id, charge_id, CAST(d AS DATE) AS service_date, CAST(NULL AS VARCHAR) AS note FROM core
UNION ALL
SELECT patient_id, charge_id, NULL, note FROM edge WHERE patient_id IN (SELECT patient_id FROM core)""",
)
def semi_edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = roles.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderkey").alias("charge_id"),
        roles.day("o_orderdate").alias("service_date"),
        F.col("o_orderpriority").alias("note"),
    )
    inside = (F.col("service_date") >= F.lit("1997-01-01").cast("date")) & (
        F.col("service_date") < F.lit("2001-01-01").cast("date")
    )
    return edge_charges(orders.where(inside).drop("note"), orders.where(~inside).drop("service_date"))


@query(
    "anti_exclude",
    """SELECT p_name, count(*) AS n_parts FROM part
WHERE p_name NOT IN (SELECT DISTINCT p_name FROM part WHERE p_type = 'PROMO' AND p_size > 48) GROUP BY p_name""",
)
def anti_exclude(spark: SparkSession, sf: str) -> DataFrame:
    part = roles.table(spark, sf, "part")
    excluded = part.where((F.col("p_type") == "PROMO") & (F.col("p_size") > 48)).select("p_name").distinct()
    return drop_members(part, excluded, "p_name").groupBy("p_name").agg(F.count(F.lit(1)).alias("n_parts"))


@query(
    "procedure_flags",
    f"""WITH {roles.LINES}, {roles.CHARGES}
SELECT description, count(*) AS n_charges, {roles.TECHNIQUES_SQL}
FROM charge WHERE description NOT LIKE '%gizmo%' AND description NOT LIKE '%cold plate%' GROUP BY description""",
)
def procedure_flags(spark: SparkSession, sf: str) -> DataFrame:
    kept = roles.charges(spark, sf).where(~has_text(F.col("description"), roles.NON_TREATMENTS))
    counted = kept.groupBy("description").agg(F.count(F.lit(1)).alias("n_charges"))
    return with_flags(counted, "description", roles.TECHNIQUE_RULES)


@query(
    "interval_assign",
    f"""WITH {_COHORT}, {_CHARGED}
SELECT t.mrn, t.pid, c.course, t.service_date, t.description, t.attending
FROM treated t JOIN cohort c ON t.mrn = c.mrn AND t.service_date BETWEEN c.s AND c.e""",
)
def interval_assign(spark: SparkSession, sf: str) -> DataFrame:
    cohort = _cohort(spark, sf).select("mrn", "course", "start", "end")
    return assign_courses(cohort, _treated(spark, sf)).select(
        "mrn", "pid", "course", "service_date", "description", "attending"
    )


@query(
    "course_spine",
    f"""WITH {_COHORT}, {_CHARGED},
assigned AS (
  SELECT t.pid, c.*, t.* EXCLUDE (mrn, pid)
  FROM treated t JOIN cohort c ON t.mrn = c.mrn AND t.service_date BETWEEN c.s AND c.e),
usual AS (
  SELECT pid, course, attending FROM (
    SELECT pid, course, attending,
           row_number() OVER (PARTITION BY pid, course ORDER BY count(*) DESC, attending) AS r
    FROM assigned GROUP BY pid, course, attending) WHERE r = 1),
course1 AS (
  SELECT pid, course, min(s) AS s, max(e) AS e,
         {", ".join(f"CASE WHEN count(*) = count({a}) THEN max({a}) END AS {a}" for a in _AMOUNTS)},
         count(*) AS numcharge, {", ".join(f"max({t}) AS {t}" for t in roles.TECHNIQUE_RULES)}
  FROM assigned GROUP BY pid, course)
SELECT pid, course, s AS start_day, e AS end_day, attending, {_AMOUNTS_SQL}, numcharge,
       {", ".join(roles.TECHNIQUE_RULES)}, CAST(e - s AS INTEGER) AS duration
FROM course1 JOIN usual USING (pid, course) WHERE tbi <> 1 AND brachy <> 1""",
)
def spine_query(spark: SparkSession, sf: str) -> DataFrame:
    treatments = treatment_rows(roles.charges(spark, sf), roles.NON_TREATMENTS, roles.TECHNIQUE_RULES)
    cohort = materialise(_cohort(spark, sf), "cohort")
    spine = course_spine(
        cohort, treatments, roles.people(spark, sf), roles.id_changes(spark, sf), roles.TECHNIQUE_RULES
    )
    return _rounded(spine, _AMOUNTS).withColumnsRenamed({"start": "start_day", "end": "end_day"})
