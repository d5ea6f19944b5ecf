"""Queries over every family at once: the full long store, its variance profile and the final courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import parse_date, parse_number
from coursemill.learning import prepare
from coursemill.operators.reshape import family_safe
from coursemill.plans import assemble, features
from coursemill.plans.cohort import KEYS
from coursemill.plans.tables import bucketed
from coursemill.session import materialise
from coursemill.workload import codes, families, roles
from coursemill.workload.registry import query, sql_twins

#: The queries whose results are stored; ``_family_parts`` computes them from shared tables.
_FAMILY_QUERIES = ("agent_windows", "med_windows", "abnormal_labs", "prior_procs", "course_diagnoses", "history_union")


def _all_sql() -> str:
    twins = sql_twins()
    parts = [f"SELECT pid, course, family, feature FROM ({twins[q]})" for q in _FAMILY_QUERIES]
    return f"(SELECT DISTINCT s.pid, s.course, family, feature FROM ({' UNION ALL '.join(parts)}) s JOIN ({twins['final_assembly']}) c ON c.pid = s.pid AND c.course = s.course)"


# Written once per (session, data), shared by the queries below.
_STORES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def full_store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(final courses, long store of all families for these courses); each is computed and written once.

    Orders and lines are written once, clustered by patient, so that no family shuffles its rows.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        lines = roles.by_patient(roles.lines(spark, sf), "lines")
        orders = bucketed(roles.table(spark, sf, "orders").withColumn("pid", F.col("o_custkey")), "orders", ["pid"]).withColumn("o_custkey", F.col("pid"))
        courses = bucketed(families.final_courses(spark, sf, orders=orders, lines=lines), "full_courses", KEYS, by=["pid"])
        parts = [assemble.eligible_features(p, courses) for p in _family_parts(spark, sf, roles.spine(spark, sf, orders), lines)]
        # one after the other: together they would share the memory of a task
        _STORES[key] = courses, assemble.long_store([materialise(p.select(*KEYS, "family", "feature", "value"), "full-store") for p in parts])
    return _STORES[key]


def _family_parts(spark: SparkSession, sf: str, spine: DataFrame, lines: DataFrame) -> list[DataFrame]:
    """What the family queries return, agents and classes of drugs in one pass."""
    return [
        features.drug_features(spine, roles.medications(spark, sf, lines), roles.drug_dictionary(spark, sf), roles.AGENT_KEYWORD, roles.AGENT_EXCLUDED),
        features.abnormal_labs(spine, roles.labs(spark, sf, lines)),
        families._procedures(spark, sf, spine, lines),
        codes._course_diagnoses(spark, sf, spine, codes._charged(spark, sf, lines)),
        codes._past_history(spark, sf, spine, lines),
    ]


_SAFE = """names AS (SELECT DISTINCT family, feature FROM stored),
shared AS (SELECT feature FROM names GROUP BY feature HAVING count(*) > 1)"""


@query(
    "full_store",
    f"""WITH stored AS (SELECT * FROM {_all_sql()}), {_SAFE}
SELECT family, CASE WHEN feature IN (SELECT feature FROM shared) THEN feature || '.' || family ELSE feature END AS feature, count(*) AS n_courses
FROM stored GROUP BY ALL""",
)
def full_store_query(spark: SparkSession, sf: str) -> DataFrame:
    """Courses per feature over all families; names that families share are told apart."""
    _, store = full_store(spark, sf)
    return family_safe(store).groupBy("family", "feature").agg(F.count(F.lit(1)).alias("n_courses"))


@query(
    "nzv_all_families",
    f"""WITH stored AS (SELECT * FROM {_all_sql()}), size AS (SELECT count(*) AS n FROM ({sql_twins()["final_assembly"]})),
present AS (SELECT family, feature, count(*) AS c FROM stored GROUP BY 1, 2),
prof AS (
  SELECT family, feature, CASE WHEN c < n THEN 2 ELSE 1 END AS n_unique,
         CASE WHEN c < n THEN CAST(greatest(c, n - c) AS DOUBLE) / least(c, n - c) ELSE 0 END AS freq_ratio, n FROM present, size)
SELECT family, feature, round(freq_ratio, 6) AS freq_ratio, n_unique = 1 OR (freq_ratio > 19 AND 100.0 * n_unique / n <= 10) AS nzv FROM prof""",
)
def nzv_all_families(spark: SparkSession, sf: str) -> DataFrame:
    """Variance profile by (family, feature) over the whole store."""
    courses, store = full_store(spark, sf)
    profile = prepare.near_zero_variance(store, courses.count())
    return profile.select("family", "feature", F.round("freq_ratio", 6).alias("freq_ratio"), "nzv")


@query(
    "text_repair",
    """WITH t AS (
  SELECT o_orderkey, '  ' || month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) ||
         CASE o_orderstatus WHEN 'F' THEN ' 10:05:30' WHEN 'O' THEN ' 10:05' ELSE ' soon' END AS stamp,
         ' ' || substr(o_orderpriority, 1, 1) || CASE WHEN o_orderstatus = 'F' THEN '0+ ' WHEN o_orderstatus = 'O' THEN '.5' ELSE ' none' END AS amount
  FROM orders)
SELECT o_orderkey, CAST(try_strptime(regexp_extract(stamp, '([0-9]+/[0-9]+/[0-9]+)', 1), '%m/%d/%Y') AS DATE) AS day,
       CASE WHEN regexp_matches(stamp, ' [0-9]+:[0-9]+:[0-9]+') THEN CAST(try_strptime(regexp_extract(stamp, '([0-9]+/[0-9]+/[0-9]+)', 1), '%m/%d/%Y') AS DATE) END AS timed_day,
       TRY_CAST(rtrim(trim(amount), '+') AS DOUBLE) AS amount
FROM t""",
)
def text_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Date and number text of the raw tables, with and without a clock part, as typed columns."""
    status, date = F.col("o_orderstatus"), F.col("o_orderdate").cast("date")
    stamp = F.concat(
        F.lit("  "), F.date_format(date, "M/d/yyyy"), F.when(status == "F", " 10:05:30").when(status == "O", " 10:05").otherwise(" soon")
    )
    amount = F.concat(
        F.lit(" "), F.substring("o_orderpriority", 1, 1), F.when(status == "F", "0+ ").when(status == "O", ".5").otherwise(" none")
    )
    return roles.table(spark, sf, "orders").select(
        "o_orderkey",
        parse_date(stamp).alias("day"),
        parse_date(stamp, "second").alias("timed_day"),
        parse_number(amount).alias("amount"),
    )



