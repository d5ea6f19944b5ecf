"""The whole run: raw plan lines and charges to one repaired wide row per course, through 18 course tables.

Source rows carry record numbers; they get current surrogate ids first. Lines, orders and customers under
these ids are written once, bucketed by patient, and every family reads them. Each family's course table is written
bucketed by (pid, course), and the tables meet the spine without an exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import drop_empty_columns, fill_zero
from coursemill.functions.dates import age_years
from coursemill.plans import assemble, features
from coursemill.plans.cohort import KEYS, course_spine, identify, treatment_rows
from coursemill.plans.tables import bucketed, expand_positions, feature_positions, join_bucketed, position_table
from coursemill.session import materialise
from coursemill.sources.names import syntactic_names
from coursemill.workload import codes, families, roles
from coursemill.workload import cohort as cohort_queries
from coursemill.workload.registry import query

#: The presence families, in the order of their columns.
PRESENCE = (
    "coursedx", "coursesub", "recagent", "conagent", "recclass", "conclass", "pmhsub", "curmed", "recmed", "lab", "proc", "cpt",
)


@dataclass(frozen=True)
class Run:
    spine: DataFrame  # final courses of the cohort, bucketed
    scalars: dict[str, DataFrame]  # course tables with named columns, bucketed
    store: DataFrame  # (pid, course, family, feature) of all presence families
    positions: DataFrame  # (family, feature, name, position) among adult courses
    presence: dict[str, DataFrame]  # one position array per course and family, bucketed


# Computed once per (session, data), shared by the queries below.
_RUNS: dict[tuple[str, str], Run] = {}


def _sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, orders, customers) under current surrogate ids, bucketed by patient; one customer per patient."""
    people, changes = roles.people(spark, sf), roles.id_changes(spark, sf)

    def known(rows: DataFrame, number: str) -> DataFrame:
        return identify(rows.withColumn("patient_id", F.col(number).cast("string")).drop(number), people, changes)

    # the owners are identified, not their many lines; these keep the record number for the charges
    owner = known(roles.owners(spark, sf).withColumn("_number", F.col("pid").cast("string")), "pid")
    lines = roles.by_patient(roles.lines(spark, sf, owner=owner), "lines").withColumnRenamed("_number", "patient_id")
    orders = known(roles.table(spark, sf, "orders"), "o_custkey").withColumn("o_custkey", F.col("pid"))
    customers = known(roles.table(spark, sf, "customer").withColumn("_number", F.col("c_custkey")), "c_custkey")
    first = customers.groupBy("pid").agg(F.min_by(F.struct("*"), "_number").alias("c")).select("c.*").withColumn("c_custkey", F.col("pid"))
    return lines, bucketed(orders, "orders", ["pid"]), bucketed(first, "customers", ["pid"])


def course_run(spark: SparkSession, sf: str) -> Run:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = _computed(spark, sf)
    return _RUNS[key]


def _computed(spark: SparkSession, sf: str) -> Run:
    people, changes = roles.people(spark, sf), roles.id_changes(spark, sf)
    cohort = materialise(cohort_queries._cohort(spark, sf), "cohort")
    lines, orders, customers = _sources(spark, sf)
    treatments = treatment_rows(roles.charges(spark, sf, lines), roles.NON_TREATMENTS, roles.TECHNIQUE_RULES)
    spine = bucketed(course_spine(cohort, treatments, people, changes, roles.TECHNIQUE_RULES), "spine", by=["pid"])
    patients = roles.patients(spark, sf, customers).join(families._addresses(spark, sf, customers).transform(features.zip_areas), "pid")
    mine = spine.select(*KEYS, "start", "end")
    scalars = {
        "patient": mine.select(*KEYS).join(patients, "pid"),
        "admissions": features.admissions(mine, roles.encounters(spark, sf, orders), roles.PLANNED),
        "ed": features.ed_visits(mine, roles.ed_visits(spark, sf, orders)),
        "vitals": features.abnormal_vitals(mine, roles.vitals(spark, sf, lines)),
        "social": features.social_history(mine, roles.social(spark, sf, orders), latest_only=True),
    }
    scalars = {name: bucketed(table, name, by=["pid"]) for name, table in scalars.items()}
    adults = bucketed(_adults(join_bucketed(spine, [scalars["patient"]])).select(*KEYS), "adults", by=["pid"])
    ranges = bucketed(cohort.select("mrn", "course", "start", "end").join(people, "mrn"), "ranges", ["pid"])
    parts = [
        codes._course_diagnoses(spark, sf, ranges, codes._charged(spark, sf, lines)),
        features.drug_features(mine, roles.medications(spark, sf, lines), roles.drug_dictionary(spark, sf), roles.AGENT_KEYWORD, roles.AGENT_EXCLUDED),
        codes._past_history(spark, sf, mine, lines).where(F.col("family") == "pmhsub"),
        features.abnormal_labs(mine, roles.labs(spark, sf, lines)),
        families._procedures(spark, sf, mine, lines),
    ]
    parts = [assemble.eligible_features(p.select(*KEYS, "family", "feature"), adults) for p in parts]
    # one after the other: together they would share the memory of a task
    store = assemble.long_store([bucketed(p, "course_store", by=["pid"], split=["family"]) for p in parts])
    positions = feature_positions(store)
    presence = {f: bucketed(position_table(store.where(F.col("family") == f), positions, f), f, by=["pid"]) for f in PRESENCE}
    return Run(spine, scalars, store, positions, presence)


def _adults(courses: DataFrame) -> DataFrame:
    return courses.withColumn("age", age_years(F.col("start"), F.col("dob"))).where(F.col("age") >= assemble.ADULT)


def joined_courses(run: Run) -> DataFrame:
    """Adult courses with the columns of all 18 tables (patient and address are one), nothing filled in yet."""
    joined = _adults(join_bucketed(run.spine, [*run.scalars.values(), *run.presence.values()]))
    outcome = F.when((F.col("ed") == 1) | (F.col("admit") == 1), 1).otherwise(0)
    return joined.select("*", outcome.alias("adm_ed"), _every_position().alias("_present")).drop(*PRESENCE)


def joined_presence(run: Run) -> DataFrame:
    """The courses' stored features of all families, as positions."""
    return join_bucketed(run.spine.select(*KEYS), run.presence.values()).select(*KEYS, _every_position().alias("_present"))


def _every_position() -> Column:
    return F.concat(*[F.coalesce(f, F.array().cast("array<int>")) for f in PRESENCE])


def final_scalars(run: Run) -> DataFrame:
    """The final courses' named columns: gaps filled with zero, courses in hospital left out."""
    filled = fill_zero(joined_courses(run).drop("_present"), skip=KEYS)
    return filled.where(F.coalesce("notdisch", F.lit(0)) == 0).drop("notdisch")


def wide_courses(run: Run) -> tuple[DataFrame, list[str]]:
    """(final wide table, feature columns): empty columns dropped, gaps filled, courses in hospital left out, names repaired.

    The joined rows are written once: settling which columns are empty reads them as well.
    """
    joined = materialise(joined_courses(run), "joined-courses")
    scalars = drop_empty_columns(joined.drop("_present")).columns
    identified = joined.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS)).select(*scalars, "_present")
    filled = fill_zero(identified, skip=KEYS).where(F.coalesce("notdisch", F.lit(0)) == 0).drop("notdisch")
    named = [r["name"] for r in run.positions.orderBy("position").select("name").collect()]
    plain = [c for c in filled.columns if c != "_present"]
    repaired = syntactic_names([*plain, *named])
    filled = filled.withColumnsRenamed(dict(zip(plain, repaired)))
    return expand_positions(filled, "_present", repaired[len(plain) :]), repaired[len(plain) :]


# --- the same in SQL: source tables under surrogate ids shadow the plain ones ------------------------

_MINE_SQL = f"""spine AS (
  WITH {cohort_queries._COHORT}, {cohort_queries._CHARGED},
  assigned AS (
    SELECT t.pid, c.*, t.* EXCLUDE (mrn, pid)
    FROM treated t JOIN cohort c ON t.mrn = c.mrn AND t.service_date BETWEEN c.s AND c.e),
  usual AS (
    SELECT pid, course, attending FROM (
      SELECT pid, course, attending, row_number() OVER (PARTITION BY pid, course ORDER BY count(*) DESC, attending) AS r
      FROM assigned GROUP BY pid, course, attending) WHERE r = 1),
  course1 AS (
    SELECT pid, course, min(s) AS s, max(e) AS e,
           {", ".join(f"CASE WHEN count(*) = count({a}) THEN max({a}) END AS {a}" for a in cohort_queries._AMOUNTS)},
           count(*) AS numcharge, {", ".join(f"max({t}) AS {t}" for t in roles.TECHNIQUE_RULES)}
    FROM assigned GROUP BY pid, course)
  SELECT * FROM course1 JOIN usual USING (pid, course) WHERE tbi <> 1 AND brachy <> 1),
ranges AS (WITH {cohort_queries._COHORT} SELECT 'P' || mrn AS pid, course, s, e FROM cohort),
owner AS (
  WITH {roles.PEOPLE}
  SELECT c_custkey AS number, p.pid FROM customer LEFT JOIN id_change ON old_id = CAST(c_custkey AS VARCHAR)
  JOIN person p ON p.mrn = coalesce(new_id, CAST(c_custkey AS VARCHAR))),
all_orders AS (SELECT * FROM orders), all_customers AS (SELECT * FROM customer),
orders AS (SELECT o.* REPLACE (pid AS o_custkey) FROM all_orders o JOIN owner ON number = o_custkey),
customer AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT c.* REPLACE (pid AS c_custkey), row_number() OVER (PARTITION BY pid ORDER BY c_custkey) AS r
    FROM all_customers c JOIN owner ON number = c_custkey) WHERE r = 1)"""


def _without_spine(sql: str) -> str:
    return sql.replace(roles.SPINE + ",", "").replace(roles.LINES + ",", "")


_DX_SQL = f"""{roles.CODES},
listed AS (
  SELECT o_custkey AS pid, CAST(l_shipdate AS DATE) AS d, l_returnflag, l_linestatus, code_part.*, {roles.PART_LIST} AS diagnosis_list
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN code_part ON l_partkey = p_partkey),
slots AS (
  SELECT DISTINCT r.pid, course, replace(unnest(string_split(diagnosis_list, ' ,')), '.', '') AS code
  FROM ranges r JOIN listed l ON r.pid = l.pid AND d BETWEEN s AND e),
problem AS (
  SELECT pid, coalesce(CASE WHEN l_returnflag <> 'A' THEN d END, d + 3) AS d, unnest(string_split(ten3 || '.1, C79.' || b1 || ', C50.1, C34.1, C18.2, C16.9', ', ')) AS code
  FROM listed WHERE l_linestatus = 'F'),
diag AS (
  SELECT pid, d, CASE p_type WHEN 'SMALL' THEN '' ELSE CASE l_returnflag WHEN 'R' THEN ten3 || '.' || b1 ELSE c3 || '.' || b1 END END AS code,
         CASE l_returnflag WHEN 'R' THEN 'ICD-10-CM' WHEN 'A' THEN 'ICD-9-CM' ELSE 'OTHER' END AS code_set
  FROM listed WHERE l_linestatus = 'O'),
codes AS (SELECT code FROM slots UNION SELECT replace(code, '.', '') FROM diag WHERE code <> '' AND code_set = 'ICD-9-CM'),
{codes._STAGES}, {codes._ROLLED},
hist AS (
  SELECT pid, d, left(code, 3) AS three FROM problem WHERE code <> ''
  UNION ALL SELECT pid, d, left(code, 3) FROM diag WHERE code <> '' AND code_set = 'ICD-10-CM'
  UNION ALL SELECT pid, d, left(code_mapped, 3) FROM diag JOIN mapped9 ON orig = replace(code, '.', '') WHERE code <> '' AND code_set = 'ICD-9-CM')"""

_SOCIAL_SQL = f"""{roles.SOCIAL},
answered AS (
  SELECT * FROM (
    SELECT s.pid, course, tobacco, alcohol, illicit_drug, sexually_active,
           row_number() OVER (PARTITION BY s.pid, course ORDER BY reported_date DESC, ord DESC) AS r
    FROM spine s JOIN social h ON s.pid = h.pid AND reported_date <= s) WHERE r = 1),
soc AS (SELECT pid, course, {families._SOCIAL_SELECT} FROM spine LEFT JOIN answered USING (pid, course))"""

_AMOUNTS_SQL = ", ".join(f"round(coalesce({a}, 0), 3) AS {a}" for a in cohort_queries._AMOUNTS)

_RUN_SQL = f"""WITH {_MINE_SQL}, {roles.LINES}, {_without_spine(families._VITAL_SQL)}, {_without_spine(families._LAB_SQL)},
{_without_spine(families._MED_SQL).replace('pair', 'med_pair')}, {_without_spine(families._PROC_SQL)}, {_DX_SQL}, {_SOCIAL_SQL},
{roles.ED}, {roles.ENCOUNTERS}, {roles.PATIENTS}, ed AS ({families._ED_SQL}), adm AS ({families._ADMIT_SQL}),
adult AS (
  SELECT pid, course, (s - dob) / 365.25 AS age, dob, race, substr(c_mktsegment || '-' || c_name, 1, 5) AS zip
  FROM spine JOIN patient USING (pid) JOIN customer ON c_custkey = pid WHERE (s - dob) / 365.25 >= 18),
every AS (
  SELECT pid, course, 'coursedx' AS family, 'coursedx_' || description AS feature FROM slots JOIN labelled ON orig = code
  UNION SELECT pid, course, 'coursesub', 'coursesub_' || sub_chapter FROM slots JOIN labelled ON orig = code
  UNION SELECT pid, course, family, feature FROM med_long
  UNION SELECT s.pid, course, 'pmhsub', sub_chapter FROM spine s JOIN hist h ON s.pid = h.pid AND d <= s JOIN chapters ON three_digit = three
  UNION SELECT s.pid, course, 'lab', canonical FROM named n JOIN spine s ON n.pid = s.pid AND d <= s AND d >= s - 28
    WHERE abnormal_flag <> '' AND status_code = 'F' AND canonical <> ''
  UNION SELECT pid, course, family, feature FROM proc_long),
stored AS (SELECT every.* FROM every JOIN adult USING (pid, course)),
feature_names AS (SELECT DISTINCT family, feature FROM stored),
several AS (SELECT feature FROM feature_names GROUP BY feature HAVING count(*) > 1),
told AS (
  SELECT pid, course, CASE WHEN feature IN (SELECT feature FROM several) THEN feature || '.' || family ELSE feature END AS name
  FROM stored),
final AS (
  SELECT pid, course, s AS start_day, e AS end_day, attending, {_AMOUNTS_SQL}, numcharge, {", ".join(roles.TECHNIQUE_RULES)},
         CAST(e - s AS INTEGER) AS duration, dob, race, round(age, 4) AS age, zip,
         admit, lastadmit, admitatstart, numyearadmit, nummonthadmit, daysyearadmit, ed, lasted, nummonthed, numyeared,
         weightloss, maxpain, hypo, hyper, tachy, brady, hypox, fever, pain, tobacco, alcohol, illicit_drug, sexually_active,
         CASE WHEN ed = 1 OR admit = 1 THEN 1 ELSE 0 END AS adm_ed
  FROM spine JOIN adult USING (pid, course) JOIN adm USING (pid, course) JOIN ed USING (pid, course) JOIN vit USING (pid, course)
  JOIN soc USING (pid, course) WHERE notdisch = 0)"""


@query(
    "full_course_table",
    f"""{_RUN_SQL},
flags AS (SELECT pid, course, string_agg(name, '|' ORDER BY name) AS present, count(*) AS n_present FROM told GROUP BY pid, course)
SELECT final.*, coalesce(n_present, 0) AS n_present, coalesce(present, '') AS present FROM final LEFT JOIN flags USING (pid, course)""",
)
def full_course_table(spark: SparkSession, sf: str) -> DataFrame:
    """Final courses with all scalar columns and the names of their stored features, from raw plan lines and charges."""
    run = course_run(spark, sf)
    rounded = {a: F.round(a, 3) for a in cohort_queries._AMOUNTS} | {"age": F.round("age", 4), "weightloss": F.round("weightloss", 6)}
    final = final_scalars(run).withColumns(rounded)
    placed = joined_presence(run).select(*KEYS, F.explode("_present").alias("position")).join(run.positions.select("position", "name"), "position")
    named = placed.groupBy(*KEYS).agg(F.sort_array(F.collect_list("name")).alias("_names"))
    told = final.join(named, list(KEYS), "left").withColumnsRenamed({"start": "start_day", "end": "end_day"})
    count = F.coalesce(F.size("_names"), F.lit(0)).cast("long")
    return told.select("*", count.alias("n_present"), F.coalesce(F.array_join("_names", "|"), F.lit("")).alias("present")).drop("_names")


@query(
    "wide_course_export",
    f"""{_RUN_SQL}
SELECT regexp_replace(name, '[^A-Za-z0-9._]', '.', 'g') AS column_name, CAST(count(final.pid) AS BIGINT) AS n_courses
FROM told LEFT JOIN final USING (pid, course) GROUP BY name""",
)
def wide_course_export(spark: SparkSession, sf: str) -> DataFrame:
    """Courses per feature column of the whole wide table, counted over its columns."""
    wide, names = wide_courses(course_run(spark, sf))
    counts = wide.agg(*[F.sum(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = [F.struct(F.lit(n).alias("column_name"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_courses")) for i, n in enumerate(names)]
    return counts.select(F.inline(F.array(*pairs)))
