"""Feature-family queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import null_profile
from coursemill.operators import lookback_join, pivot_indicators
from coursemill.operators.codes import canonical_names, cohort_ingredients, drug_classes, first_test_names
from coursemill.plans import assemble, features
from coursemill.plans.tables import bucketed
from coursemill.session import materialise
from coursemill.workload import roles
from coursemill.workload.registry import query

_NEVER = "1e100"

_ED_SQL = """SELECT pid, course,
       CAST(coalesce(max(CASE WHEN v > s AND v <= e THEN 1 END), 0) AS INTEGER) AS ed,
       coalesce(CAST(min(CASE WHEN s - v >= 0 THEN s - v END) AS DOUBLE), 1e100) AS lasted,
       CAST(count(CASE WHEN s - v BETWEEN 0 AND 30 THEN 1 END) AS BIGINT) AS nummonthed,
       CAST(count(CASE WHEN s - v BETWEEN 0 AND 365 THEN 1 END) AS BIGINT) AS numyeared
FROM spine LEFT JOIN (SELECT pid AS vp, ed_arrival_date AS v FROM ed_visit) ON vp = pid
GROUP BY pid, course"""

_ADMIT_SQL = """SELECT pid, course,
       CAST(coalesce(max(CASE WHEN a > s AND a <= e AND NOT coalesce(contains(drg, 'URGENT'), FALSE) THEN 1 END), 0) AS INTEGER) AS admit,
       coalesce(CAST(min(CASE WHEN s - x >= 0 THEN s - x END) AS DOUBLE), 1e100) AS lastadmit,
       CAST(coalesce(max(CASE WHEN s >= a AND s < x THEN 1 END), 0) AS INTEGER) AS admitatstart,
       CAST(coalesce(max(CASE WHEN s >= a AND s < x AND NOT (x >= s AND x < e) THEN 1 END), 0) AS INTEGER) AS notdisch,
       CAST(count(CASE WHEN s - x BETWEEN 0 AND 365 THEN 1 END) AS BIGINT) AS numyearadmit,
       CAST(count(CASE WHEN s - x BETWEEN 0 AND 30 THEN 1 END) AS BIGINT) AS nummonthadmit,
       coalesce(sum(CASE WHEN s - x BETWEEN 0 AND 365 THEN los_days END), 0.0) AS daysyearadmit
FROM spine LEFT JOIN (SELECT pid AS ap, admit_date AS a, discharge_date AS x, los_days, drg FROM encounter) ON ap = pid
GROUP BY pid, course"""


@query("ed_features", f"WITH {roles.SPINE}, {roles.ED} {_ED_SQL}")
def ed_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.ed_visits(roles.spine(spark, sf), roles.ed_visits(spark, sf))


@query(
    "ed_features_events",
    """WITH spine AS (SELECT user_id AS pid, event_id AS course, CAST(ts AS DATE) AS s, CAST(ts AS DATE) + 7 AS e
               FROM events WHERE event_type = 'signup'),
ed_visit AS (SELECT user_id AS pid, CAST(ts AS DATE) AS ed_arrival_date FROM events WHERE event_type = 'purchase') """
    + _ED_SQL,
)
def ed_features_events(spark: SparkSession, sf: str) -> DataFrame:
    events = roles.table(spark, sf, "events").select(
        F.col("user_id").alias("pid"), "event_id", "event_type", roles.day("ts").alias("start")
    )
    spine = events.where(F.col("event_type") == "signup").select(
        "pid", F.col("event_id").alias("course"), "start", F.date_add("start", 7).alias("end")
    )
    visits = events.where(F.col("event_type") == "purchase").select("pid", F.col("start").alias("ed_arrival_date"))
    return features.ed_visits(spine, visits)


@query("admission_features", f"WITH {roles.SPINE}, {roles.ENCOUNTERS} {_ADMIT_SQL}")
def admission_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.admissions(roles.spine(spark, sf), roles.encounters(spark, sf), roles.PLANNED)


@query(
    "admission_reasons",
    f"""WITH {roles.SPINE}, {roles.ENCOUNTERS}
SELECT s.pid, course, admit_date, discharge_date, drg FROM spine s JOIN encounter a ON s.pid = a.pid
WHERE admit_date > s AND admit_date <= e AND NOT coalesce(contains(drg, 'URGENT'), FALSE)""",
)
def admission_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.unplanned_admissions(roles.spine(spark, sf), roles.encounters(spark, sf), roles.PLANNED)
    return rows.select("pid", "course", "admit_date", "discharge_date", "drg")


@query(
    "lookback_events",
    f"""WITH {roles.SPINE}, {roles.ENCOUNTERS}
SELECT s.pid, course, s - discharge_date AS days_prior, los_days FROM spine s JOIN encounter a ON s.pid = a.pid
WHERE s - discharge_date BETWEEN 0 AND 30""",
)
def lookback_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookback_join(
        roles.spine(spark, sf), roles.encounters(spark, sf), ["pid"], "start", "discharge_date", features.MONTH
    )
    return rows.select(
        "pid", "course", F.datediff("start", "discharge_date").cast("long").alias("days_prior"), "los_days"
    )


_VITAL_SQL = f"""{roles.SPINE}, {roles.VITALS},
pair AS (SELECT s.pid, course, v.* EXCLUDE (pid) FROM spine s JOIN vital v ON s.pid = v.pid WHERE s - d BETWEEN 0 AND 365),
agg AS (
  SELECT pid, course, max(weight_kg) AS maxweight,
         last(weight_kg ORDER BY d, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (WHERE weight_kg IS NOT NULL) AS lastweight,
         last(bmi ORDER BY d, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (WHERE bmi IS NOT NULL) AS lastbmi,
         min(sbp) AS minsbp, max(sbp) AS maxsbp, min(dbp) AS mindbp, max(dbp) AS maxdbp, min(pulse) AS minpulse,
         max(pulse) AS maxpulse, min(spo2) AS minsat, max(temp_c) AS maxtemp, max(pain) AS maxpain
  FROM pair GROUP BY pid, course),
vit AS (
  SELECT pid, course, round(coalesce((maxweight - lastweight) / maxweight, 0), 6) AS weightloss, coalesce(maxpain, 0) AS maxpain,
         CASE WHEN minsbp < 90 OR mindbp < 60 THEN 1 ELSE 0 END AS hypo, CASE WHEN maxsbp > 129 OR maxdbp > 79 THEN 1 ELSE 0 END AS hyper,
         CASE WHEN maxpulse > 100 THEN 1 ELSE 0 END AS tachy, CASE WHEN minpulse < 50 THEN 1 ELSE 0 END AS brady,
         CASE WHEN minsat < 90 THEN 1 ELSE 0 END AS hypox, CASE WHEN maxtemp >= 38 THEN 1 ELSE 0 END AS fever,
         CASE WHEN maxpain > 3 THEN 1 ELSE 0 END AS pain
  FROM spine LEFT JOIN agg USING (pid, course))"""


@query("vitals_features", f"WITH {_VITAL_SQL} SELECT * FROM vit")
def vitals_features(spark: SparkSession, sf: str) -> DataFrame:
    v = features.abnormal_vitals(roles.spine(spark, sf), roles.vitals(spark, sf))
    return v.withColumn("weightloss", F.round("weightloss", 6))


@query("vital_extremes", f"WITH {_VITAL_SQL} SELECT pid, course, lastbmi, lastweight, maxweight, minsat FROM spine LEFT JOIN agg USING (pid, course)")
def vital_extremes(spark: SparkSession, sf: str) -> DataFrame:
    v = features.vital_signs(roles.spine(spark, sf), roles.vitals(spark, sf))
    return v.select("pid", "course", "lastbmi", "lastweight", "maxweight", "minsat")


_LAB_SQL = f"""{roles.SPINE}, {roles.LINES}, {roles.LABS},
base_of_test AS (
  SELECT test_name, first(base_name ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS conv FROM lab
  WHERE base_name <> '' AND test_name <> '' GROUP BY 1),
renamed AS (SELECT lab.*, coalesce(conv, test_name) AS up FROM lab LEFT JOIN base_of_test USING (test_name)),
name_of_desc AS (
  SELECT test_description AS td, first(up ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS conv2 FROM renamed
  WHERE up <> '' AND test_description <> '' GROUP BY 1),
named AS (SELECT renamed.*, coalesce(conv2, up) AS canonical FROM renamed LEFT JOIN name_of_desc ON td = up)"""


@query(
    "lab_names",
    f"WITH {_LAB_SQL} SELECT test_name, test_description, canonical, count(*) AS n_rows FROM named GROUP BY ALL",
)
def lab_names(spark: SparkSession, sf: str) -> DataFrame:
    named = canonical_names(roles.labs(spark, sf), "test_name", "base_name", "test_description", "source_order")
    return named.groupBy("test_name", "test_description", "canonical").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "lab_first_tests",
    f"""WITH {_LAB_SQL},
test_of_base AS (
  SELECT base_name, first(test_name ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS t FROM lab
  WHERE base_name <> '' AND test_name <> '' GROUP BY 1)
SELECT base_name, coalesce(t, base_name) AS first_test, count(*) AS n_rows FROM lab LEFT JOIN test_of_base USING (base_name) GROUP BY ALL""",
)
def lab_first_tests(spark: SparkSession, sf: str) -> DataFrame:
    named = first_test_names(roles.labs(spark, sf), "test_name", "base_name", "source_order")
    return named.groupBy("base_name", "first_test").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "abnormal_labs",
    f"""WITH {_LAB_SQL}
SELECT DISTINCT s.pid, course, 'lab' AS family, canonical AS feature, CAST(1 AS DOUBLE) AS value
FROM named n JOIN spine s ON n.pid = s.pid AND d <= s AND d >= s - 28
WHERE abnormal_flag <> '' AND status_code = 'F' AND canonical <> ''""",
)
def abnormal_labs(spark: SparkSession, sf: str) -> DataFrame:
    return features.abnormal_labs(roles.spine(spark, sf), roles.labs(spark, sf))


_MED_SQL = f"""{roles.SPINE}, {roles.LINES}, {roles.MEDS}, {roles.DICTIONARY},
pair AS (
  SELECT s.pid, course, drug_name, (end_date <= s) AND (start_date > s - 181) AS recent,
         (end_date > s) AND (start_date < s + 15) AND (start_date > s - 31) AS concurrent,
         start_date <= s AND NOT (end_date <= s) AS taking
  FROM spine s JOIN med m ON s.pid = m.pid),
agents AS (
  SELECT DISTINCT ingredient FROM rx WHERE class LIKE '%PROMO hot%' AND drug_name IN (SELECT drug_name FROM med)
  AND ingredient NOT IN ('hot ring', 'hot bolt')),
neo AS (SELECT pair.*, ingredient, class FROM pair JOIN rx USING (drug_name) WHERE ingredient IN (SELECT ingredient FROM agents)),
held AS (SELECT pair.*, coalesce(class, 'NA') AS class FROM pair LEFT JOIN rx USING (drug_name)),
med_long AS (
  SELECT DISTINCT pid, course, 'recagent' AS family, 'rec_' || ingredient AS feature FROM neo WHERE recent
  UNION ALL SELECT DISTINCT pid, course, 'conagent', 'con_' || ingredient FROM neo WHERE concurrent
  UNION ALL SELECT DISTINCT pid, course, 'recclass', 'rec_' || class FROM neo WHERE recent
  UNION ALL SELECT DISTINCT pid, course, 'conclass', 'con_' || class FROM neo WHERE concurrent
  UNION ALL SELECT DISTINCT pid, course, 'recmed', 'rec_' || class FROM held WHERE recent
  UNION ALL SELECT DISTINCT pid, course, 'curmed', 'cur_' || class FROM held WHERE taking)"""


@query("agent_windows", f"WITH {_MED_SQL} SELECT *, CAST(1 AS DOUBLE) AS value FROM med_long WHERE family IN ('recagent', 'conagent', 'recclass', 'conclass')")
def agent_windows(spark: SparkSession, sf: str) -> DataFrame:
    return features.systemic_agents(
        roles.spine(spark, sf),
        bucketed(roles.medications(spark, sf), "medications", ["pid"]),
        roles.drug_dictionary(spark, sf),
        roles.AGENT_KEYWORD,
        roles.AGENT_EXCLUDED,
    )


@query("med_windows", f"WITH {_MED_SQL} SELECT *, CAST(1 AS DOUBLE) AS value FROM med_long WHERE family IN ('recmed', 'curmed')")
def med_windows(spark: SparkSession, sf: str) -> DataFrame:
    return features.medication_classes(
        roles.spine(spark, sf), bucketed(roles.medications(spark, sf), "medications", ["pid"]), roles.drug_dictionary(spark, sf)
    )


@query(
    "any_agent",
    f"""WITH {_MED_SQL}, mine AS (
  SELECT pid, course, CAST(concurrent AS INTEGER) AS c, CAST(recent AS INTEGER) AS r FROM pair
  WHERE drug_name IN (SELECT drug_name FROM rx WHERE ingredient IN (SELECT ingredient FROM agents)))
SELECT pid, course, CASE WHEN count(*) = count(c) THEN max(c) END AS concurrent,
       CASE WHEN count(*) = count(r) THEN max(r) END AS recent
FROM mine GROUP BY pid, course""",
)
def any_agent(spark: SparkSession, sf: str) -> DataFrame:
    return features.any_agent(
        roles.spine(spark, sf),
        roles.medications(spark, sf),
        roles.drug_dictionary(spark, sf),
        roles.AGENT_KEYWORD,
        roles.AGENT_EXCLUDED,
    )


@query("cohort_drugs", f"WITH {_MED_SQL} SELECT ingredient FROM agents")
def cohort_drugs(spark: SparkSession, sf: str) -> DataFrame:
    classes = drug_classes(roles.drug_dictionary(spark, sf))
    return cohort_ingredients(classes, roles.medications(spark, sf), roles.AGENT_KEYWORD, roles.AGENT_EXCLUDED)


_PROC_SQL = f"""{roles.SPINE}, {roles.LINES},
proc_long AS (
  SELECT DISTINCT s.pid, course, 'proc' AS family, 'proc_' || nullif(p_type, 'SMALL') AS feature FROM spine s JOIN line l ON s.pid = l.pid AND d <= s
  WHERE p_type <> 'SMALL'
  UNION ALL
  SELECT DISTINCT s.pid, course, 'cpt', 'cpt_' || p_name FROM spine s JOIN line l ON s.pid = l.pid AND d <= s)"""


def _procedures(spark: SparkSession, sf: str, spine: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    spine = roles.spine(spark, sf) if spine is None else spine
    rows = (roles.lines(spark, sf) if lines is None else lines).select(
        "pid", "d", F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type")).alias("category"), "p_name"
    )
    if lines is None:  # both families read them
        rows = bucketed(rows, "procedures", ["pid"])
    categories = features.prior_procedures(spine, rows, "category", "d")
    described = features.prior_procedures(spine, rows, "p_name", "d", "cpt", "cpt_")
    return categories.unionByName(described)


@query("prior_procs", f"WITH {_PROC_SQL} SELECT *, CAST(1 AS DOUBLE) AS value FROM proc_long")
def prior_procs(spark: SparkSession, sf: str) -> DataFrame:
    return _procedures(spark, sf)


_SOCIAL_SELECT = ", ".join(
    f"CASE WHEN {c} IS NULL OR {c} IN ('Defer', 'Not Asked') THEN 'UNKNOWN' ELSE {c} END AS {c}"
    for c in features.SOCIAL_FIELDS
)


@query(
    "social_backfill",
    f"""WITH {roles.SPINE}, {roles.SOCIAL},
seen AS (SELECT DISTINCT s.pid, course, tobacco, alcohol, illicit_drug, sexually_active
         FROM spine s JOIN social h ON s.pid = h.pid AND reported_date <= s)
SELECT pid, course, {_SOCIAL_SELECT} FROM spine LEFT JOIN seen USING (pid, course)""",
)
def social_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return features.social_history(roles.spine(spark, sf), roles.social(spark, sf))


@query(
    "social_latest",
    f"""WITH {roles.SPINE}, {roles.SOCIAL},
seen AS (
  SELECT * FROM (
    SELECT s.pid, course, tobacco, alcohol, illicit_drug, sexually_active,
           row_number() OVER (PARTITION BY s.pid, course ORDER BY reported_date DESC, ord DESC) AS r
    FROM spine s JOIN social h ON s.pid = h.pid AND reported_date <= s) WHERE r = 1)
SELECT pid, course, {_SOCIAL_SELECT} FROM spine LEFT JOIN seen USING (pid, course)""",
)
def social_latest(spark: SparkSession, sf: str) -> DataFrame:
    return features.social_history(roles.spine(spark, sf), roles.social(spark, sf), latest_only=True)


@query(
    "demographics",
    """SELECT DISTINCT c_custkey AS pid, c_name AS mrn, DATE '1985-06-30' - CAST(floor(c_acctbal) AS INTEGER) AS dob, c_mktsegment AS race,
       n_name AS ethnic_group, CASE WHEN c_acctbal < 0 THEN 'owing' END AS marital_status, r_name AS religion
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def demographics(spark: SparkSession, sf: str) -> DataFrame:
    places = roles.table(spark, sf, "nation").join(
        roles.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = roles.table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return features.demographics(
        customers.select(
            F.col("c_custkey").alias("pid"),
            F.col("c_name").alias("mrn"),
            F.date_sub(F.lit("1985-06-30").cast("date"), F.floor("c_acctbal").cast("int")).alias("dob"),
            F.col("c_mktsegment").alias("race"),
            F.col("n_name").alias("ethnic_group"),
            F.when(F.col("c_acctbal") < 0, "owing").alias("marital_status"),
            F.col("r_name").alias("religion"),
        )
    )


@query("area_zip5", "SELECT c_custkey AS pid, substr(c_mktsegment || '-' || c_name, 1, 5) AS zip FROM customer")
def area_zip5(spark: SparkSession, sf: str) -> DataFrame:
    return features.zip_areas(_addresses(spark, sf))


def _addresses(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    return (roles.table(spark, sf, "customer") if of is None else of).select(
        F.col("c_custkey").alias("pid"), F.concat_ws("-", "c_mktsegment", "c_name").alias("postal_code")
    )


# --- reshape and assembly ------------------------------------------------------------------------


@query(
    "indicator_pivot",
    """SELECT o_custkey AS pid, o_orderkey AS course,
  """
    + ", ".join(
        f"CAST(max(CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END) AS INTEGER) AS proc_{t}"
        for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    )
    + """
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def indicator_pivot(spark: SparkSession, sf: str) -> DataFrame:
    long = roles.lines(spark, sf).select(
        "pid", F.col("l_orderkey").alias("course"), F.concat(F.lit("proc_"), "p_type").alias("feature")
    )
    return pivot_indicators(long, ["pid", "course"])


@query(
    "null_profile",
    f"""WITH {roles.VITALS}, n AS (SELECT count(*) AS r FROM vital)
"""
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_present, max(r) - count({c}) AS n_missing FROM vital, n"
        for c in ("weight_kg", "bmi", "sbp", "dbp", "pulse", "spo2", "temp_c", "pain")
    ),
)
def null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return null_profile(roles.vitals(spark, sf).drop("pid", "taken_date", "source_order"))


_FINAL_SQL = f"""{_VITAL_SQL}, {roles.ED}, {roles.ENCOUNTERS}, {roles.PATIENTS},
ed AS ({_ED_SQL}), adm AS ({_ADMIT_SQL}),
final AS (
  SELECT pid, course, s AS start_day, e AS end_day, dob, race, (s - dob) / 365.25 AS age,
         substr(c_mktsegment || '-' || c_name, 1, 5) AS zip,
         admit, lastadmit, admitatstart, numyearadmit, nummonthadmit, daysyearadmit, ed, lasted, nummonthed, numyeared,
         weightloss, maxpain, hypo, hyper, tachy, brady, hypox, fever, pain,
         CASE WHEN ed = 1 OR admit = 1 THEN 1 ELSE 0 END AS adm_ed
  FROM spine JOIN patient USING (pid) JOIN customer ON c_custkey = pid JOIN adm USING (pid, course) JOIN ed USING (pid, course)
  JOIN vit USING (pid, course)
  WHERE (s - dob) / 365.25 >= 18 AND notdisch = 0)"""


def final_courses(spark: SparkSession, sf: str, fill: bool = True, orders: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    spine = roles.spine(spark, sf, orders)
    return assemble.course_table(
        spine,
        roles.patients(spark, sf),
        features.admissions(spine, roles.encounters(spark, sf, orders), roles.PLANNED),
        features.ed_visits(spine, roles.ed_visits(spark, sf, orders)),
        [features.abnormal_vitals(spine, roles.vitals(spark, sf, lines))],
        features.zip_areas(_addresses(spark, sf)),
        fill=fill,
    )


@query(
    "final_assembly",
    f"WITH {_FINAL_SQL} SELECT * REPLACE (round(age, 4) AS age, round(weightloss, 6) AS weightloss) FROM final",
)
def final_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return final_courses(spark, sf).withColumnsRenamed({"start": "start_day", "end": "end_day"}).withColumns(
        {"age": F.round("age", 4), "weightloss": F.round("weightloss", 6)}
    )


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD")


@query(
    "wide_export",
    f"""WITH {_FINAL_SQL}, {_PROC_SQL.split(roles.SPINE + ",", 1)[1]},
flags AS (SELECT pid, course, {", ".join(f"max(CASE WHEN feature = 'proc_{t}' THEN 1 ELSE 0 END) AS proc_{t}" for t in _TYPES)}
          FROM proc_long WHERE family = 'proc' GROUP BY pid, course)
SELECT pid, course, adm_ed, lasted, numyearadmit, {", ".join(f"coalesce(proc_{t}, 0) AS proc_{t}" for t in _TYPES)}
FROM final LEFT JOIN flags USING (pid, course)""",
)
def wide_export(spark: SparkSession, sf: str) -> DataFrame:
    courses = materialise(final_courses(spark, sf, fill=False).select("pid", "course", "adm_ed", "lasted", "numyearadmit"), "wide-courses")
    store = _procedures(spark, sf).where(F.col("family") == "proc")
    return assemble.wide_table(courses, assemble.eligible_features(store, courses), [f"proc_{t}" for t in _TYPES])


def feature_store(spark: SparkSession, sf: str) -> DataFrame:
    """All presence families of the order courses; they share the lines, written once."""
    spine, lines = roles.spine(spark, sf), roles.by_patient(roles.lines(spark, sf), "lines")
    return assemble.long_store(
        [
            features.drug_features(
                spine,
                roles.medications(spark, sf, lines),
                roles.drug_dictionary(spark, sf),
                roles.AGENT_KEYWORD,
                roles.AGENT_EXCLUDED,
            ),
            features.abnormal_labs(spine, roles.labs(spark, sf, lines)),
            _procedures(spark, sf, spine, lines),
        ]
    )


@query(
    "long_store",
    f"""WITH {_MED_SQL}, {_PROC_SQL.split(roles.LINES + ",", 1)[1]}, {_LAB_SQL.split(roles.LINES + ",", 1)[1]},
lab_long AS (
  SELECT DISTINCT s.pid, course, 'lab' AS family, canonical AS feature FROM named n JOIN spine s ON n.pid = s.pid AND d <= s AND d >= s - 28
  WHERE abnormal_flag <> '' AND status_code = 'F' AND canonical <> '')
SELECT family, feature, count(*) AS n_courses
FROM (SELECT * FROM med_long UNION ALL SELECT * FROM lab_long UNION ALL SELECT * FROM proc_long) GROUP BY 1, 2""",
)
def long_store(spark: SparkSession, sf: str) -> DataFrame:
    return feature_store(spark, sf).groupBy("family", "feature").agg(F.count(F.lit(1)).alias("n_courses"))
