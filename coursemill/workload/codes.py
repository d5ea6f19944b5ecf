"""Code-mapping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.functions import strip_dots
from coursemill.operators import explode_codes, first_by_order, longest_list, map_values
from coursemill.operators.codes import (
    build_crosswalk,
    describe_codes,
    label_subchapter,
    map_codes,
    roll_up,
    subchapter_map,
)
from coursemill.plans import features
from coursemill.plans.tables import bucketed
from coursemill.session import materialise
from coursemill.workload import roles
from coursemill.workload.registry import query


def _crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return build_crosswalk(roles.crosswalk_rows(spark, sf), "code9", "code10", "source_order")


def _terms(rows: DataFrame) -> DataFrame:
    return first_by_order(rows, "code", "short_desc", "source_order")


_EXPLODED = f"""{roles.CODES},
exploded AS (
  SELECT p_partkey, replace(unnest(string_split({roles.PART_LIST}, ' ,')), '.', '') AS code FROM code_part)"""

# The staged lookup, written out one stage at a time.
_STAGES = """stage0 AS (SELECT code AS c, m.code10 AS t FROM codes LEFT JOIN xwalk m ON m.code9 = code),
stage1 AS (SELECT c AS orig, CASE WHEN length(c) = 3 AND t IS NULL THEN c || '0' ELSE c END AS c1 FROM stage0),
stage2 AS (SELECT orig, CASE WHEN length(c1) = 4 AND m.code10 IS NULL THEN c1 || '0' ELSE c1 END AS c2
           FROM stage1 LEFT JOIN xwalk m ON m.code9 = c1),
stage3 AS (SELECT orig, c2, m.code10 AS t2, CASE WHEN length(c2) > 3 AND m.code10 IS NULL THEN left(c2, length(c2) - 1) || '9' ELSE c2 END AS c3
           FROM stage2 LEFT JOIN xwalk m ON m.code9 = c2),
mapped AS (SELECT orig, c2 AS code_final, coalesce(t2, c2) AS code_mapped FROM stage3),
mapped9 AS (SELECT orig, c3 AS code_final, m.code10 AS code_mapped FROM stage3 JOIN xwalk m ON m.code9 = c3)"""


def _part_codes(spark: SparkSession, sf: str) -> DataFrame:
    listed = roles.code_parts(spark, sf).select("p_partkey", roles.diagnosis_list().alias("diagnosis_list"))
    coded = explode_codes(listed, "diagnosis_list", " ,", "code")
    return coded.withColumn("code", strip_dots(F.col("code")))


@query("code_explode", f"WITH {_EXPLODED} SELECT p_partkey, code, (SELECT CAST(max(n) AS INTEGER) FROM (SELECT len(string_split({roles.PART_LIST}, ' ,')) AS n FROM code_part)) AS max_codes FROM exploded")
def code_explode(spark: SparkSession, sf: str) -> DataFrame:
    listed = roles.code_parts(spark, sf).select("p_partkey", roles.diagnosis_list().alias("diagnosis_list"))
    longest = longest_list(listed, "diagnosis_list", " ,").scalar()
    return _part_codes(spark, sf).withColumn("max_codes", longest)


@query(
    "code_crosswalk",
    f"""WITH {_EXPLODED}, codes AS (SELECT DISTINCT code FROM exploded), {_STAGES}
SELECT p_partkey, code, code_final, code_mapped FROM exploded JOIN mapped ON orig = code""",
)
def code_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return map_codes(_part_codes(spark, sf), "code", _crosswalk(spark, sf), "code9", "code10")


@query(
    "code_crosswalk_last9",
    f"""WITH {_EXPLODED}, codes AS (SELECT DISTINCT code FROM exploded), {_STAGES}
SELECT p_partkey, code, code_final, code_mapped FROM exploded JOIN mapped9 ON orig = code""",
)
def code_crosswalk_last9(spark: SparkSession, sf: str) -> DataFrame:
    return map_codes(
        _part_codes(spark, sf), "code", _crosswalk(spark, sf), "code9", "code10", last_nine=True, keep_unmatched=False
    )


_ROLLED = """rolled AS (SELECT orig, code_mapped, CASE WHEN left(code_mapped, 3) = 'C79' THEN code_mapped ELSE left(code_mapped, 3) END AS category FROM mapped),
labelled AS (
  SELECT orig, code_mapped, category, coalesce(t.short_desc, t4.short_desc, st.short_desc, 'Prophylactic measures') AS description,
         coalesce(sub_chapter, 'Prophylactic measures') AS sub_chapter
  FROM rolled LEFT JOIN terms t ON t.code = category LEFT JOIN terms t4 ON t4.code = left(category, 4)
  LEFT JOIN short_terms st ON st.code = category LEFT JOIN chapters ON three_digit = left(code_mapped, 3))"""


@query(
    "code_rollup_describe",
    f"""WITH {_EXPLODED}, codes AS (SELECT DISTINCT code FROM exploded), {_STAGES}, {_ROLLED}
SELECT p_partkey, code, code_mapped, category, description, sub_chapter FROM exploded JOIN labelled ON orig = code""",
)
def code_rollup_describe(spark: SparkSession, sf: str) -> DataFrame:
    mapped = map_codes(_part_codes(spark, sf), "code", _crosswalk(spark, sf), "code9", "code10")
    rolled = mapped.withColumn("category", roll_up(F.col("code_mapped")))
    described = describe_codes(
        rolled, "category", _terms(roles.term_rows(spark, sf)), _terms(roles.short_term_rows(spark, sf))
    )
    labelled = label_subchapter(described, "code_mapped", subchapter_map(roles.hierarchy(spark, sf), "source_order"))
    return labelled.drop("code_final")


def _course_diagnoses_sql(slots: str) -> str:
    return f"""WITH {roles.SPINE}, {roles.CODES},
listed AS (
  SELECT o_custkey AS pid, CAST(l_shipdate AS DATE) AS d, {roles.PART_LIST} AS diagnosis_list
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN code_part ON l_partkey = p_partkey),
slots AS (
  SELECT DISTINCT s.pid, course, replace(unnest(string_split(diagnosis_list, ' ,'){slots}), '.', '') AS code
  FROM spine s JOIN listed l ON s.pid = l.pid AND d BETWEEN s AND e),
codes AS (SELECT DISTINCT code FROM slots), {_STAGES}, {_ROLLED}
SELECT DISTINCT pid, course, 'coursedx' AS family, 'coursedx_' || description AS feature, CAST(1 AS DOUBLE) AS value FROM slots JOIN labelled ON orig = code
UNION ALL
SELECT DISTINCT pid, course, 'coursesub', 'coursesub_' || sub_chapter, CAST(1 AS DOUBLE) FROM slots JOIN labelled ON orig = code"""


@query("course_diagnoses", _course_diagnoses_sql(""))
def course_diagnoses(spark: SparkSession, sf: str, max_slots: int | None = None) -> DataFrame:
    charged = bucketed(_charged(spark, sf, roles.lines(spark, sf)), "charged", ["pid"])
    return _course_diagnoses(spark, sf, roles.spine(spark, sf), charged, max_slots)


def _charged(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    listed = roles.code_parts(spark, sf, lines)
    ids = [c for c in ("pid", "mrn") if c in lines.columns]
    return listed.select(*ids, F.col("d").alias("service_date"), roles.diagnosis_list().alias("diagnosis_list"))


def _course_diagnoses(spark: SparkSession, sf: str, ranges: DataFrame, charged: DataFrame, max_slots: int | None = None) -> DataFrame:
    return features.course_diagnoses(
        ranges,
        charged,
        _crosswalk(spark, sf),
        subchapter_map(roles.hierarchy(spark, sf), "source_order"),
        _terms(roles.term_rows(spark, sf)),
        _terms(roles.short_term_rows(spark, sf)),
        max_slots=max_slots,
        on=[c for c in ("pid", "mrn") if c in ranges.columns],
    )


@query("course_diagnoses_four_slots", _course_diagnoses_sql("[1:4]"))
def course_diagnoses_four_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The leading four codes of each list, for parity with tables that had four slots."""
    return course_diagnoses(spark, sf, 4)


@query(
    "history_union",
    f"""WITH {roles.SPINE}, {roles.CODES},
line AS (
  SELECT o_custkey AS pid, CAST(l_shipdate AS DATE) AS d, l_returnflag, l_linestatus, code_part.*
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN code_part ON l_partkey = p_partkey),
problem AS (
  SELECT pid, coalesce(CASE WHEN l_returnflag <> 'A' THEN d END, d + 3) AS d, unnest(string_split(ten3 || '.1, C79.' || b1 || ', C50.1, C34.1, C18.2, C16.9', ', ')) AS code
  FROM line WHERE l_linestatus = 'F'),
diag AS (
  SELECT pid, d, CASE p_type WHEN 'SMALL' THEN '' ELSE CASE l_returnflag WHEN 'R' THEN ten3 || '.' || b1 ELSE c3 || '.' || b1 END END AS code,
         CASE l_returnflag WHEN 'R' THEN 'ICD-10-CM' WHEN 'A' THEN 'ICD-9-CM' ELSE 'OTHER' END AS code_set
  FROM line WHERE l_linestatus = 'O'),
codes AS (SELECT DISTINCT replace(code, '.', '') AS code FROM diag WHERE code <> '' AND code_set = 'ICD-9-CM'), {_STAGES},
hist AS (
  SELECT pid, d, left(code, 3) AS three FROM problem WHERE code <> ''
  UNION ALL SELECT pid, d, left(code, 3) FROM diag WHERE code <> '' AND code_set = 'ICD-10-CM'
  UNION ALL SELECT pid, d, left(code_mapped, 3) FROM diag JOIN mapped9 ON orig = replace(code, '.', '') WHERE code <> '' AND code_set = 'ICD-9-CM')
SELECT DISTINCT s.pid, course, 'pmhsub' AS family, sub_chapter AS feature, CAST(1 AS DOUBLE) AS value
FROM spine s JOIN hist h ON s.pid = h.pid AND d <= s JOIN chapters ON three_digit = three
UNION ALL
SELECT DISTINCT s.pid, course, 'pmhdx', short_desc, CAST(1 AS DOUBLE)
FROM spine s JOIN hist h ON s.pid = h.pid AND d <= s JOIN terms ON terms.code = three""",
)
def history_union(spark: SparkSession, sf: str) -> DataFrame:
    lines = roles.lines(spark, sf).select("pid", "d", "l_linestatus", "l_returnflag", "p_brand", "p_type", "p_size")
    return _past_history(spark, sf, roles.spine(spark, sf), bucketed(lines, "history_lines", ["pid"]))


def _past_history(spark: SparkSession, sf: str, spine: DataFrame, lines: DataFrame) -> DataFrame:
    line = roles.code_parts(spark, sf, lines)
    problems = line.where(F.col("l_linestatus") == "F").select(
        "pid",
        F.when(F.col("l_returnflag") != "A", F.col("d")).alias("noted_date"),
        F.date_add("d", 3).alias("entered_date"),
        F.concat("ten3", F.lit(".1, C79."), "b1", F.lit(", C50.1, C34.1, C18.2, C16.9")).alias("icd10_list"),
    )
    flag = F.col("l_returnflag")
    diagnoses = line.where(F.col("l_linestatus") == "O").select(
        "pid",
        F.col("d").alias("date"),
        F.when(F.col("p_type") == "SMALL", "")
        .otherwise(F.concat(F.when(flag == "R", F.col("ten3")).otherwise(F.col("c3")), F.lit("."), "b1"))
        .alias("code"),
        F.when(flag == "R", "ICD-10-CM").when(flag == "A", "ICD-9-CM").otherwise("OTHER").alias("code_set"),
    )
    history = bucketed(features.history_codes(problems, diagnoses, _crosswalk(spark, sf)), "history", ["pid"])
    return features.past_history(
        spine,
        history,
        materialise(subchapter_map(roles.hierarchy(spark, sf), "source_order"), "sub-chapters"),
        materialise(_terms(roles.term_rows(spark, sf)), "terms"),
    )


@query(
    "map_values",
    """WITH conv AS (SELECT p_name, first(p_brand ORDER BY p_partkey) AS b FROM part WHERE p_size > 40 GROUP BY 1)
SELECT p_partkey, coalesce(b, p.p_name) AS name FROM part p LEFT JOIN conv USING (p_name)""",
)
def map_values_query(spark: SparkSession, sf: str) -> DataFrame:
    part = roles.table(spark, sf, "part")
    conv = first_by_order(part.where(F.col("p_size") > 40), "p_name", "p_brand", "p_partkey")
    return map_values(part.select("p_partkey", F.col("p_name").alias("name")), "name", conv, "p_name", "p_brand")
