"""The benchmark tables in clinical roles, as DataFrames and as the same SQL subqueries.

Customers are patients, orders are courses and encounters, order lines are charges, vitals, labs,
medications, procedures and diagnoses, parts are dictionaries. Every role covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.plans.tables import bucketed
from coursemill.session import fit_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    fit_partitions(spark, path)
    return spark.read.parquet(path)


def day(c: str) -> Column:
    return F.col(c).cast("date")


def _source(spark: SparkSession, sf_dir: str, name: str, of: DataFrame | None) -> DataFrame:
    """``of`` in place of the table: the same columns, under other patient ids."""
    return table(spark, sf_dir, name) if of is None else of


# --- courses and encounters from orders --------------------------------------------------------

SPINE = """spine AS (
  SELECT o_custkey AS pid, o_orderkey AS course, CAST(o_orderdate AS DATE) AS s,
         CAST(o_orderdate AS DATE) + (15 + 10 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS e
  FROM orders)"""


def spine(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    length = 15 + 10 * F.substring("o_orderpriority", 1, 1).cast("int")
    return _source(spark, sf_dir, "orders", of).select(
        F.col("o_custkey").alias("pid"),
        F.col("o_orderkey").alias("course"),
        day("o_orderdate").alias("start"),
        F.date_add(day("o_orderdate"), length).alias("end"),
    )


ENCOUNTERS = """encounter AS (
  SELECT o_custkey AS pid, CAST(o_orderdate AS DATE) AS admit_date,
         CASE WHEN o_orderstatus <> 'P'
              THEN CAST(o_orderdate AS DATE) + CAST(floor(o_totalprice / 5000) AS INTEGER) END AS discharge_date,
         floor(o_totalprice / 5000) AS los_days,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS drg
  FROM orders)"""
PLANNED = "URGENT"


def encounters(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    stay = F.floor(F.col("o_totalprice") / 5000).cast("int")
    return _source(spark, sf_dir, "orders", of).select(
        F.col("o_custkey").alias("pid"),
        day("o_orderdate").alias("admit_date"),
        F.when(F.col("o_orderstatus") != "P", F.date_add(day("o_orderdate"), stay)).alias("discharge_date"),
        stay.cast("double").alias("los_days"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("drg"),
    )


ED = """ed_visit AS (
  SELECT o_custkey AS pid, CAST(o_orderdate AS DATE) AS ed_arrival_date FROM orders WHERE o_orderstatus = 'F')"""


def ed_visits(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return (
        _source(spark, sf_dir, "orders", of)
        .where(F.col("o_orderstatus") == "F")
        .select(F.col("o_custkey").alias("pid"), day("o_orderdate").alias("ed_arrival_date"))
    )


SOCIAL = """social AS (
  SELECT o_custkey AS pid, CAST(o_orderdate AS DATE) AS reported_date, o_orderkey AS ord,
         CASE o_orderstatus WHEN 'P' THEN 'Defer' ELSE o_orderstatus END AS tobacco,
         CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'Not Asked' ELSE o_orderpriority END AS alcohol,
         CASE WHEN o_totalprice > 250000 THEN 'high' END AS illicit_drug,
         CASE WHEN o_totalprice > 50000 THEN 'Yes' ELSE 'No' END AS sexually_active
  FROM orders)"""


def social(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    price = F.col("o_totalprice")
    return _source(spark, sf_dir, "orders", of).select(
        F.col("o_custkey").alias("pid"),
        day("o_orderdate").alias("reported_date"),
        F.col("o_orderkey").alias("source_order"),
        F.when(F.col("o_orderstatus") == "P", "Defer").otherwise(F.col("o_orderstatus")).alias("tobacco"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Not Asked")
        .otherwise(F.col("o_orderpriority"))
        .alias("alcohol"),
        F.when(price > 250000, "high").alias("illicit_drug"),
        F.when(price > 50000, "Yes").otherwise("No").alias("sexually_active"),
    )


PATIENTS = """patient AS (
  SELECT c_custkey AS pid, DATE '1985-06-30' - CAST(floor(c_acctbal) AS INTEGER) AS dob, c_mktsegment AS race
  FROM customer)"""


def patients(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    born = F.date_sub(F.lit("1985-06-30").cast("date"), F.floor("c_acctbal").cast("int"))
    return _source(spark, sf_dir, "customer", of).select(
        F.col("c_custkey").alias("pid"), born.alias("dob"), F.col("c_mktsegment").alias("race")
    )


# --- lines: one row per order line with the ordering customer ------------------------------------

LINES = """line AS (
  SELECT o_custkey AS pid, CAST(l_shipdate AS DATE) AS d, p_name, p_brand, p_type, p_size, l.*
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pid"))


def lines(spark: SparkSession, sf_dir: str, part: bool = True, owner: DataFrame | None = None) -> DataFrame:
    """Order lines of a customer, or of ``owner`` by ``l_orderkey``; Spark prunes whatever a query does not read."""
    owner = owners(spark, sf_dir) if owner is None else owner
    joined = table(spark, sf_dir, "lineitem").join(owner, "l_orderkey").withColumn("d", day("l_shipdate"))
    if part:
        joined = joined.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.withColumn("source_order", F.struct(*LINE_ORDER))


def by_patient(rows: DataFrame, name: str) -> DataFrame:
    """Lines as the families read them, written once, clustered by patient."""
    unread = ("source_order", "l_shipdate", "l_extendedprice", "p_partkey", "p_retailprice")
    return bucketed(rows.drop(*unread), name, ["pid"]).withColumn("source_order", F.struct(*LINE_ORDER))


VITALS = """vital AS (
  SELECT o_custkey AS pid, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         CASE WHEN l_returnflag <> 'N' THEN l_quantity + 40 END AS weight_kg,
         CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS bmi,
         CASE WHEN l_linestatus = 'F' THEN l_quantity * 3 + 20 END AS sbp,
         CASE WHEN l_linestatus = 'F' THEN l_quantity + 40 END AS dbp,
         l_quantity * 2 + 10 AS pulse,
         100 - l_discount * 110 AS spo2,
         36 + l_tax * 30 AS temp_c,
         CAST(nullif(l_linenumber, 7) AS DOUBLE) AS pain
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def vitals(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    q, closed = F.col("l_quantity"), F.col("l_linestatus") == "F"
    return (lines(spark, sf_dir, part=False) if of is None else of).select(
        "pid",
        F.col("d").alias("taken_date"),
        "source_order",
        F.when(F.col("l_returnflag") != "N", q + 40).alias("weight_kg"),
        F.when(F.col("l_returnflag") != "A", q).alias("bmi"),
        F.when(closed, q * 3 + 20).alias("sbp"),
        F.when(closed, q + 40).alias("dbp"),
        (q * 2 + 10).alias("pulse"),
        (100 - F.col("l_discount") * 110).alias("spo2"),
        (36 + F.col("l_tax") * 30).alias("temp_c"),
        F.nullif("l_linenumber", F.lit(7)).cast("double").alias("pain"),
    )


LABS = """lab_source AS (
  SELECT pid, d, CASE WHEN l_linenumber <> 6 THEN p_name END AS test_name, CASE p_type WHEN 'PROMO' THEN '' ELSE p_brand END AS base_name,
         'Brand#' || CAST(l_linenumber AS VARCHAR) AS test_description,
         CASE l_returnflag WHEN 'N' THEN '' ELSE l_returnflag END AS abnormal_flag,
         l_linestatus AS status_code, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
  FROM line),
lab AS (SELECT * REPLACE (coalesce(test_name, 'Sodium') AS test_name) FROM lab_source)"""


def labs(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return (lines(spark, sf_dir) if of is None else of).select(
        "pid",
        F.col("d").alias("specimen_date"),
        F.when(F.col("l_linenumber") != 6, F.col("p_name")).alias("test_name"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_brand")).alias("base_name"),
        F.concat(F.lit("Brand#"), F.col("l_linenumber").cast("string")).alias("test_description"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("abnormal_flag"),
        F.col("l_linestatus").alias("status_code"),
        "source_order",
    )


MEDS = """med AS (
  SELECT pid, p_name AS drug_name, CASE WHEN l_tax > 0 THEN d END AS start_date,
         CASE WHEN l_linestatus = 'F' OR l_returnflag <> 'N' THEN d + CAST(l_quantity AS INTEGER) END AS end_date
  FROM line)"""
DICTIONARY = """rx AS (
  SELECT DISTINCT p_name AS drug_name, p_name AS ingredient,
         CASE p_type WHEN 'SMALL' THEN 'other' ELSE p_type || ' ' || split_part(p_name, ' ', 1) END AS class
  FROM part WHERE p_name NOT LIKE 'cold%')"""
AGENT_KEYWORD, AGENT_EXCLUDED = "PROMO hot", ("hot ring", "hot bolt")


def medications(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    ended = (F.col("l_linestatus") == "F") | (F.col("l_returnflag") != "N")
    return (lines(spark, sf_dir) if of is None else of).select(
        "pid",
        F.col("p_name").alias("drug_name"),
        F.when(F.col("l_tax") > 0, F.col("d")).alias("start_date"),
        F.when(ended, F.date_add("d", F.col("l_quantity").cast("int"))).alias("end_date"),
    )


def drug_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first_word = F.substring_index("p_name", " ", 1)
    return (
        table(spark, sf_dir, "part")
        .where(~F.col("p_name").startswith("cold"))
        .select(
            F.col("p_name").alias("drug_name"),
            F.col("p_name").alias("ingredient"),
            F.when(F.col("p_type") == "SMALL", "").otherwise(F.concat_ws(" ", "p_type", first_word)).alias("class"),
        )
    )


# --- codes: parts as diagnoses and as their dictionaries ------------------------------------------

CODES = """code_part AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_size,
         lpad(CAST(p_size AS VARCHAR), 3, '0') AS c3,
         substr(p_brand, 7, 1) AS b1, lpad(substr(p_brand, 7), 2, '0') AS b2,
         substr(p_type, 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS ten3
  FROM part),
xwalk_rows AS (
  SELECT c3 || CASE WHEN p_size <= 20 THEN '' WHEN p_size <= 35 THEN '0' ELSE '00' END AS code9,
         ten3 || b1 AS code10, p_partkey * 3 AS ord FROM code_part
  UNION ALL SELECT c3 || b1, ten3 || b2, p_partkey * 3 + 1 FROM code_part WHERE p_type = 'STANDARD'
  UNION ALL SELECT c3 || '9', ten3 || '9', p_partkey * 3 + 2 FROM code_part WHERE p_type = 'MEDIUM'),
xwalk AS (SELECT code9, first(code10 ORDER BY ord) AS code10 FROM xwalk_rows GROUP BY 1),
chapters AS (
  SELECT three_digit, CASE three_digit WHEN 'C79' THEN 'Secondary malignant neoplasm of other and unspecified sites'
                      ELSE first(sub_chapter ORDER BY ord) END AS sub_chapter
  FROM (SELECT ten3 AS three_digit, p_brand AS sub_chapter, p_partkey AS ord FROM code_part WHERE p_size <= 45
        UNION ALL SELECT 'C79', p_type, p_partkey FROM code_part
        UNION ALL SELECT 'Z29', 'Fourth code', 0 UNION ALL SELECT 'V10', 'Fifth code', 0) GROUP BY three_digit),
terms AS (
  SELECT code, first(short_desc ORDER BY ord) AS short_desc
  FROM (SELECT ten3 AS code, p_name AS short_desc, p_partkey AS ord FROM code_part WHERE p_size <= 30
        UNION ALL SELECT 'C79' || b1, p_type, p_partkey FROM code_part WHERE b1 < '7'
        UNION ALL SELECT 'Z29', 'Fourth code', 0 UNION ALL SELECT 'V10', 'Fifth code', 0) GROUP BY code),
short_terms AS (
  SELECT ten3 AS code, first(p_name ORDER BY p_partkey) AS short_desc FROM code_part
  WHERE p_size > 25 AND p_size <= 40 GROUP BY 1)"""

PART_LIST = """CASE p_type WHEN 'STANDARD' THEN c3 WHEN 'MEDIUM' THEN c3 || ' ,' || c3 || '.' || b1
      WHEN 'LARGE' THEN c3 || ' ,' || c3 || '.' || b1 || ' ,' || c3 || '.' || b2
      WHEN 'PROMO' THEN c3 || '.' || b2 || ' ,C79.' || b1
      WHEN 'ECONOMY' THEN c3 || ' ,' || c3 || '.' || b1 || ' ,' || c3 || '.' || b2 || ' ,Z29 ,V10.' || b1 END"""


def code_parts(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Parts with their code pieces; ``of`` are rows that have the part's columns, and keep their own."""
    size = F.col("p_size").cast("string")
    digits = F.substring_index("p_brand", "#", -1)
    return _source(spark, sf_dir, "part", of).select(
        "*",
        F.lpad(size, 3, "0").alias("c3"),
        F.substring(digits, 1, 1).alias("b1"),
        F.lpad(digits, 2, "0").alias("b2"),
        F.concat(F.substring("p_type", 1, 1), F.lpad(size, 2, "0")).alias("ten3"),
    )


def diagnosis_list() -> Column:
    three = F.col("c3")
    four = F.concat("c3", F.lit("."), "b1")
    five = F.concat("c3", F.lit("."), "b2")
    join = lambda *c: F.concat_ws(" ,", *c)
    return (
        F.when(F.col("p_type") == "STANDARD", three)
        .when(F.col("p_type") == "MEDIUM", join(three, four))
        .when(F.col("p_type") == "LARGE", join(three, four, five))
        .when(F.col("p_type") == "PROMO", join(five, F.concat(F.lit("C79."), "b1")))
        .when(
            F.col("p_type") == "ECONOMY",
            join(three, four, five, F.lit("Z29"), F.concat(F.lit("V10."), "b1")),
        )
    )


def crosswalk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = code_parts(spark, sf_dir)
    key = F.col("p_partkey") * 3
    padded = F.when(F.col("p_size") <= 20, "").when(F.col("p_size") <= 35, "0").otherwise("00")
    plain = p.select(
        F.concat("c3", padded).alias("code9"), F.concat("ten3", "b1").alias("code10"), key.alias("source_order")
    )
    standard = p.where(F.col("p_type") == "STANDARD").select(
        F.concat("c3", "b1").alias("code9"), F.concat("ten3", "b2").alias("code10"), (key + 1).alias("source_order")
    )
    nines = p.where(F.col("p_type") == "MEDIUM").select(
        F.concat("c3", F.lit("9")).alias("code9"),
        F.concat("ten3", F.lit("9")).alias("code10"),
        (key + 2).alias("source_order"),
    )
    return plain.unionByName(standard).unionByName(nines)


def _late_codes(spark: SparkSession, *columns: str) -> DataFrame:
    """Dictionary rows of the codes that lists hold in fourth and fifth place, so that a cut of the lists shows."""
    rows = [("Z29", "Fourth code", 0), ("V10", "Fifth code", 0)]
    return spark.createDataFrame(rows, f"{columns[0]} string, {columns[1]} string, source_order long")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = code_parts(spark, sf_dir)
    named = p.where(F.col("p_size") <= 45).select(
        F.col("ten3").alias("three_digit"), F.col("p_brand").alias("sub_chapter"), F.col("p_partkey").alias("source_order")
    )
    full = p.select(
        F.lit("C79").alias("three_digit"), F.col("p_type").alias("sub_chapter"), F.col("p_partkey").alias("source_order")
    )
    return named.unionByName(full).unionByName(_late_codes(spark, "three_digit", "sub_chapter"))


def term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = code_parts(spark, sf_dir)
    three = p.where(F.col("p_size") <= 30).select(
        F.col("ten3").alias("code"), F.col("p_name").alias("short_desc"), F.col("p_partkey").alias("source_order")
    )
    four = p.where(F.col("b1") < "7").select(
        F.concat(F.lit("C79"), "b1").alias("code"), F.col("p_type").alias("short_desc"), F.col("p_partkey").alias("source_order")
    )
    return three.unionByName(four).unionByName(_late_codes(spark, "code", "short_desc"))


def short_term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = code_parts(spark, sf_dir)
    return p.where((F.col("p_size") > 25) & (F.col("p_size") <= 40)).select(
        F.col("ten3").alias("code"), F.col("p_name").alias("short_desc"), F.col("p_partkey").alias("source_order")
    )


# --- source-system rows for the cohort: text ids, id changes, plan lines, charges -------------------

PEOPLE = """id_change AS (
  SELECT CAST(c_custkey AS VARCHAR) AS old_id, 'N' || CAST(c_nationkey AS VARCHAR) || c_mktsegment AS new_id
  FROM customer WHERE c_acctbal < 0),
person AS (
  SELECT DISTINCT coalesce(new_id, CAST(c_custkey AS VARCHAR)) AS mrn, 'P' || coalesce(new_id, CAST(c_custkey AS VARCHAR)) AS pid
  FROM customer LEFT JOIN id_change ON old_id = CAST(c_custkey AS VARCHAR) WHERE c_mktsegment <> 'FURNITURE')"""


def id_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").cast("string").alias("old_id"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("new_id"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered patients; one market segment is not in the registry."""
    current = (
        table(spark, sf_dir, "customer")
        .where(F.col("c_mktsegment") != "FURNITURE")
        .select(F.col("c_custkey").cast("string").alias("old_id"))
        .join(id_changes(spark, sf_dir), "old_id", "left")
        .select(F.coalesce("new_id", "old_id").alias("mrn"))
    )
    return current.distinct().withColumn("pid", F.concat(F.lit("P"), "mrn"))


PLANS = """plan_report AS (
  SELECT CAST(o_custkey AS VARCHAR) AS patient_id, o_orderkey AS course_id, l_returnflag || l_linestatus AS machine,
         CASE WHEN l_tax > 0 THEN l_extendedprice END AS planned_dose, l_quantity AS planned_fractions,
         CAST(l_linenumber AS DOUBLE) AS delivered_fractions, l_discount * 100 AS delivered_dose, l_tax AS revision,
         CAST(o_orderdate AS DATE) + CAST(l_linenumber AS INTEGER) AS first_day,
         CAST(o_orderdate AS DATE) + CAST(l_quantity AS INTEGER) + 7 AS last_day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
MACHINES, ENDS_AFTER, STARTS_BEFORE = ("NO", ""), "1996-12-31", "2001-01-01"


def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("o_day"))
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.col("o_orderkey").alias("course_id"),
        F.concat("l_returnflag", "l_linestatus").alias("machine"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("planned_dose"),
        F.col("l_quantity").alias("planned_fractions"),
        F.col("l_linenumber").cast("double").alias("delivered_fractions"),
        (F.col("l_discount") * 100).alias("delivered_dose"),
        F.col("l_tax").alias("revision"),
        F.date_add("o_day", F.col("l_linenumber").cast("int")).alias("first_day"),
        F.date_add("o_day", F.col("l_quantity").cast("int") + 7).alias("last_day"),
    )


CHARGES = """charge AS (
  SELECT CAST(pid AS VARCHAR) AS patient_id, d AS service_date, p_name || ' ' || p_type AS description,
         CASE WHEN l_quantity > 2 THEN p_brand END AS attending
  FROM line)"""
NON_TREATMENTS = ("gizmo", "cold plate")
TECHNIQUE_RULES: dict[str, dict[str, tuple[str, ...]]] = {
    "srssbrt": {"equals": ("hot ring PROMO", "blue rod SMALL"), "contains": ("widget",)},
    "conv": {"contains": ("LARGE",)},
    "imrtvmat": {"equals": ("red ring SMALL", "red anvil MEDIUM")},
    "brachy": {"contains": ("hot bolt", "small gear ECONOMY")},
    "tbi": {"equals": ("cold rod STANDARD",)},
    "tsi": {"equals": ("large ring PROMO", "large bolt PROMO")},
}
TECHNIQUES_SQL = """CASE WHEN description IN ('hot ring PROMO', 'blue rod SMALL') OR description LIKE '%widget%' THEN 1 ELSE 0 END AS srssbrt,
         CASE WHEN description LIKE '%LARGE%' THEN 1 ELSE 0 END AS conv,
         CASE WHEN description IN ('red ring SMALL', 'red anvil MEDIUM') THEN 1 ELSE 0 END AS imrtvmat,
         CASE WHEN description LIKE '%hot bolt%' OR description LIKE '%small gear ECONOMY%' THEN 1 ELSE 0 END AS brachy,
         CASE WHEN description = 'cold rod STANDARD' THEN 1 ELSE 0 END AS tbi,
         CASE WHEN description IN ('large ring PROMO', 'large bolt PROMO') THEN 1 ELSE 0 END AS tsi"""


def charges(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("patient_id", F.col("pid").cast("string")) if of is None else of
    return rows.select(
        "patient_id",
        F.col("d").alias("service_date"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.when(F.col("l_quantity") > 2, F.col("p_brand")).alias("attending"),
    )
