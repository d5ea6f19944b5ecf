"""Model-preparation queries: variance filter, strata and split, design matrix."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.learning import prepare
from coursemill.operators import hash_split
from coursemill.workload import roles
from coursemill.workload.families import _PROC_SQL, _procedures
from coursemill.workload.registry import query


@query(
    "nzv",
    f"""WITH {_PROC_SQL}, size AS (SELECT count(*) AS n FROM spine),
present AS (SELECT family, feature, count(*) AS c FROM proc_long GROUP BY 1, 2),
prof AS (
  SELECT family, feature, CASE WHEN c < n THEN 2 ELSE 1 END AS n_unique,
         CASE WHEN c < n THEN CAST(greatest(c, n - c) AS DOUBLE) / least(c, n - c) ELSE 0 END AS freq_ratio, n FROM present, size)
SELECT family, feature, CAST(n_unique AS BIGINT) AS n_unique, round(freq_ratio, 6) AS freq_ratio, round(100.0 * n_unique / n, 6) AS percent_unique,
       n_unique = 1 OR (freq_ratio > 19 AND 100.0 * n_unique / n <= 10) AS nzv FROM prof""",
)
def nzv(spark: SparkSession, sf: str) -> DataFrame:
    n = roles.spine(spark, sf).agg(F.count(F.lit(1))).scalar()
    profile = prepare.near_zero_variance(_procedures(spark, sf), n)
    return profile.withColumns({c: F.round(c, 6) for c in ("freq_ratio", "percent_unique")})


_NUMERIC = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")


@query(
    "nzv_numeric",
    """WITH size AS (SELECT count(*) AS n FROM lineitem),
long AS (
  """
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) + 0 AS v FROM lineitem" for c in _NUMERIC)
    + """),
counted AS (SELECT feature, v, count(*) AS c, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC) AS r FROM long GROUP BY feature, v),
prof AS (
  SELECT feature, count(*) AS n_unique, coalesce(CAST(max(c) FILTER (WHERE r = 1) AS DOUBLE) / max(c) FILTER (WHERE r = 2), 0) AS freq_ratio
  FROM counted GROUP BY feature)
SELECT feature, n_unique, round(freq_ratio, 6) AS freq_ratio, round(100.0 * n_unique / n, 6) AS percent_unique,
       n_unique = 1 OR (freq_ratio > 19 AND 100.0 * n_unique / n <= 10) AS nzv FROM prof, size""",
)
def nzv_numeric(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = roles.table(spark, sf, "lineitem")
    n = lineitem.agg(F.count(F.lit(1))).scalar()
    long = prepare.numeric_long(lineitem, _NUMERIC, ["l_orderkey"])
    profile = prepare.near_zero_variance(long, n)
    return profile.withColumns({c: F.round(c, 6) for c in ("freq_ratio", "percent_unique")})


_TYPES = ("STANDARD", "PROMO", "MEDIUM", "LARGE", "ECONOMY", "SMALL")
_FLAGS_SQL = ", ".join(
    f"CAST(max(CASE WHEN p_type = '{t}' AND l_quantity > 25 THEN 1 ELSE 0 END) AS INTEGER) AS f_{t}" for t in _TYPES
)
_CLEARED = ["f_STANDARD"] + [f"CASE WHEN f_STANDARD = 1 THEN 0 ELSE f_{t} END AS f_{t}" for t in _TYPES[1:]]
_SUM = " + ".join(f"f_{t}" for t in _TYPES)


def strata_rows(spark: SparkSession, sf: str) -> DataFrame:
    flags = roles.lines(spark, sf).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        *[
            F.max(F.when((F.col("p_type") == t) & (F.col("l_quantity") > 25), 1).otherwise(0)).alias(f"f_{t}")
            for t in _TYPES
        ]
    )
    orders = roles.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("outcome")
    )
    joined = orders.join(flags, "o_orderkey")
    return joined.select("o_orderkey", prepare.stratum_key([f"f_{t}" for t in _TYPES], "outcome").alias("stratum"))


@query(
    "strata_split",
    f"""WITH flags AS (
  SELECT o_orderkey, CASE WHEN any_value(o_orderstatus) = 'F' THEN 1 ELSE 0 END AS outcome, {_FLAGS_SQL}
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey),
cleared AS (SELECT o_orderkey, outcome, {", ".join(_CLEARED)} FROM flags),
keyed AS (
  SELECT o_orderkey, {" || ' ' || ".join(f"CASE WHEN {_SUM} > 1 THEN '2' ELSE CAST(f_{t} AS VARCHAR) END" for t in _TYPES)} || ' ' || outcome AS stratum
  FROM cleared),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('220|' || CAST(o_orderkey AS VARCHAR))) AS r,
         count(*) OVER (PARTITION BY stratum) AS n FROM keyed)
SELECT o_orderkey, stratum, r <= ceil(n * 0.75) AS is_train FROM ranked""",
)
def strata_split(spark: SparkSession, sf: str) -> DataFrame:
    return hash_split(strata_rows(spark, sf), ["o_orderkey"], "stratum")


@query(
    "design_matrix",
    f"""WITH {roles.SPINE}, {_PROC_SQL.split(roles.SPINE + ",", 1)[1]},
base AS (SELECT o_custkey AS pid, o_orderkey AS course, o_orderpriority, o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level FROM orders)
SELECT 'level' AS feature, CAST(sum(level) AS DOUBLE) AS total, count(*) FILTER (WHERE level <> 0) AS n_nonzero FROM base
UNION ALL SELECT 'o_orderpriority' || o_orderpriority, CAST(count(*) AS DOUBLE), count(*) FROM base GROUP BY o_orderpriority
UNION ALL SELECT 'o_orderstatus' || o_orderstatus, CAST(count(*) AS DOUBLE), count(*) FROM base
  WHERE o_orderstatus <> (SELECT min(o_orderstatus) FROM base) GROUP BY o_orderstatus
UNION ALL SELECT feature, CAST(count(*) AS DOUBLE), count(*) FROM proc_long GROUP BY feature""",
)
def design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Column totals of the model matrix."""
    courses = roles.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pid"),
        F.col("o_orderkey").alias("course"),
        "o_orderpriority",
        "o_orderstatus",
        F.substring("o_orderpriority", 1, 1).cast("double").alias("level"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("adm_ed"),
    )
    matrix, names, _ = prepare.design_matrix(
        courses, ["level"], ["o_orderpriority", "o_orderstatus"], _procedures(spark, sf)
    )
    stats = matrix.select(Summarizer.metrics("sum", "numNonZeros").summary(F.col("features")).alias("s")).select(
        F.arrays_zip(
            F.array(*[F.lit(n) for n in names]).alias("feature"),
            vector_to_array("s.sum").alias("total"),
            vector_to_array("s.numNonZeros").alias("n_nonzero"),
        ).alias("columns")
    )
    return stats.select(F.inline("columns")).select("feature", "total", F.col("n_nonzero").cast("long").alias("n_nonzero"))
