"""Evaluation queries on scored rows: document length against quality, order price against status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.learning import evaluate
from coursemill.workload import roles
from coursemill.workload.registry import query

_DOC = "scores AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"
_ORDERS = "scores AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice AS score FROM orders)"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = roles.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return roles.table(spark, sf, "labels").join(docs, "doc_id").select(F.col("quality").alias("label"), "score")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"), F.col("o_totalprice").alias("score")
    )


_POINTS = """size AS (SELECT sum(label) AS m, count(*) - sum(label) AS k FROM scores),
distinct_scores AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores GROUP BY score),
points AS (
  SELECT score AS threshold, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, m, k
  FROM distinct_scores, size),
ends AS (
  SELECT coalesce((threshold + lag(threshold) OVER (ORDER BY threshold)) / 2, '-infinity'::DOUBLE) AS threshold, tp, fp, m, k FROM points
  UNION ALL SELECT 'infinity'::DOUBLE, 0, 0, m, k FROM size),
roc AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tp AS DOUBLE) / m AS sensitivity, 1 - CAST(fp AS DOUBLE) / k AS specificity FROM ends)"""


@query(
    "roc_points",
    f"WITH {_ORDERS}, {_POINTS} SELECT threshold, tp, fp, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM roc",
)
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.roc_points(_orders(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("sensitivity", "specificity")}
    )


# Pair by pair, as the definition has it.
_PAIRS = """numbered AS (SELECT row_number() OVER () AS rid, label, score FROM scores),
pairs AS (
  SELECT p.rid AS pr, n.rid AS nr, CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END AS win
  FROM numbered p JOIN numbered n ON p.label = 1 AND n.label = 0)"""


@query(
    "auc",
    f"""WITH {_DOC}, {_PAIRS}
SELECT (SELECT CAST(sum(label) AS BIGINT) FROM scores) AS n_pos, (SELECT CAST(count(*) - sum(label) AS BIGINT) FROM scores) AS n_neg,
       round(avg(win), 6) AS auc FROM pairs""",
)
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.auc(_documents(spark, sf)).withColumn("auc", F.round("auc", 6))


@query(
    "auc_delong",
    f"""WITH {_DOC}, {_PAIRS},
v10 AS (SELECT pr, avg(win) AS v FROM pairs GROUP BY pr), v01 AS (SELECT nr, avg(win) AS v FROM pairs GROUP BY nr),
est AS (
  SELECT (SELECT avg(win) FROM pairs) AS auc, (SELECT count(*) FROM v10) AS n_pos, (SELECT count(*) FROM v01) AS n_neg,
         sqrt((SELECT var_samp(v) / count(*) FROM v10) + (SELECT var_samp(v) / count(*) FROM v01)) AS se)
SELECT n_pos, n_neg, round(auc, 6) AS auc, round(se, 6) AS se,
       round(greatest(auc - 1.959963984540054 * se, 0), 6) AS ci_low, round(least(auc + 1.959963984540054 * se, 1), 6) AS ci_high FROM est""",
)
def auc_delong(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.auc_interval(_documents(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("auc", "se", "ci_low", "ci_high")}
    )


@query(
    "best_cutoffs",
    f"""WITH {_ORDERS}, {_POINTS}
SELECT (SELECT threshold FROM roc ORDER BY round((1 - sensitivity) * (1 - sensitivity) + (1 - specificity) * (1 - specificity), 12), threshold LIMIT 1) AS topleft,
       (SELECT threshold FROM roc ORDER BY round(sensitivity + specificity, 12) DESC, threshold LIMIT 1) AS youden""",
)
def best_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.best_cutoffs(_orders(spark, sf))


@query(
    "cutoff_confusion",
    f"""WITH {_ORDERS}, {_POINTS},
picked AS (
  SELECT 'topleft' AS rule, (SELECT threshold FROM roc ORDER BY round((1 - sensitivity) * (1 - sensitivity) + (1 - specificity) * (1 - specificity), 12), threshold LIMIT 1) AS cutoff
  UNION ALL SELECT 'youden', (SELECT threshold FROM roc ORDER BY round(sensitivity + specificity, 12) DESC, threshold LIMIT 1))
SELECT rule, cutoff, tp, fp, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM picked JOIN roc ON threshold = cutoff""",
)
def cutoff_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion at the best cutoffs; its rates are those of the chosen points of the curve."""
    scores = _orders(spark, sf)
    best = evaluate.best_cutoffs(scores).first()
    table = evaluate.confusion(scores, {"topleft": best["topleft"], "youden": best["youden"]})
    return table.select("rule", "cutoff", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity")])


_CUTOFFS = {"half": 250000.0, "low": 100000.0}


@query(
    "confusion",
    f"""WITH {_ORDERS}, cuts(rule, cutoff) AS (VALUES ('half', CAST(250000.0 AS DOUBLE)), ('low', CAST(100000.0 AS DOUBLE))),
cells AS (
  SELECT rule, cutoff, count(*) FILTER (WHERE label = 1 AND score > cutoff) AS tp, count(*) FILTER (WHERE label = 0 AND score > cutoff) AS fp,
         count(*) FILTER (WHERE label = 1 AND score <= cutoff) AS fn, count(*) FILTER (WHERE label = 0 AND score <= cutoff) AS tn
  FROM scores, cuts GROUP BY rule, cutoff),
rates AS (SELECT *, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM cells)
SELECT rule, cutoff, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy,
       round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n))
             / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)), 6) AS kappa,
       round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS sensitivity, round(CAST(tn AS DOUBLE) / (tn + fp), 6) AS specificity,
       round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS ppv, round(CAST(tn AS DOUBLE) / (tn + fn), 6) AS npv, round((tp + fn) / n, 6) AS prevalence
FROM rates""",
)
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    rates = ("accuracy", "kappa", "sensitivity", "specificity", "ppv", "npv", "prevalence")
    return evaluate.confusion(_orders(spark, sf), _CUTOFFS).withColumns({c: F.round(c, 6) for c in rates})


_MODELS = """scores AS (
  SELECT 'price' AS model, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice AS score FROM orders
  UNION ALL
  SELECT 'priority', CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) FROM orders)"""


def _models(spark: SparkSession, sf: str) -> DataFrame:
    orders = roles.table(spark, sf, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    price = orders.select(F.lit("price").alias("model"), label, F.col("o_totalprice").alias("score"))
    priority = orders.select(
        F.lit("priority").alias("model"), label, F.substring("o_orderpriority", 1, 1).cast("double").alias("score")
    )
    return price.unionByName(priority)


@query(
    "roc_compare",
    f"""WITH {_MODELS},
distinct_scores AS (SELECT model, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores GROUP BY model, score),
points AS (
  SELECT model, score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY model) AS m, sum(neg) OVER (PARTITION BY model) AS k
  FROM distinct_scores WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
ends AS (
  SELECT model, coalesce((threshold + lag(threshold) OVER (PARTITION BY model ORDER BY threshold)) / 2, '-infinity'::DOUBLE) AS threshold, tp, fp, m, k FROM points
  UNION ALL SELECT DISTINCT model, 'infinity'::DOUBLE, 0, 0, m, k FROM points)
SELECT model, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(CAST(tp AS DOUBLE) / m, 6) AS sensitivity,
       round(1 - CAST(fp AS DOUBLE) / k, 6) AS specificity FROM ends""",
)
def roc_compare(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.roc_points(_models(spark, sf), groups=["model"]).withColumns(
        {c: F.round(c, 6) for c in ("sensitivity", "specificity")}
    )


@query(
    "class_counts",
    f"WITH {_DOC} SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM scores",
)
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.class_counts(_documents(spark, sf))
