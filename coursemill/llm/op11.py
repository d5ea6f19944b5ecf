from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursemill.llm.hardnegatives import LEAST_SHARE, MOST_SHARE, NEGATIVES, POSITIVES, SCALE, hard_negatives
from coursemill.llm.registered import query

EVERY, SHIFTED, LABELS = 100, 7, 10

SQL = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) = list_count(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS turn FROM s WHERE same) WHERE turn <= {POSITIVES}),
n AS (
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
        id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND {LEAST_SHARE} * positive_score <= 100 * score AND 100 * score <= {MOST_SHARE} * positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""


@query("op11_hard_negatives", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = f"IF(vec_id % {SHIFTED} = 0, (label + 1) % {LABELS}, label) AS label"
    return hard_negatives(vectors.selectExpr("vec_id", shifted, "embedding"), f"vec_id % {EVERY} = 0")
