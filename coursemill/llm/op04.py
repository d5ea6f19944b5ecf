from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursemill.llm.pivots import near_duplicates
from coursemill.llm.registered import query

LEAST_COSINE = 0.93

SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) = list_count(embedding)
      AND list_max(embedding) < 'infinity'::FLOAT AND list_min(embedding) > '-infinity'::FLOAT
      AND (list_max(embedding) > 0 OR list_min(embedding) < 0)),
link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b USING (label)
    WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


@query("op4_embedding_near_dedup", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), LEAST_COSINE)
