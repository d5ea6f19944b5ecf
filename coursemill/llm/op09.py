from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm import warc
from coursemill.llm.registered import query

SQL = """
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest
    FROM pages),
c AS (
    SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000
    GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, p.url, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN c.winner IS NOT NULL AND p.page_id IS DISTINCT FROM c.winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM c.winner THEN c.winner END AS refers_to
FROM p LEFT JOIN c USING (payload_digest)
"""


@query("op9_warc", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to an archive in the shared folder and describes what is read back."""
    path = warc.archive_folder(spark)
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = warc.read_archive(spark, path)
    return records.select(
        "page_id",
        "url",
        F.col("full_length").alias("payload_bytes"),
        F.when(F.col("payload").isNull(), F.col("digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
