from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursemill.llm.fingerprint import PIECE_END, fingerprints
from coursemill.llm.registered import query


@query("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), end=PIECE_END)
