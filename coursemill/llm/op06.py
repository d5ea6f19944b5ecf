from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.langid import fold, predict, train
from coursemill.llm.registered import query

FOLDS = 4
HELD_OUT = 2


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    model = train(held.where("NOT held_out"))
    return predict(held, model, ("doc_id", "held_out"))
