from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.langid import fold
from coursemill.llm.registered import query
from coursemill.llm.toxicity import fit, scorer

FOLDS = 3
HELD_OUT = 1
LEAST_SCORE = 0.7


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = fit(docs.where(~held_out), labels.where(~held_out))
    return docs.withColumn("score", scorer(spark, model)(F.col("text"))).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"),
    )
