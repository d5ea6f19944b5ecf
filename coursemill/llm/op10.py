from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coursemill.llm.packing import pack_documents
from coursemill.llm.registered import query

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY)
