from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursemill.llm.registered import query
from coursemill.llm.template import main_texts


@query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
