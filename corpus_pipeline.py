"""A training corpus from raw documents: filter, deduplicate, cut repeats, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; all but the last return
the columns of ``docs``. ``run`` writes each stage's result to the shared folder and reads it again, so
a lost executor repeats one stage's tasks at most.

Rows with nulls pass every filter: a null text is not toxic, has no copies and no repeats. Rows that
share a doc_id count as one document. Other columns of ``docs`` are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coursemill.llm import mixing, op05, packing, repeats, shingles
from coursemill.llm import toxicity as tox
from coursemill.llm.op03 import LEAST_SCORE
from coursemill.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the bar; the classifier learns from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = tox.fit(docs.select("doc_id", "text"), labels)
    return docs.where(tox.scorer(spark, model)(F.col("text")) < LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by n-gram similarity, and all without links."""
    links = materialise(shingles.jaccard_links(docs, name="pipeline"), "pipeline-classes")
    dropped = links.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = materialise(links.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    # of rows that share a doc_id the first by text stays
    line = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(F.struct(*docs.columns)))
    numbered = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("document"), F.row_number().over(line).alias("turn"))
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(numbered.where("turn = 1").select("document.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document has; n_chars follows the text."""
    cut = repeats.without_repeats(docs)
    changed = F.col("n_removed") > 0
    out = {"text": F.col("text"), "doc_id": F.col("doc_id")}  # a null text comes back empty
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return cut.select(*[out.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their domain, language and source; one row per epoch of a document."""
    chosen = mixing.mix(docs, op05.tree(), op05.target_weights(), op05.SHARE, op05.EPOCHS, op05.SEED)
    return chosen.select("document", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch")).select("document.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: MinHash banding, suffix sorting and tokenising have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
