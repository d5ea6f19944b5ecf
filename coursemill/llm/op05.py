from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.mixing import mix
from coursemill.llm.registered import query

# The tree and its target weights.
SHARE = 0.5
EPOCHS = 2
SEED = 11


def tree() -> dict[str, Column]:
    """Four domains by source number, then language, then source."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).cast("int"), F.lit(0))
    return {
        "domain": F.concat(F.lit("d"), (number % 4).cast("string")),
        "mix_lang": F.col("lang"),
        "mix_source": F.col("source"),
    }


def target_weights() -> dict[str, Column]:
    lang, domain = F.col("mix_lang"), F.col("domain")
    return {
        "domain": F.when(domain == "d0", 0.25).when(domain == "d1", 0.40).when(domain == "d2", 0.20).otherwise(0.15),
        "mix_lang": F.when(lang == "en", 0.4).when(lang.isin("de", "fr"), 0.25).otherwise(0.1),
    }


def _level(name: str, parent: str, path: str, weight: str) -> str:
    """SQL of one tree level: budgets of the nodes at ``path`` below the nodes at ``parent``."""
    up = f"JOIN {name}_up USING ({parent})" if parent else "CROSS JOIN root"
    family = f"PARTITION BY {parent}" if parent else ""
    last = path.split(", ")[-1]
    return f"""
{name}_n AS (SELECT {path}, sum(tokens) * {EPOCHS} AS cap, {weight} AS w FROM leaves GROUP BY {path}),
{name}_s AS (
    SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
           sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind
    FROM {name}_n {up} WINDOW o AS ({family} ORDER BY cap / w NULLS LAST, {last})),
{name}_f AS (SELECT *, cap <= w * (budget - earlier) / behind + 1e-6 AS is_full FROM {name}_s),
{name}_b AS (
    SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({family}), 0) AS used,
           sum(CASE WHEN NOT is_full THEN w END) OVER ({family}) AS open_w
    FROM {name}_f),
{name}_r AS (
    SELECT {path}, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
                        ELSE greatest((budget - used) * w / open_w, 0.0) END AS given FROM {name}_b)"""


SQL = f"""
WITH d AS (
    SELECT doc_id, source AS mix_source, coalesce(lang, '') AS mix_lang,
           'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 4) AS domain,
           len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS tokens
    FROM documents),
leaves AS (SELECT domain, mix_lang, mix_source, sum(tokens) AS tokens FROM d GROUP BY ALL),
root AS (SELECT sum(tokens) * {SHARE}::DOUBLE AS budget FROM leaves),
{_level("a", "", "domain", "CASE domain WHEN 'd0' THEN 0.25::DOUBLE WHEN 'd1' THEN 0.40 WHEN 'd2' THEN 0.20 ELSE 0.15 END")},
b_up AS (SELECT domain, given AS budget FROM a_r),
{_level("b", "domain", "domain, mix_lang", "CASE WHEN mix_lang = 'en' THEN 0.4::DOUBLE WHEN mix_lang IN ('de', 'fr') THEN 0.25 ELSE 0.1 END")},
c_up AS (SELECT domain, mix_lang, given AS budget FROM b_r),
{_level("c", "domain, mix_lang", "domain, mix_lang, mix_source", "1.0::DOUBLE")},
plan AS (
    SELECT domain, mix_lang, mix_source, CAST(least(floor(floor(given + 1e-6) / tokens), {EPOCHS}) AS BIGINT) AS whole,
           floor(given + 1e-6) AS budget, tokens AS leaf_tokens
    FROM c_r JOIN leaves USING (domain, mix_lang, mix_source)),
k AS (
    SELECT d.*, whole, budget - whole * leaf_tokens AS rest, md5('{SEED}|' || whole || '|' || doc_id) AS epoch_key
    FROM d JOIN plan USING (domain, mix_lang, mix_source)),
s AS (
    SELECT *, sum(tokens) OVER (PARTITION BY domain, mix_lang, mix_source ORDER BY epoch_key) - tokens AS start FROM k)
SELECT doc_id, domain, mix_lang, mix_source, CAST(tokens AS BIGINT) AS tokens,
       CAST(whole + CASE WHEN start < rest AND tokens > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM s WHERE whole + CASE WHEN start < rest AND tokens > 0 THEN 1 ELSE 0 END > 0
"""


@query("op5_source_mixing", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    chosen = mix(docs, tree(), target_weights(), SHARE, EPOCHS, SEED)
    return chosen.select("document.doc_id", "domain", "mix_lang", "mix_source", "tokens", "copies")
