"""Code and name mapping: crosswalks with key repair, roll-ups, dictionaries.

Dictionaries hold one row per code. Where Spark finds them small they are broadcast and lookups
stay in the scanning stage; otherwise they are shuffled joins with AQE skew handling. Callers
reduce rows to distinct (entity, code) first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.functions.nulls import nonblank
from coursemill.operators.joins import drop_members, keep_members, map_values
from coursemill.operators.rollups import first_by_order
from coursemill.session import materialise

# The rolled-up category that is kept at full length, its label, and the label of
# codes without a category.
FULL_LENGTH_CATEGORY = "C79"
FULL_LENGTH_LABEL = "Secondary malignant neoplasm of other and unspecified sites"
UNMATCHED_LABEL = "Prophylactic measures"

# Fixed value: the lab whose test name is left empty in the source.
MISSING_TEST = "Sodium"

# Class keyword of the systemic agents and the ingredients taken off that list
# after clinical review.
AGENT_CLASS_KEYWORD = "Antineoplastic"
EXCLUDED_INGREDIENTS = (
    "6-O-palmitoylascorbic acid", "azelaic acid", "Curcumin", "Dexamethasone", "Dexrazoxane",
    "Dexrazoxane hydrochloride", "Dihematoporphyrin Ether", "Eflornithine", "enrofloxacin",
    "Grape Seed Extract", "mycophenolate mofetil", "mycophenolate sodium", "Mycophenolic Acid",
    "Podofilox", "prednisolone", "Prednisone", "Resveratrol", "Sulindac",
)


def build_crosswalk(rows: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """One target per source code: the first listed."""
    return first_by_order(rows, source, target, order).select(source, target)


def map_codes(
    df: DataFrame,
    code: str,
    crosswalk: DataFrame,
    source: str,
    target: str,
    last_nine: bool = False,
    keep_unmatched: bool = True,
) -> DataFrame:
    """Add ``code_final`` (the spelling that matched) and ``code_mapped`` (its target).

    Spellings are tried in order: as is; with a 0 appended if it has three characters; with a 0
    appended if it then has four; with ``last_nine``, with the last character of more than three
    replaced by 9. With ``keep_unmatched`` a code without a match keeps its last padded spelling as
    the target; otherwise its rows are dropped. ``crosswalk`` has one row per ``source`` code.
    """
    first = F.col("_code")
    padded = F.when(F.length(first) == 3, F.concat(first, F.lit("0"))).otherwise(first)
    full = F.when(F.length(padded) == 4, F.concat(padded, F.lit("0"))).otherwise(padded)
    tries = [first, padded, full]
    if last_nine:
        closing = F.concat(F.substring(full, F.lit(1), F.length(full) - 1), F.lit("9"))
        tries.append(F.when(F.length(full) > 3, closing).otherwise(full))
    lookup = crosswalk.select(F.col(source).alias("_spelling"), F.col(target).alias("_entry")).where("_entry IS NOT NULL")
    found = _first_entry(df, code, [F.struct(F.lit(i).alias("turn"), t.alias("_spelling")) for i, t in enumerate(tries)], lookup)
    joined = df.join(found, F.col(code) == F.col("_code"), "left").drop("_code").withColumn("_code", F.col(code))
    mapped = F.coalesce("_hit._entry", *([full] if keep_unmatched else []))
    return (
        joined.withColumns({"code_final": F.coalesce("_hit._spelling", full), "code_mapped": mapped})
        .drop("_hit", "_code")
        .where(F.col("code_mapped").isNotNull())
    )


def _first_entry(df: DataFrame, code: str, tries: list[Column], lookup: DataFrame) -> DataFrame:
    """(_code, _hit): the entry of the first try that ``lookup`` lists, for each distinct code that has one.

    ``tries`` are structs of ``turn`` and lookup columns, in terms of ``_code``. All tries meet the dictionary in one
    join, of the distinct codes only.
    """
    keys = [c for c in lookup.columns if c != "_entry"]
    distinct = df.select(F.col(code).alias("_code")).distinct()
    candidates = distinct.select("_code", F.inline(F.array(*tries)))
    return candidates.join(lookup, keys).groupBy("_code").agg(F.min_by(F.struct(*keys, "_entry"), "turn").alias("_hit"))


def roll_up(code: Column) -> Column:
    """First three characters, except the category that keeps its full code."""
    return F.when(code.startswith(FULL_LENGTH_CATEGORY), code).otherwise(F.substring(code, 1, 3))


def subchapter_map(hierarchy: DataFrame, order: str) -> DataFrame:
    """``(three_digit, sub_chapter)``: the first listed, with the full-length category relabelled."""
    first = first_by_order(hierarchy, "three_digit", "sub_chapter", order)
    relabelled = F.when(F.col("three_digit") == FULL_LENGTH_CATEGORY, F.lit(FULL_LENGTH_LABEL)).otherwise(
        F.col("sub_chapter")
    )
    return first.select("three_digit", relabelled.alias("sub_chapter"))


def label_subchapter(
    df: DataFrame, code: str, subchapters: DataFrame, unmatched: str | None = UNMATCHED_LABEL
) -> DataFrame:
    """Add ``sub_chapter`` of the code's first three characters; ``unmatched=None`` drops the rest."""
    joined = df.withColumn("three_digit", F.substring(code, 1, 3)).join(subchapters, "three_digit", "left")
    joined = joined.drop("three_digit")
    if unmatched is None:
        return joined.where(F.col("sub_chapter").isNotNull())
    return joined.withColumn("sub_chapter", F.coalesce("sub_chapter", F.lit(unmatched)))


def describe_codes(
    df: DataFrame,
    code: str,
    terms: DataFrame,
    short_terms: DataFrame | None = None,
    unmatched: str | None = UNMATCHED_LABEL,
) -> DataFrame:
    """Add ``description``: of the code, else of its first four characters, else the short term.

    ``terms`` and ``short_terms`` are ``(code, short_desc)`` with one row per code.
    """
    lists = [terms.withColumn("_list", F.lit("terms"))] + ([] if short_terms is None else [short_terms.withColumn("_list", F.lit("short"))])
    entries = [d.select("_list", F.col("code").alias("_spelling"), F.col("short_desc").alias("_entry")).where("_entry IS NOT NULL") for d in lists]
    lookup = entries[0] if len(entries) == 1 else entries[0].unionByName(entries[1])
    tries = [("terms", F.col("_code")), ("terms", F.substring("_code", 1, 4)), ("short", F.col("_code"))]
    turns = [F.struct(F.lit(i).alias("turn"), F.lit(name).alias("_list"), t.alias("_spelling")) for i, (name, t) in enumerate(tries)]
    found = _first_entry(df, code, turns, lookup)
    joined = df.join(found, F.col(code) == F.col("_code"), "left").withColumn("description", F.col("_hit._entry")).drop("_code", "_hit")
    if unmatched is None:
        return joined.where(F.col("description").isNotNull())
    return joined.withColumn("description", F.coalesce("description", F.lit(unmatched)))


def canonical_names(
    df: DataFrame, test: str, base: str, description: str, order: str, alias: str = "canonical", missing: str = MISSING_TEST
) -> DataFrame:
    """One name per lab from its test name, base name and description.

    A missing (not a blank) test name becomes ``missing``, in the result as well.
    Writes the distinct names and the mapping to the shared folder while the plan is built.

    1. a test name becomes the base name it was first listed with;
    2. a result that equals some test's description becomes the first name listed for it;
    3. rows left without a name are dropped.
    """
    df = df.withColumn(test, F.coalesce(F.col(test), F.lit(missing)))
    # All three steps depend on the distinct names only. That vocabulary is written once, and the
    # lab rows meet a single small (test name, canonical name) mapping.
    vocabulary = materialise(
        df.groupBy(F.col(test).alias("_t"), F.col(base).alias("_b"), F.col(description).alias("_d")).agg(
            F.min(order).alias("_o")
        ),
        "lab_names",
    )
    both = vocabulary.where(nonblank(F.col("_b")) & nonblank(F.col("_t")))
    base_of_test = first_by_order(both, "_t", "_b", "_o", "_base")
    renamed = map_values(vocabulary.withColumn("_name", F.col("_t")), "_name", base_of_test, "_t", "_base")
    described = renamed.where(nonblank(F.col("_name")) & nonblank(F.col("_d")))
    name_of_description = first_by_order(described, "_d", "_name", "_o")
    tests = renamed.select("_t", "_name").distinct()
    mapping = map_values(
        tests, "_name", name_of_description.withColumnRenamed("_name", "_first"), "_d", "_first"
    ).where(nonblank(F.col("_name")))
    mapping = materialise(mapping, "lab-mapping")
    return (
        df.join(mapping, F.col(test) == F.col("_t")).drop("_t").withColumnRenamed("_name", alias)
    )


def first_test_names(
    df: DataFrame, test: str, base: str, order: str, alias: str = "first_test", missing: str = MISSING_TEST
) -> DataFrame:
    """Add the test name each base name was first listed with; an unlisted base name stays itself."""
    df = df.withColumn(test, F.coalesce(F.col(test), F.lit(missing)))
    both = df.where(nonblank(F.col(base)) & nonblank(F.col(test)))
    test_of_base = first_by_order(both, base, test, order, "_test")
    return map_values(df.withColumn(alias, F.col(base)), alias, test_of_base, base, "_test")


def drug_classes(dictionary: DataFrame) -> DataFrame:
    """Distinct ``(drug_name, ingredient, class)`` with blanks labelled ``other``."""
    named = {c: F.when(F.col(c) == "", F.lit("other")).otherwise(F.col(c)) for c in ("ingredient", "class")}
    return dictionary.select("drug_name", "ingredient", "class").withColumns(named).distinct()


def cohort_ingredients(
    classes: DataFrame,
    orders: DataFrame,
    keyword: str = AGENT_CLASS_KEYWORD,
    exclude: Iterable[str] = EXCLUDED_INGREDIENTS,
) -> DataFrame:
    """Ingredients of ordered drugs with a class that holds ``keyword``, without the excluded ones."""
    ordered = keep_members(classes, orders.select("drug_name").distinct(), "drug_name")
    agents = ordered.where(F.col("class").contains(keyword)).select("ingredient").distinct()
    excluded = orders.sparkSession.createDataFrame([(i,) for i in exclude], "ingredient string")
    return drop_members(agents, excluded, "ingredient")
