"""From course rows to a model matrix: encoding, variance filter, strata, split."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer, OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.operators.ranking import hash_split
from coursemill.operators.reshape import FAMILY, FEATURE, family_safe
from coursemill.plans.cohort import KEYS
from coursemill.session import materialise

# Columns that identify, leak what was delivered, or are outcomes.
IDENTIFIERS = ("pid", "course", "start", "end", "fx", "dose", "duration", "mrn", "dob", "brachy", "tbi")
OUTCOMES = ("admit", "ed", "adm_ed")

# Limits of the near-zero-variance rule.
FREQUENCY_CUT, UNIQUE_CUT = 95 / 5, 10.0

# Sub-chapters that define the strata, the metastatic one first.
STRATUM_FEATURES = (
    "coursesub_Secondary malignant neoplasm of other and unspecified sites",
    "coursesub_Malignant Neoplasms Of Respiratory And Intrathoracic Organs",
    "coursesub_Malignant Neoplasms Of Digestive Organs",
    "coursesub_Malignant Neoplasms Of Lip, Oral Cavity And Pharynx",
    "coursesub_Malignant Neoplasms Of Breast",
    "coursesub_Malignant Neoplasms Of Female Genital Organs",
)

# Families that describe treatment and disease only, for the control model.
DISEASE_FAMILIES = ("coursedx", "coursesub", "recagent", "conagent", "recclass", "conclass")


def model_columns(courses: DataFrame) -> DataFrame:
    """Keys, predictors and outcome only."""
    keep = set(KEYS) | {"adm_ed"}
    return courses.drop(*[c for c in (*IDENTIFIERS, *OUTCOMES) if c not in keep])


def by_pattern(df: DataFrame, contains: str, drop: bool = True) -> DataFrame:
    """Drop (or keep only) the columns whose name holds ``contains``."""
    return df.select(*[c for c in df.columns if (contains in c) != drop])


def of_families(store: DataFrame, families: Iterable[str]) -> DataFrame:
    """Rows of the long store that belong to the given families."""
    return store.where(F.col("family").isin(list(families)))


def design_matrix(
    courses: DataFrame,
    numeric: Iterable[str],
    categorical: Iterable[str] = (),
    store: DataFrame | None = None,
    keys: Iterable[str] = KEYS,
    label: str = "adm_ed",
    out: str = "features",
    fit_where: Column | None = None,
    carry: Iterable[str] = (),
):
    """Sparse model matrix: numeric columns, dummy-coded categories, stored presence features.

    No intercept: the first category keeps all its levels, later ones lose their alphabetically
    first. Presence features of a course become one sparse vector; its length is bounded by the
    number of distinct features, never by the number of rows. ``fit_where`` restricts the rows that
    encoders learn their levels from, ``carry`` names columns to keep beside the matrix. Returns
    (matrix, names, model) with ``names`` in vector order.
    """
    keys, numeric, categorical = list(keys), list(numeric), list(categorical)
    rows = courses
    fitted: list = []
    stages: list = []
    inputs, names = list(numeric), list(numeric)
    for position, c in enumerate(categorical):
        indexer = StringIndexer(
            inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetDesc"
        ).fit(courses if fit_where is None else courses.where(fit_where))
        fitted.append(indexer)
        # Descending order leaves the alphabetically first level last; the unseen slot behind it is
        # dropped by the encoder.
        stages.append(OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_o_{c}"))
        levels = len(indexer.labels) - (0 if position == 0 else 1)
        if position > 0 and levels > 0:
            stages.append(VectorSlicer(inputCol=f"_o_{c}", outputCol=f"_d_{c}", indices=list(range(levels))))
        if levels > 0:
            inputs.append(f"_o_{c}" if position == 0 else f"_d_{c}")
            names += [f"{c}{level}" for level in indexer.labels[:levels]]
    if store is not None:
        store = family_safe(store) if FAMILY in store.columns else store
        present = store.groupBy(*keys).agg(F.collect_set(FEATURE).alias("_present"))
        rows = rows.join(present, keys, "left").withColumn(
            "_present", F.coalesce("_present", F.array().cast("array<string>"))
        )
        rows = materialise(rows, "design-rows")  # every fit and the matrix read them
        vocabulary = rows.select(F.explode("_present")).distinct().count()
        stages.append(CountVectorizer(inputCol="_present", outputCol="_flags", binary=True, vocabSize=max(1, vocabulary)))
        inputs.append("_flags")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep"))
    model = Pipeline(stages=[*fitted, *stages]).fit(rows if fit_where is None else rows.where(fit_where))
    if store is not None:
        names += model.stages[-2].vocabulary
    matrix = model.transform(rows).select(*keys, *carry, F.col(label).cast("double").alias("label"), out)
    return matrix, names, model


def near_zero_variance(
    values: DataFrame,
    n_rows: Column | int,
    feature: str = FEATURE,
    value: str = "value",
    frequency_cut: float = FREQUENCY_CUT,
    unique_cut: float = UNIQUE_CUT,
) -> DataFrame:
    """Variance profile per feature of a long (feature, value) table.

    With a family column, features are told apart by (family, feature). Rows a feature does not have
    count as zeros, up to ``n_rows``. ``nzv`` marks features that are
    constant, or whose top value outnumbers the runner-up by more than ``frequency_cut`` while at
    most ``unique_cut`` percent of the rows hold distinct values.
    """
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    key = [FAMILY, feature] if FAMILY in values.columns else [feature]
    counted = values.groupBy(*key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    # Zeros, stored or implied, are one value: fold them into a single count per feature.
    absent = counted.groupBy(*key).agg((n - F.sum("_n")).alias("_absent"))
    zeros = absent.where(F.col("_absent") > 0).select(
        *key, F.lit(0).cast("double").alias("_v"), F.col("_absent").alias("_n")
    )
    complete = counted.withColumn("_v", F.col("_v").cast("double")).unionByName(zeros)
    complete = complete.groupBy(*key, "_v").agg(F.sum("_n").alias("_n"))
    top = complete.groupBy(*key).agg(
        F.max(F.struct("_n", "_v")).alias("_top"), F.count(F.lit(1)).alias("n_unique")
    )
    second = (
        complete.join(top, key)
        .where(~F.col("_v").eqNullSafe(F.col("_top._v")))
        .groupBy(*key)
        .agg(F.max("_n").alias("_second"))
    )
    ratio = F.coalesce(F.col("_top._n") / F.col("_second"), F.lit(0.0))
    percent = F.lit(100.0) * F.col("n_unique") / n
    return top.join(second, key, "left").select(
        *key,
        "n_unique",
        ratio.alias("freq_ratio"),
        percent.alias("percent_unique"),
        ((F.col("n_unique") == 1) | ((ratio > frequency_cut) & (percent <= unique_cut))).alias("nzv"),
    )


def numeric_long(df: DataFrame, columns: Iterable[str], keys: Iterable[str] = KEYS) -> DataFrame:
    """Numeric columns as (keys, feature, value) rows."""
    columns = list(columns)
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keys), columns, FEATURE, "value")


def drop_near_constant(store: DataFrame, profile: DataFrame) -> DataFrame:
    """Store without the features marked by ``near_zero_variance``."""
    key = [c for c in (FAMILY, FEATURE) if c in profile.columns]
    return store.join(profile.where("nzv").select(*key), key, "left_anti")


def stratum_key(flags: Iterable[str], outcome: str) -> Column:
    """Stratum text from disease flags (the first is metastatic) and the outcome.

    A metastatic course loses its primary sites; a course with several flags left gets 2 in all.
    """
    first, *others = list(flags)
    metastatic = F.col(first) == 1
    cleared = [F.col(first)] + [F.when(metastatic, 0).otherwise(F.col(c)) for c in others]
    several = reduce(lambda a, b: a + b, cleared) > 1
    final = [F.when(several, 2).otherwise(c).cast("int") for c in cleared]
    return F.concat_ws(" ", *[c.cast("string") for c in final], F.col(outcome).cast("string"))


def train_test_split(
    df: DataFrame, keys: Iterable[str], stratum: str, fraction: float = 0.75, seed: int = 220
) -> tuple[DataFrame, DataFrame]:
    marked = hash_split(df, keys, stratum, fraction, seed)
    return marked.where("is_train").drop("is_train"), marked.where(~F.col("is_train")).drop("is_train")
