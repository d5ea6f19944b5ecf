"""Classifiers on MLlib with the tuned settings as defaults.

Frames hold the key columns, ``label`` (0.0 / 1.0) and ``features``. Scores are the probability of
label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.learning import lasso, sparse, trees
from coursemill.learning.evaluate import auc
from coursemill.operators.ranking import shuffled_rank, uniform_key
from coursemill.operators.rollups import top_rows
from coursemill.plans.cohort import KEYS
from coursemill.session import checkpoint_ready, materialise

# Tuned settings and the searched grid.
FOREST_TREES = 1000
BOOST_ROUNDS, BOOST_RATE, BOOST_DEPTH, BOOST_SUBSAMPLE, BOOST_COLUMNS = 1000, 0.01, 4, 0.5, 0.4
GRID_SUBSAMPLE, GRID_COLUMNS, GRID_DEPTH = (0.5, 0.75, 1.0), (0.4, 0.6, 0.8, 1.0), (4, 6, 8, 10)
CLASS_WEIGHTS = {0: 0.1, 1: 0.9}
FOREST_SEED, MODEL_SEED = 220, 313
FOLDS = 5

#: Bytes of projected rows that fits of the kernel machine, each with its own, may keep in the executors' memory together.
FITS_BYTES = 1 << 30

# Reading names and data types of the leading predictors.
FEATURE_LABELS = {
    "plannedfx": ("Planned number of radiation fractions", "Treatment/disease"),
    "planneddose": ("Planned total radiation dose", "Treatment/disease"),
    "lasted": ("Time since most recent ED visit", "Pre-treatment encounters"),
    "weightloss": ("Weight loss", "Pre-treatment vitals"),
    "age": ("Age", "Patient characteristics"),
    "srssbrt": ("Stereotactic radiosurgery or\nstereotactic body radiation therapy", "Treatment/disease"),
    "numyeared": ("Number of ED encounters past year", "Pre-treatment encounters"),
    "ALB": ("Abnormal albumin", "Pre-treatment labs"),
    "lastadmit": ("Time since last admission", "Pre-treatment encounters"),
    "daysyearadmit": ("Number of days admitted past year", "Pre-treatment encounters"),
    "con_Antineoplastic Agents": ("Concurrent systemic therapy", "Treatment/disease"),
    "maxpain": ("Pain score 4+", "Pre-treatment vitals"),
}


def score(model: Model, df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """``(keys, label, score)``."""
    return model.transform(df).select(*keys, "label", vector_to_array("probability")[1].alias("score"))


def stratified_folds(df: DataFrame, keys: Iterable[str], stratum: str, folds: int = FOLDS, seed: int = FOREST_SEED) -> DataFrame:
    """Adds ``fold``: rows of each stratum are dealt to the folds in turn, in repeatable random order."""
    ranked = shuffled_rank(df, keys, seed, "_rank", [stratum])
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_rank")


def with_folds(df: DataFrame, keys: Iterable[str] = KEYS, folds: int = FOLDS, seed: int = FOREST_SEED) -> DataFrame:
    """Repeatable fold number per row, from a hash of its key."""
    digits = F.conv(F.substring(uniform_key(keys, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (digits % folds).cast("int"))


def out_of_fold(estimator, df: DataFrame, keys: Iterable[str] = KEYS, folds: int = FOLDS, seed: int = FOREST_SEED) -> DataFrame:
    """Scores of every row by a model that did not see its fold."""
    marked = with_folds(df, keys, folds, seed)
    parts = [
        score(estimator.fit(marked.where(F.col("fold") != k)), marked.where(F.col("fold") == k), keys)
        for k in range(folds)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- random forest ----------------------------------------------------------------------------


def forest(trees: int = FOREST_TREES, depth: int = 10, seed: int = FOREST_SEED, **params) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, checkpointInterval=10, **params
    )


def gini_importance(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """Importance by impurity (gain) per feature; as many rows as features."""
    values = model.gini_importance() if isinstance(model, trees.BaggedForest) else model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importance(
    model, df: DataFrame, names: Sequence[str], positions: Sequence[int] | None = None, keys: Iterable[str] = KEYS, seed: int = FOREST_SEED
) -> DataFrame:
    """Accuracy lost when one feature's values are exchanged between rows; all features by default.

    ``model`` is a fitted forest or ``trees.BaggedForest``; ``df`` has sparse rows (``indices``, ``values``) or ``features``
    vectors. See ``trees.permuted_losses``.
    """
    rows = df if "indices" in df.columns else sparse.from_vectors(df)
    spark = df.sparkSession
    nodes = model.nodes(spark) if isinstance(model, trees.BaggedForest) else trees.forest_nodes(spark, [model])
    changes = trees.permuted_losses(nodes, rows, len(names), keys, seed)
    positions = list(range(len(names))) if positions is None else list(positions)
    n = df.agg(F.count(F.lit(1))).scalar()
    listed = spark.createDataFrame([(p, names[p]) for p in positions], "position int, feature string")
    return listed.join(changes, "position", "left").select("feature", (F.coalesce("lost", F.lit(0)) / n).alias("importance"))


# --- L1 logistic regression -------------------------------------------------------------------


def penalty_path(df: DataFrame, steps: int = 100, ratio: float = 1e-3) -> list[float]:
    """Penalties from the smallest that zeroes every coefficient down to ``ratio`` times that.

    One distributed pass for per-class feature means; the driver sees one row per class.
    """
    stats = df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("features")).alias("mean")
    ).collect()
    total = df.select(Summarizer.std(F.col("features")).alias("std")).first()["std"].toArray()
    by_label = {r["label"]: r for r in stats}
    n = sum(r["n"] for r in stats)
    share = by_label[1.0]["n"] / n
    gap = by_label[1.0]["mean"].toArray() - by_label[0.0]["mean"].toArray()
    largest = float(max(share * (1 - share) * abs(g) / s for g, s in zip(gap, total) if s > 0))
    return [largest * ratio ** (i / (steps - 1)) for i in range(steps)] if steps > 1 else [largest]


@dataclass(frozen=True)
class Lasso:
    """A cross-validated path: fits at every penalty, the mean AUC of held-out folds, and the step that was chosen."""

    path: lasso.Path
    table: DataFrame  # step, penalty, auc, se, chosen
    chosen: int

    @property
    def penalty(self) -> float:
        return float(self.path.penalties[self.chosen])

    @property
    def intercept(self) -> float:
        return float(self.path.intercepts[self.chosen, 0])

    @property
    def coefficients(self) -> np.ndarray:
        return self.path.coefficients[self.chosen, 0]

    def score(self, df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
        """(keys, label, score) of sparse rows."""
        return lasso.scored(df, self.path, [self.chosen], keys=list(keys)).select(*keys, "label", "score")


def lasso_path(
    df: DataFrame,
    width: int,
    penalties: Sequence[float] | None = None,
    steps: int = 100,
    ratio: float = 0.05,
    folds: int = 10,
    keys: Iterable[str] = KEYS,
    seed: int = FOREST_SEED,
) -> Lasso:
    """Cross-validated L1 path over sparse rows (``label``, ``indices``, ``values``); see ``learning.lasso``.

    All folds, dealt within each label, go down the path together with the fit to all rows. The chosen penalty is the
    largest whose mean AUC lies within one standard error of the best.
    """
    folded = materialise(stratified_folds(df, keys, "label", folds, seed), "lasso-folds")
    rows = lasso.packed(folded, width, folds)
    if penalties is None:
        penalties = lasso.penalties_for(lasso.moments(rows), steps, ratio)
    path = lasso.fit_path(rows, penalties)
    held = materialise(lasso.scored(folded, path, range(len(path.penalties)), "fold", list(keys)).select("label", "fold", "step", "score"), "lasso-held")
    per_fold = auc(held, groups=["fold", "step"]).groupBy("step").agg(
        F.avg("auc").alias("auc"), (F.stddev_samp("auc") / math.sqrt(folds)).alias("se")
    )
    log = {r["step"]: (r["auc"], r["se"] or 0.0) for r in per_fold.collect()}
    best = max(log, key=lambda i: log[i][0])
    chosen = min(i for i in log if log[i][0] >= log[best][0] - log[best][1])
    table = df.sparkSession.createDataFrame(
        [(i, float(path.penalties[i]), *log[i], i == chosen) for i in sorted(log)], "step int, penalty double, auc double, se double, chosen boolean"
    )
    return Lasso(path, table, chosen)


def coefficient_table(spark: SparkSession, model, names: Sequence[str], nonzero: bool = True) -> DataFrame:
    rows = [("(Intercept)", float(model.intercept))]
    values = model.coefficients if isinstance(model.coefficients, np.ndarray) else model.coefficients.toArray()
    rows += [(n, float(c)) for n, c in zip(names, values) if c != 0 or not nonzero]
    return spark.createDataFrame(rows, "feature string, coefficient double")


# --- support vector machine -------------------------------------------------------------------


def fourier_features(df: DataFrame, width: int, dimensions: int, gamma: float | None = None, seed: int = MODEL_SEED, source: str = "features", out: str = "fourier") -> DataFrame:
    """Random Fourier features: inner products approximate the kernel exp(-gamma |x - y|^2). ``width`` is the input length."""
    gamma = gamma if gamma is not None else 1.0 / width
    lifted = sparse.fourier_rows(sparse.from_vectors(df, source), width, dimensions, gamma, seed, out=out)
    return lifted.withColumn(out, array_to_vector(out))


class KernelMachine:
    """Class-weighted linear SVM on scaled random Fourier features with a logistic (Platt) link.

    Takes sparse rows (``indices``, ``values`` and their ``width``), or ``features`` vectors, which become such.
    Columns are centred and scaled inside the projection, so no row is laid out before it.
    """

    def __init__(self, dimensions: int = 512, gamma: float | None = None, weights: dict[int, float] | None = None, max_iter: int = 50, seed: int = MODEL_SEED, platt_folds: int = 3):
        self.dimensions, self.gamma, self.seed = dimensions, gamma, seed
        self.weights = weights or CLASS_WEIGHTS
        self.max_iter, self.platt_folds = max_iter, platt_folds

    @staticmethod
    def _rows(df: DataFrame) -> DataFrame:
        return df if "indices" in df.columns else sparse.from_vectors(df)

    def _lift(self, rows: DataFrame) -> DataFrame:
        gamma = self.gamma if self.gamma is not None else 1.0 / self.width
        lifted = sparse.fourier_rows(rows, self.width, self.dimensions, gamma, self.seed, self.deviation, self.mean)
        return lifted.withColumn("fourier", array_to_vector("fourier"))

    def _margin(self, machine, lifted: DataFrame) -> DataFrame:
        margin = machine.transform(lifted).withColumn("_margin", vector_to_array("_raw")[1])
        return VectorAssembler(inputCols=["_margin"], outputCol="_m").transform(margin)

    def at_once(self, rows: int, fits: int) -> int:
        """How many of the fits to so many rows run together."""
        return max(1, min(fits, FITS_BYTES // max(1, rows * self.dimensions * 8)))

    def fit(self, df: DataFrame, keys: Iterable[str] = KEYS, width: int | None = None) -> "KernelMachine":
        self.width = width if width is not None else df.select(F.max(F.size(vector_to_array("features")))).first()[0]
        rows = self._rows(df)
        self.mean, self.deviation = sparse.column_moments(rows, self.width)
        weight = F.when(F.col("label") == 1, float(self.weights[1])).otherwise(float(self.weights[0]))
        folded = with_folds(rows, keys, self.platt_folds, self.seed).withColumn("_weight", weight)
        # Read by every fold's fit and scoring: project once.
        lifted = materialise(self._lift(folded.select("label", "_weight", "fold", "indices", "values")), "fourier")
        svc = LinearSVC(
            featuresCol="fourier", weightCol="_weight", rawPredictionCol="_raw", predictionCol="_class", maxIter=self.max_iter
        )
        # The link is fitted on margins of held-out folds. Fits take many short passes and do not depend on each other:
        # they run together as long as their rows stay in memory, or else every pass would read them from disk.
        seen = [lifted, *(lifted.where(F.col("fold") != k) for k in range(self.platt_folds))]
        with ThreadPool(self.at_once(lifted.count(), len(seen))) as pool:
            self.machine, *machines = pool.map(lambda rows: svc.copy().fit(rows), seen)
        held = None
        for k, machine in enumerate(machines):
            part = self._margin(machine, lifted.where(F.col("fold") == k)).select("label", "_m")
            held = part if held is None else held.unionByName(part)
        self.link = LogisticRegression(featuresCol="_m").fit(held)
        return self

    def score(self, df: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
        margins = self._margin(self.machine, self._lift(self._rows(df).select(*keys, "label", "indices", "values")))
        return score(self.link, margins.select(*keys, "label", "_m"), keys)


# --- boosted trees ----------------------------------------------------------------------------


def boosted_trees(
    rounds: int = BOOST_ROUNDS,
    rate: float = BOOST_RATE,
    depth: int = BOOST_DEPTH,
    subsample: float = BOOST_SUBSAMPLE,
    columns: float = BOOST_COLUMNS,
    seed: int = MODEL_SEED,
    early_stop_flag: str | None = None,
    **params,
) -> GBTClassifier:
    """Boosted trees; ``early_stop_flag`` names a boolean column of validation rows to stop on."""
    model = GBTClassifier(
        maxIter=rounds,
        stepSize=rate,
        maxDepth=depth,
        subsamplingRate=subsample,
        featureSubsetStrategy="all" if columns >= 1 else str(columns),
        seed=seed,
        checkpointInterval=10,
        **params,
    )
    return model.setValidationIndicatorCol(early_stop_flag) if early_stop_flag else model


def grid_search(
    df: DataFrame,
    subsample: Sequence[float] = GRID_SUBSAMPLE,
    columns: Sequence[float] = GRID_COLUMNS,
    depth: Sequence[int] = GRID_DEPTH,
    rounds: int = BOOST_ROUNDS,
    rate: float = BOOST_RATE,
    folds: int = FOLDS,
    seed: int = MODEL_SEED,
    parallelism: int = 4,
    keys: Iterable[str] = KEYS,
) -> DataFrame:
    """Cross-validated AUC per setting, one row per grid point; folds are dealt within each label."""
    checkpoint_ready(df.sparkSession)
    folded = materialise(stratified_folds(df, keys, "label", folds, seed), "grid-folds")
    estimator = boosted_trees(rounds, rate, seed=seed)
    strategy = {c: "all" if c >= 1 else str(c) for c in columns}
    grid = (
        ParamGridBuilder()
        .addGrid(estimator.subsamplingRate, list(subsample))
        .addGrid(estimator.featureSubsetStrategy, list(strategy.values()))
        .addGrid(estimator.maxDepth, list(depth))
        .build()
    )
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(numBins=0),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(folded)
    back = {v: k for k, v in strategy.items()}
    rows = [
        (
            float(m),
            float(g[estimator.subsamplingRate]),
            float(back[g[estimator.featureSubsetStrategy]]),
            int(g[estimator.maxDepth]),
        )
        for g, m in zip(grid, search.avgMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "auc double, subsample double, columns double, depth int")


def scores_by_iteration(model, df: DataFrame, at: Iterable[int] | None = None) -> DataFrame:
    """``(label, iter, score)`` after each listed number of rounds.

    One transform finds every tree's leaf; scores are prefix sums over the leaves' values.
    """
    stops = sorted(set(at)) if at is not None else list(range(1, len(model.trees) + 1))
    margins = trees.margins_by_iteration(model, df, stops, ["label"])
    points = margins.select("label", F.posexplode("margins").alias("_i", "_m"))
    number = F.get(F.lit(stops), F.col("_i")).alias("iter")
    return points.select("label", number, (F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col("_m")))).alias("score"))


def learning_curve(
    df: DataFrame,
    estimator: GBTClassifier,
    keys: Iterable[str] = KEYS,
    folds: int = FOLDS,
    at: Iterable[int] | None = None,
    seed: int = FOREST_SEED,
) -> DataFrame:
    """Train and test AUC per iteration: mean and standard deviation over the folds.

    Wide like an evaluation log: ``iter, train_auc_mean, train_auc_std, test_auc_mean, test_auc_std``.
    """
    marked = stratified_folds(df, keys, "label", folds, seed)
    stops = list(at) if at is not None else None
    logs = None
    for k in range(folds):
        model = estimator.fit(marked.where(F.col("fold") != k))
        for part, rows in (("train", F.col("fold") != k), ("test", F.col("fold") == k)):
            curve = scores_by_iteration(model, marked.where(rows), stops).withColumns(
                {"fold": F.lit(k), "part": F.lit(part)}
            )
            logs = curve if logs is None else logs.unionByName(curve)
    per_fold = auc(logs, groups=["part", "fold", "iter"])

    def of(part: str) -> Column:
        return F.when(F.col("part") == part, F.col("auc"))

    return per_fold.groupBy("iter").agg(
        F.avg(of("train")).alias("train_auc_mean"),
        F.stddev_samp(of("train")).alias("train_auc_std"),
        F.avg(of("test")).alias("test_auc_mean"),
        F.stddev_samp(of("test")).alias("test_auc_std"),
    )


def curve_long(log: DataFrame) -> DataFrame:
    """Evaluation log to ``(iter, part, auc)`` without the spread columns."""
    means = log.select(*[c for c in log.columns if "std" not in c])
    return means.unpivot("iter", [c for c in means.columns if c != "iter"], "part", "auc")


def last_iteration(log: DataFrame, metric: str = "test_auc_mean") -> DataFrame:
    return log.agg(F.max("iter").alias("iter"), F.max_by(metric, "iter").alias(metric))


def top_importance(importance: DataFrame, k: int, labels: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The ``k`` leading features with reading names and data types where known."""
    rows = [(f, *v) for f, v in (labels if labels is not None else FEATURE_LABELS).items()]
    named = importance.sparkSession.createDataFrame(rows, "feature string, label string, data_type string")
    return top_rows(
        importance.join(named, "feature", "left").withColumn("label", F.coalesce("label", "feature")),
        "importance",
        k,
        "feature",
    )


__all__ = [
    "KernelMachine", "boosted_trees", "coefficient_table", "curve_long",
    "forest", "fourier_features", "gini_importance", "grid_search", "lasso_path", "last_iteration",
    "learning_curve", "out_of_fold", "penalty_path", "permutation_importance", "score",
    "scores_by_iteration", "top_importance", "with_folds",
]
