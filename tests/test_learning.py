import inspect
import math
import random

import pytest
from conftest import rows
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from coursemill.learning import evaluate, models, prepare, sparse, trees


def test_model_columns_and_patterns(spark):
    df = spark.createDataFrame([(1, "c", 1, 0, 1, 5.0, 2.0)], "pid int, course string, admit int, ed int, adm_ed int, dose double, age double")
    assert prepare.model_columns(df).columns == ["pid", "course", "adm_ed", "age"]
    log = spark.createDataFrame([(1, 0.5, 0.1)], "iter int, auc_mean double, auc_std double")
    assert prepare.by_pattern(log, "std").columns == ["iter", "auc_mean"]
    assert prepare.by_pattern(log, "std", drop=False).columns == ["auc_std"]


def test_near_zero_variance_with_implied_zeros(spark):
    data = [("rare", 1.0)] * 4 + [("edge", 1.0)] * 5 + [("common", 1.0)] * 40 + [("always", 1.0)] * 100
    data += [("spread", float(i)) for i in range(100)] + [("stored0", 0.0)] * 30 + [("stored0", 2.0)] * 2
    df = spark.createDataFrame(data, "feature string, value double")
    got = {r.feature: r for r in prepare.near_zero_variance(df, 100).collect()}
    assert {k: r.nzv for k, r in got.items()} == {
        "rare": True, "edge": False, "common": False, "always": True, "spread": False, "stored0": True,
    }
    assert got["rare"].freq_ratio == 24 and got["edge"].freq_ratio == 19  # 19 is not above the limit
    assert got["always"].n_unique == 1 and got["always"].freq_ratio == 0
    assert got["stored0"].freq_ratio == 49 and got["stored0"].n_unique == 2
    kept = prepare.drop_near_constant(df, prepare.near_zero_variance(df, 100))
    assert {r.feature for r in kept.select("feature").distinct().collect()} == {"edge", "common", "spread"}


def test_near_zero_variance_by_family(spark):
    data = [("recclass", "x", 1.0)] * 5 + [("recmed", "x", 1.0)] * 10
    profile = prepare.near_zero_variance(spark.createDataFrame(data, "family string, feature string, value double"), 12)
    got = {r.family: (r.n_unique, r.nzv) for r in profile.collect()}
    assert got == {"recclass": (2, False), "recmed": (2, False)}


def test_split_keeps_rows_without_stratum(spark):
    df = spark.range(20).selectExpr("id", "if(id < 10, 'a', null) as s")
    train, test = prepare.train_test_split(df, ["id"], "s")
    assert train.where("s IS NULL").count() == 8 and train.count() + test.count() == 20


def test_matrix_holds_all_features_of_all_families(spark):
    df = spark.createDataFrame([(1, "a", 1.5, 1), (2, "b", 2.5, 0)], "pid int, course string, age double, adm_ed int")
    store = spark.createDataFrame([(1, "a", "recclass", "x", 1.0), (2, "b", "recmed", "x", 1.0)], "pid int, course string, family string, feature string, value double")
    _, names, _ = prepare.design_matrix(df, ["age"], [], store)
    assert sorted(names) == ["age", "x.recclass", "x.recmed"]


def test_stratum_key(spark):
    df = spark.createDataFrame([(1, 1, 1, 0), (0, 1, 1, 1), (0, 0, 1, 0), (0, 0, 0, 1)], "m int, a int, b int, y int")
    assert [r[0] for r in df.select(prepare.stratum_key(["m", "a", "b"], "y")).collect()] == ["1 0 0 0", "2 2 2 1", "0 0 1 0", "0 0 0 1"]


def test_design_matrix_dummy_coding(spark):
    df = spark.createDataFrame([(1, "a", 1.5, "x", "u", 1), (2, "b", 2.5, "y", "v", 0), (3, "c", 0.0, "z", "v", 1)], "pid int, course string, age double, f string, g string, adm_ed int")
    store = spark.createDataFrame([(1, "a", "lab", "ALB", 1.0), (2, "b", "lab", "ALB", 1.0), (2, "b", "lab", "K", 1.0)], "pid int, course string, family string, feature string, value double")
    matrix, names, _ = prepare.design_matrix(df, ["age"], ["f", "g"], store)
    assert sorted(names) == ["ALB", "K", "age", "fx", "fy", "fz", "gv"]
    got = {r.course: dict(zip(names, r.features.toArray())) for r in matrix.collect()}
    assert got["a"] == {"age": 1.5, "fx": 1, "fy": 0, "fz": 0, "gv": 0, "ALB": 1, "K": 0}
    assert got["b"] == {"age": 2.5, "fx": 0, "fy": 1, "fz": 0, "gv": 1, "ALB": 1, "K": 1}
    assert got["c"] == {"age": 0.0, "fx": 0, "fy": 0, "fz": 1, "gv": 1, "ALB": 0, "K": 0}


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        x = [rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)]
        y = float(rng.random() < 1 / (1 + math.exp(-(2.5 * x[0] - 0.5))))
        data.append((i, f"c{i}", y, Vectors.dense(x)))
    return spark.createDataFrame(data, ["pid", "course", "label", "features"]).coalesce(2).cache()


NAMES = ["signal", "noise1", "noise2"]


def _auc(scores):
    return evaluate.auc(scores).first().auc


def test_forest_importances_and_out_of_fold(spark, matrix):
    model = models.forest(10, depth=4).fit(matrix)
    gini = {r.feature: r.importance for r in models.gini_importance(spark, model, NAMES).collect()}
    assert max(gini, key=gini.get) == "signal"
    permuted = {r.feature: r.importance for r in models.permutation_importance(model, matrix, NAMES, [0, 1, 2]).collect()}
    assert max(permuted, key=permuted.get) == "signal" and permuted["signal"] > 0.1
    held = models.out_of_fold(models.forest(5, depth=3), matrix, folds=2)
    assert held.select("pid").distinct().count() == held.count() == 400
    assert 0.7 < _auc(held) < 1


def test_lasso_takes_the_largest_penalty_within_one_error(spark, matrix):
    path = models.penalty_path(matrix, steps=4, ratio=0.01)
    assert path == sorted(path, reverse=True) and path[-1] == pytest.approx(path[0] * 0.01)
    sparse_rows = sparse.from_vectors(matrix)
    model = models.lasso_path(sparse_rows, 3, path, folds=3)
    log = model.table.collect()
    best = max(log, key=lambda r: r.auc)
    assert model.penalty == max(r.penalty for r in log if r.auc >= best.auc - best.se)
    assert [r.penalty for r in log if r.chosen] == [model.penalty]
    kept = {r.feature for r in models.coefficient_table(spark, model, NAMES).collect()}
    assert kept >= {"(Intercept)", "signal"}
    # At the start of the path nothing is left, at its end the fit is MLlib's.
    from pyspark.ml.classification import LogisticRegression

    empty = LogisticRegression(elasticNetParam=1.0, regParam=path[0] * 1.01).fit(matrix)
    assert rows(models.coefficient_table(spark, empty, NAMES), "feature") == [("(Intercept)",)]
    same = LogisticRegression(elasticNetParam=1.0, regParam=path[-1], tol=1e-10).fit(matrix)
    assert model.path.coefficients[-1, 0] == pytest.approx(same.coefficients.toArray(), abs=2e-3)
    assert _auc(model.score(sparse_rows)) == pytest.approx(_auc(models.score(same, matrix)), abs=0.02)


def test_fourier_features_approximate_the_kernel(spark):
    points = [[0.1, 0.4], [0.5, -0.2], [1.0, 1.0]]
    df = spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(points)], ["i", "features"])
    lifted = [r.fourier.toArray() for r in models.fourier_features(df, 2, 1000, gamma=0.7).orderBy("i").collect()]
    for a in range(3):
        for b in range(3):
            exact = math.exp(-0.7 * sum((x - y) ** 2 for x, y in zip(points[a], points[b])))
            assert float(lifted[a] @ lifted[b]) == pytest.approx(exact, abs=0.1)


def test_kernel_machine_gives_probabilities(matrix):
    scores = models.KernelMachine(dimensions=16, max_iter=5, platt_folds=2).fit(matrix).score(matrix)
    assert scores.where("score < 0 or score > 1").count() == 0
    assert _auc(scores) > 0.75


def test_boosting_scores_by_iteration(matrix):
    model = models.boosted_trees(rounds=5, rate=0.3, depth=2, columns=1.0).fit(matrix)
    last = models.scores_by_iteration(model, matrix, at=[2, 5]).where("iter = 5")
    assert sorted(round(r.score, 9) for r in last.collect()) == sorted(round(r.score, 9) for r in models.score(model, matrix).collect())


def test_kernel_fits_run_together_only_while_their_rows_fit(matrix, monkeypatch):
    machine, plain, used = models.KernelMachine(dimensions=8, max_iter=3), models.ThreadPool, []
    assert [models.KernelMachine().at_once(n, 4) for n in (0, 65_000, 100_000, 10**7)] == [4, 4, 2, 1]
    monkeypatch.setattr(models, "ThreadPool", lambda n: used.append(n) or plain(n))
    few = machine.fit(matrix).score(matrix)
    monkeypatch.setattr(models, "FITS_BYTES", 1)
    many = models.KernelMachine(dimensions=8, max_iter=3).fit(matrix).score(matrix)
    assert used == [4, 1]
    assert [round(r.score, 6) for r in few.orderBy("pid").collect()] == [round(r.score, 6) for r in many.orderBy("pid").collect()]


def test_grid_query_searches_the_whole_grid(monkeypatch):
    from types import SimpleNamespace

    from coursemill.workload import learners

    asked = inspect.signature(models.grid_search)
    monkeypatch.setattr(learners, "_data", lambda spark, sf: SimpleNamespace(train_vectors="rows"))
    monkeypatch.setattr(models, "grid_search", lambda *a, **k: asked.bind(*a, **k))
    call = learners.gbt_grid(None, "")
    call.apply_defaults()
    got = call.arguments
    assert got["df"] == "rows" and (got["rounds"], got["rate"], got["folds"]) == (1000, 0.01, 5)
    assert (tuple(got["subsample"]), tuple(got["columns"]), tuple(got["depth"])) == ((0.5, 0.75, 1.0), (0.4, 0.6, 0.8, 1.0), (4, 6, 8, 10))


def test_learning_curve_grid_and_reports(spark, matrix):
    log = models.learning_curve(matrix, models.boosted_trees(rounds=3, rate=0.3, depth=2, columns=1.0), folds=2, at=[1, 3])
    log = spark.createDataFrame(log.collect(), log.schema)
    assert sorted(r.iter for r in log.collect()) == [1, 3]
    long = models.curve_long(log)
    assert {r.part for r in long.collect()} == {"train_auc_mean", "test_auc_mean"} and long.count() == 4
    assert models.last_iteration(log).first().iter == 3
    grid = models.grid_search(matrix, subsample=(1.0,), columns=(0.4, 1.0), depth=(2,), rounds=2, folds=2)
    assert {(r.subsample, r["columns"], r.depth) for r in grid.collect()} == {(1.0, 0.4, 2), (1.0, 1.0, 2)}
    importance = spark.createDataFrame([("age", 0.5), ("x", 0.3), ("lasted", 0.2)], "feature string, importance double")
    top = models.top_importance(importance, 2).collect()
    assert [(r.label, r.data_type) for r in top] == [("Age", "Patient characteristics"), ("x", None)]


def test_early_stopping_is_optional(matrix):
    marked = matrix.withColumn("held", F.col("pid") % 4 == 0)
    model = models.boosted_trees(rounds=6, rate=0.5, depth=2, early_stop_flag="held").fit(marked)
    assert 1 <= len(model.trees) <= 6


def test_sparse_design_equals_the_dense_one(spark):
    schema = "pid int, course string, age double, f string, g string, adm_ed int"
    df = spark.createDataFrame([(1, "a", 1.5, "x", "u", 1), (2, "b", 2.5, "y", "v", 0), (3, "c", 0.0, "z", "v", 1), (4, "d", None, None, "w", 0)], schema)
    stored = [(1, "a", "lab", "ALB", 1.0), (2, "b", "lab", "ALB", 1.0), (2, "b", "lab", "K", 1.0), (9, "z", "lab", "age", 1.0)]
    store = spark.createDataFrame(stored, "pid int, course string, family string, feature string, value double")
    design = sparse.sparse_design(df, ["age"], ["f", "g"], store, fit_where=F.col("pid") < 4, carry=["f"])
    names = {r.position: (r.kind, r.name) for r in design.names.collect()}
    assert sorted(n for _, n in names.values()) == ["ALB", "K", "age", "age", "fx", "fy", "fz", "gv"]
    assert sorted(names) == list(range(8)) and design.width == 8 and len(design.named()) == 8
    got = {r.course: {names[i][1]: v for i, v in zip(r.indices, r["values"])} for r in design.rows.collect()}
    assert got == {"a": {"age": 1.5, "fx": 1, "ALB": 1}, "b": {"age": 2.5, "fy": 1, "gv": 1, "ALB": 1, "K": 1}, "c": {"fz": 1, "gv": 1}, "d": {}}
    vectors = {r.course: r.features for r in sparse.with_vectors(design.rows, design.width).collect()}
    assert all(vectors[c].numNonzeros() == len(got[c]) for c in got)
    plan = design.rows._jdf.queryExecution().executedPlan().toString()
    assert "CountVectorizer" not in plan and "Python" not in plan


def test_rows_and_vectors_are_written_once(spark, monkeypatch):
    from types import SimpleNamespace

    from coursemill.workload import learners

    df = spark.createDataFrame([(1, "a", True, 1.0, [0, 2], [1.5, 1.0]), (2, None, False, 0.0, [], [])], "pid int, course string, is_train boolean, label double, indices array<int>, values array<double>")
    monkeypatch.setattr(sparse, "sparse_design", lambda *a, **k: SimpleNamespace(rows=df, width=4, named=list))
    data = learners._matrix(None, None, (), (), "both")
    assert data.train.inputFiles() == data.train_vectors.inputFiles()
    plan = data.train_vectors._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and rows(data.train) == [(1, "a", 1.0, [0, 2], [1.5, 1.0])] and rows(data.test) == [(2, None, 0.0, [], [])]
    both = data.train_vectors.unionByName(data.test_vectors)
    assert rows(both) == rows(sparse.with_vectors(df.drop("is_train"), 4)) and both.columns == ["pid", "course", "label", "features"]
    with pytest.raises(Exception, match="a column twice"):
        sparse.written_both(spark.createDataFrame([(1, [2, 2], [1.0, 1.0])], "pid int, indices array<int>, values array<double>"), 4, "twice")


def test_projection_is_the_laid_out_matrix():
    import numpy as np

    projection = sparse.Projection(5, 20, 3)
    matrix = projection.of(np.eye(5))
    x = np.random.default_rng(1).normal(size=(7, 5))
    assert projection.of(x) == pytest.approx(x @ matrix)
    wide = sparse.Projection(6, 4000, 1).of(np.eye(6))
    assert np.cov(wide) == pytest.approx(np.eye(6), abs=0.15)  # standard normal entries


def test_sparse_rows_are_centred_and_scaled_in_the_projection(spark):
    import numpy as np

    rng = random.Random(2)
    data = [(i, [j for j in range(6) if (i + j) % 3], [rng.gauss(5, 2) for j in range(6) if (i + j) % 3]) for i in range(30)]
    df = spark.createDataFrame(data, "i int, indices array<int>, values array<double>")
    mean, deviation = sparse.column_moments(df, 6)
    x = np.zeros((30, 6))
    for i, at, values in data:
        x[i, at] = values
    assert mean == pytest.approx(x.mean(0)) and deviation == pytest.approx(x.std(0, ddof=1))
    lifted = sparse.fourier_rows(df, 6, 16, 0.3, 4, deviation, mean)
    projection = sparse.Projection(6, 16, 4)
    want = np.cos(projection.of((x - mean) / deviation) * math.sqrt(0.6) + projection.shifts) * math.sqrt(2 / 16)
    assert [r.fourier for r in lifted.orderBy("i").collect()] == [pytest.approx(w) for w in want]


def test_permuted_losses_equal_dense_rescoring(spark, matrix):
    from pyspark.ml.functions import vector_to_array

    from coursemill.operators.ranking import shuffled_rank

    model = models.forest(8, depth=4).fit(matrix)
    got = {r.position: r.lost for r in trees.permuted_losses(trees.forest_nodes(spark, [model]), sparse.from_vectors(matrix), 3).collect()}
    plain = matrix.withColumn("x", vector_to_array("features"))
    own = shuffled_rank(plain, ["pid", "course"], 220, "r").collect()
    donor = {r.r: r.x for r in shuffled_rank(plain, ["pid", "course"], 221, "r").collect()}
    right = {r.pid: r.prediction == r.label for r in model.transform(matrix).collect()}
    for j in range(3):
        swapped = [(r.pid, r.course, r.label, Vectors.dense([donor[r.r][k] if k == j else v for k, v in enumerate(r.x)])) for r in own]
        again = model.transform(spark.createDataFrame(swapped, ["pid", "course", "label", "features"])).collect()
        assert got.get(j, 0) == sum(right.values()) - sum(r.prediction == r.label for r in again)
    forest = trees.BaggedForest(trees=6, bags=3, depth=3).fit(matrix)
    importance = {r.feature: r.importance for r in models.permutation_importance(forest, matrix, NAMES).collect()}
    assert max(importance, key=importance.get) == "signal"
    gini = {r.feature: r.importance for r in models.gini_importance(spark, forest, NAMES).collect()}
    assert max(gini, key=gini.get) == "signal"


def test_kernel_machine_fits_go_side_by_side(spark, matrix, monkeypatch):
    from threading import Barrier

    plain, together = models.LinearSVC.fit, Barrier(4)

    def fit(self, *args):
        together.wait(60)  # three folds and all rows
        return plain(self, *args)

    monkeypatch.setattr(models.LinearSVC, "fit", fit)
    machine = models.KernelMachine(dimensions=8, max_iter=3).fit(matrix)
    assert machine.score(matrix).count() == matrix.count()
