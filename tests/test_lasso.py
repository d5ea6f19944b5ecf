import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemill.learning import lasso


@pytest.fixture(scope="module")
def data():
    """(rows of (label, indices, values, fold), dense matrix): sparse, with a constant and an empty column, scales apart."""
    rng = random.Random(11)
    rows, dense = [], []
    for i in range(600):
        x = [0.0] * 14
        for j in rng.sample(range(11), rng.randint(0, 5)):
            x[j] = 1.0 if j < 7 else rng.gauss(3, 2) * 10 ** (j - 8)
        x[12] = 1.0  # constant
        logit = 1.5 * x[0] - 2 * x[1] + 0.8 * x[2] + 0.3 * x[8] - 0.7
        y = float(rng.random() < 1 / (1 + math.exp(-logit)))
        rows.append((y, [j for j, v in enumerate(x) if v], [v for v in x if v], i % 4))
        dense.append((y, x, i % 4))
    return rows, dense


def conditions(y, x, intercept, beta, penalty):
    """Largest violation of the optimality conditions, relative to the penalty, in plain numpy."""
    p = 1 / (1 + np.exp(-(x @ beta + intercept)))
    g, s = x.T @ (y - p) / len(y), x.std(0)
    s[s < 1e-9] = 0
    off = np.where(beta != 0, np.abs(g - penalty * s * np.sign(beta)), np.maximum(np.abs(g) - penalty * s, 0))
    return max(np.max(off[s > 0] / s[s > 0]) / penalty, abs((y - p).mean()) / penalty)


def frame(spark, rows):
    return spark.createDataFrame(rows, "label double, indices array<int>, values array<double>, fold int").repartition(3)


def test_every_fit_meets_its_conditions(spark, data, monkeypatch):
    monkeypatch.setattr(lasso, "BLOCK_ROWS", 70)
    rows, dense = data
    path = lasso.fit_path(lasso.packed(frame(spark, rows), 14, 4), lasso.penalties_for(lasso.moments(lasso.packed(frame(spark, rows), 14, 4)), 12))
    y, x, fold = np.array([d[0] for d in dense]), np.array([d[1] for d in dense]), np.array([d[2] for d in dense])
    assert len(path.penalties) == 12 and (np.diff(path.penalties) < 0).all()
    for step, penalty in enumerate(path.penalties):
        for fit in range(5):
            seen = np.ones(len(y), bool) if fit == 0 else fold != fit - 1
            worst = conditions(y[seen], x[seen], path.intercepts[step, fit], path.coefficients[step, fit], penalty)
            assert worst <= 1.01 * lasso.TOLERANCE
    assert np.abs(path.coefficients[0, 0]).max() < 1e-6  # the first penalty leaves nothing
    assert (path.coefficients[-1, 0] != 0).sum() >= 6
    assert path.coefficients[:, :, 11:].any() == False  # noqa: E712 - empty and constant columns
    assert path.passes < 12 * 8


def test_scores_of_held_out_rows(spark, data):
    rows, dense = data
    df = frame(spark, rows)
    path = lasso.fit_path(lasso.packed(df, 14, 4), [0.05, 0.01])
    got = sorted((r.fold, r.step, r.score) for r in lasso.scored(df, path, [0, 1], "fold").collect())
    want = []
    for _, x, fold in dense:
        for step in (0, 1):
            margin = np.dot(x, path.coefficients[step, fold + 1]) + path.intercepts[step, fold + 1]
            want.append((fold, step, 1 / (1 + math.exp(-margin))))
    assert np.allclose(got, sorted(want))


def test_one_class_and_no_columns(spark):
    df = spark.createDataFrame([(1.0, [0], [1.0]), (1.0, [], [])], "label double, indices array<int>, values array<double>")
    path = lasso.fit_path(lasso.packed(df, 3), [0.1])
    assert not path.coefficients.any()


def test_blocks_stay_with_the_executors_during_a_path(spark, data, monkeypatch):
    rows = lasso.packed(frame(spark, data[0]), 14, 4)
    plain, kept = lasso.moments, []
    monkeypatch.setattr(lasso, "moments", lambda r: kept.append(r.blocks.storageLevel.useMemory) or plain(r))
    lasso.fit_path(rows, [0.2])
    assert kept == [True] and not rows.blocks.storageLevel.useMemory


def test_few_blocks_are_read_cached_and_handed_on_at_once(spark, data, monkeypatch):
    rows = lasso.packed(frame(spark, data[0]), 14, 4)
    settings = lambda: {spark.conf.get(f"spark.sql.{c}") for c in ("parquet.columnarReaderBatchSize", "inMemoryColumnarStorage.batchSize", "execution.arrow.maxRecordsPerBatch")}
    before, plain, seen = settings(), lasso.moments, []
    monkeypatch.setattr(lasso, "moments", lambda r: seen.append((r.blocks.storageLevel.useMemory, settings())) or plain(r))
    lasso.fit_path(rows, [0.2])
    assert seen == [(True, {"4"})] and settings() == before


def test_rows_of_no_fold_are_in_every_fit(spark, data, monkeypatch):
    monkeypatch.setattr(lasso, "BLOCK_ROWS", 70)
    rows = [(*r[:3], -1 if i % 3 == 0 else r[3]) for i, r in enumerate(data[0])]
    path = lasso.fit_path(lasso.packed(frame(spark, rows), 14, 4), [0.05, 0.01])
    y, x, fold = np.array([r[0] for r in rows]), np.array([d[1] for d in data[1]]), np.array([r[3] for r in rows])
    for fit in range(5):
        seen = (fold != fit - 1) | (fold < 0)
        assert conditions(y[seen], x[seen], path.intercepts[1, fit], path.coefficients[1, fit], 0.01) <= 1.01 * lasso.TOLERANCE


def test_laid_out_blocks_add_up_as_others(monkeypatch):
    cells = {"labels": np.array([1.0, 0, 1]), "folds": np.zeros(3, np.int32), "sizes": np.array([2, 0, 2], np.int32), "values": np.array([2.0, 3, 4, 5])}
    for index in ([0, 3, 1, 3], [0, 3, 1, 1]):  # the second has a cell twice
        packed = {"rows": 3, "indices": np.array(index, np.int32).tobytes(), **{k: v.tobytes() for k, v in cells.items()}}
        weights, columns = np.array([[1.0, 2], [3, 4], [5, 6]]), np.array([1, 3])
        fast = lasso._Block(packed, 5)
        with monkeypatch.context() as m:
            m.setattr(lasso, "LAID_OUT", 0)
            slow = lasso._Block(packed, 5)
        assert (fast.whole is None) == (index[-2:] == [1, 1]) and slow.whole is None
        assert fast.totals(weights).tolist() == slow.totals(weights).tolist() and fast.dense(columns).tolist() == slow.dense(columns).tolist()


def test_sums_of_all_steps_repeat_no_row(spark):
    from coursemill.workload import learners

    rng = np.random.default_rng(8)
    width = len(learners._LASSO_COLUMNS)
    data = rng.normal(size=(50, width)) * 30
    label = rng.integers(0, 2, 50).astype(float)
    lists = [[float(y), *map(float, v)] for y, v in zip(label, data)]
    lists.append([1.0, None, *[2.0] * (width - 1)])  # counts in no sum
    ddl = ", ".join(f"`{c}` double" for c in ("label", *learners._LASSO_COLUMNS))
    steps = [(i, 0.1, float(rng.normal()), [float(b) for b in rng.normal(size=width)]) for i in range(4)]
    found = learners._rest_sums(spark.createDataFrame(lists, ddl).repartition(3), steps)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    sums = {r["step"]: list(r)[1:] for r in found.groupBy("step").agg(*[F.sum(f"`{c}`") for c in found.columns[1:]]).collect()}
    for step, _, intercept, beta in steps:
        with np.errstate(over="ignore"):
            rest = label - 1 / (1 + np.exp(-(data @ np.array(beta) + intercept)))
        assert np.allclose(sums[step], [rest.sum(), *(rest @ data)], rtol=1e-9, atol=1e-9)
