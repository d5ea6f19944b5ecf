import math
import random

import numpy as np
import pytest

from coursemill.llm import hardnegatives
from coursemill.llm.hardnegatives import hard_negatives, planes_of, scores, subset_sums, values_of

SCHEMA = "vec_id long, label int, embedding array<float>, score int, `a.b` string"


def brute(rows, every, positives=5, negatives=10):
    """Every score of every anchor, in plain Python."""
    fit = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        fit.append((i, label, [max(-(1 << 24), min(1 << 24, math.floor(256 * float(np.float32(x))))) for x in vector]))
    out = []
    anchors = {(i, label, tuple(v)) for i, label, v in fit if i % every == 0}
    for i, label, v in anchors:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in fit if j != i)
        for p, (less, j, _) in enumerate([s for s in scored if s[2] == label][:positives]):
            found = [s for s in scored if s[2] != label and 30 * -less <= 100 * -s[0] <= 90 * -less][:negatives]
            out += [(i, j, r + 1, s[1], -less, -s[0]) for r, s in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def random_rows(rng, n, dimensions, labels=4):
    centres = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels) if rng.random() < 0.6 else 0  # a hot one
        centre = centres[label if rng.random() < 0.7 else rng.randrange(labels)]
        rows.append((i, label, [c + rng.gauss(0, 0.7) for c in centre]))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_all_scores(spark, monkeypatch, small):
    if small:  # several blocks of rows and of anchors, within labels too
        monkeypatch.setattr(hardnegatives, "LEAST_ROWS", 40)
        monkeypatch.setattr(hardnegatives, "ANCHORS", 7)
        monkeypatch.setattr(hardnegatives, "TABLES", 3)
        monkeypatch.setattr(hardnegatives, "SLICE", 16)
    rows = random_rows(random.Random(4), 400, 11)
    rows += [(400 + i, 1, rows[7][2]) for i in range(30)] + [(500, 2, rows[7][2]), (501, 9, [0.0] * 11)]  # ties
    rows += [(None, 1, [1.0] * 11), (600, None, [1.0] * 11), (610, 1, None), (620, 1, [1.0, None] + [0.0] * 9)]
    rows += [(630, 1, [float("nan")] * 11), (640, 1, [float("inf")] * 11), (650, 3, []), (660, 2, [2.0, -1.0]), (670, 1, [9.0] * 13)]
    got = hard_negatives(frame(spark, rows), "vec_id % 10 = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == brute(rows, 10) and len(found) > 500


def test_repeated_rows_and_ids(spark):
    rows = random_rows(random.Random(6), 60, 5)
    rows += [rows[10], rows[10], rows[21], (20, 1, [0.5, 0.1, 0.9, 0.3, -0.2])]  # equal anchors, equal candidates, one id twice
    assert sorted(tuple(r) for r in hard_negatives(frame(spark, rows), "vec_id % 10 = 0").collect()) == brute(rows, 10)


def test_extreme_components_and_text_labels(spark):
    rows = [(i, f"label {i % 2}", [3e38 if i % 3 else -1e9, 70000.0 * i, 0.001]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = sorted(tuple(r) for r in hard_negatives(df, "vec_id % 10 = 0").collect())
    assert got == brute([(i, lab, [np.float64(x) if abs(x) < 1e38 else 1e30 for x in v]) for i, lab, v in rows], 10)


@pytest.mark.parametrize("rows", [[], [(1, 0, [1.0, 2.0])], [(10, 0, [1.0, 2.0]), (3, 1, [1.0, 2.0])], [(10, None, None)]])
def test_nothing_to_find(spark, rows):
    assert hard_negatives(frame(spark, rows), "vec_id % 10 = 0").count() == 0


@pytest.mark.parametrize("bits", [1, 2, 9, 26])
def test_lookups_are_exact(bits):
    rng = np.random.default_rng(bits)
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    a, b = (rng.integers(low, high, (n, 19), endpoint=True) for n in (13, 50))
    planes = planes_of(b, bits)
    assert (values_of(planes)[:, :19] == b).all()
    tables = subset_sums(values_of(planes_of(a, bits)), np.int64)
    assert (scores(tables, planes) == b @ a.T).all()
