import math
import random

from coursemill.llm import pivots


def brute(rows, threshold):
    def usable(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    near = {
        i: {j for j, w, m in rows if i != j and usable(v, k) and usable(w, m) and k == m and len(v) == len(w) and cosine(v, w) >= threshold}
        for i, v, k in rows
    }
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(near[i]), min(seen), i == min(seen))
    return out


def vectors(rng):
    rows = []
    for base in range(25):
        centre = [rng.gauss(0, 1) for _ in range(16)]
        for copy in range(rng.randint(1, 9)):
            noise = rng.choice([0, 0.05, 0.25, 0.4])
            rows.append((base * 20 + copy, [float(x + rng.gauss(0, noise)) if noise else float(x) for x in centre], base % 3))
    rows += [
        (900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1),
        (905, rows[0][1], None), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [], 1), (909, [x * 1e-30 for x in rows[0][1]], rows[0][2]),
    ]
    return rows


def test_links_against_all_pairs(spark):
    rows = vectors(random.Random(6))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, id int, copies int")
    for block in (pivots.BLOCK_ROWS, 4):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df, 0.93, block_rows=block).collect()}
        assert got == brute(rows, 0.93)


def test_repeated_and_unnamed_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (None, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in pivots.near_duplicates(df, 0.93).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)]
    assert pivots.near_duplicates(df.limit(0), 0.93).count() == 0


def test_recall_with_many_pivots(spark):
    """The index itself: many pivots and short prefixes still find nine of ten links at the threshold."""
    rng = random.Random(8)
    rows = []
    for base in range(400):
        centre = [rng.gauss(0, 1) for _ in range(32)]
        rows += [(base * 2, centre, 0), (base * 2 + 1, [x + rng.gauss(0, 0.35) for x in centre], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    expected = brute(rows, 0.93)
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(df, 0.93).collect()}
    wanted = sum(n for n, *_ in expected.values())
    assert wanted > 100 and sum(got.values()) >= 0.95 * wanted
    assert all(got[i] <= expected[i][0] for i in got)
