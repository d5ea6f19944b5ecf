import random
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from coursemill import operators as op
from coursemill.operators import codes
from coursemill.operators.intervals import dyadic_pieces


def test_remap_merges_old_ids(spark):
    df = spark.createDataFrame([("o1", 1), ("o2", 2), ("n", 3), (None, 4)], "id string, v int")
    changes = spark.createDataFrame([("o1", "n"), ("o2", "n"), ("o2", "n"), (None, "bad")], "old string, new string")
    assert rows(op.remap_ids(df, changes, "id", "old", "new"), "id", "v") == sorted(
        [("n", 1), ("n", 2), ("n", 3), (None, 4)], key=str
    )


def test_attach_surrogate_drops_strangers_and_gaps(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", None)], "mrn string, v int")
    people = spark.createDataFrame([("a", "P1")], "mrn string, pid string")
    assert rows(op.attach_surrogate(df, people, "mrn", "pid"), "pid", "v") == [("P1", 1)]
    assert op.attach_surrogate(df, people, "mrn", "pid", complete_rows=False).count() == 3


def test_members(spark):
    df, m = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    assert rows(op.keep_members(df, m, "k")) == [(2,), (2,)]
    assert rows(op.drop_members(df, m, "k")) == [(1,)]


def test_map_values_is_simultaneous(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string")
    mapping = spark.createDataFrame([("a", "b"), ("b", "a")], "s string, t string")
    assert rows(op.map_values(df, "v", mapping, "s", "t")) == sorted([("b",), ("a",), ("c",), (None,)], key=str)


@pytest.mark.parametrize("width", [1, 7, 64, 5000])
def test_point_in_interval_equals_brute_force(spark, day, width):
    rng = random.Random(width)
    points = [(rng.randint(1, 3), i, day(rng.randint(-400, 400)) if i % 11 else None) for i in range(150)]
    intervals = []
    for i in range(60):
        low = rng.randint(-400, 400)
        intervals.append((rng.randint(1, 3), i, day(low), day(low + rng.randint(-3, 200))))
    p = spark.createDataFrame(points, "k int, p int, at date")
    q = spark.createDataFrame(intervals, "k int, q int, low date, high date")
    got = op.point_in_interval(p, q, ["k"], "at", "low", "high", width)
    want = sorted((a, b) for k, a, t in points for j, b, lo, hi in intervals if k == j and t and lo <= t <= hi)
    assert sorted((r.p, r.q) for r in got.collect()) == want


def test_lookback_edges(spark, one_course, day):
    events = spark.createDataFrame([(1, day(-n)) for n in (-1, 0, 30, 31)], "pid int, at date")
    got = op.lookback_join(one_course, events, ["pid"], "start", "at", 30)
    assert sorted((r.start - r["at"]).days for r in got.collect()) == [0, 30]
    got = op.lookback_join(one_course, events, ["pid"], "start", "at", None, 1)
    assert sorted((r.start - r["at"]).days for r in got.collect()) == [30, 31]


def test_timeline_profile_equals_brute_force(spark, day):
    rng = random.Random(5)
    events = [(rng.randint(1, 2), day(rng.randint(0, 60)), rng.choice([None, 1.0, 2.0, 5.0]), i) for i in range(120)]
    anchors = [(k, day(n)) for k in (1, 2, 3) for n in range(-5, 70, 7)]
    df = spark.createDataFrame(events, "k int, at date, v double, o int")
    daily = op.by_day(
        df, ["k"], "at", n=F.count(F.lit(1)), top=F.max("v"), latest=F.max_by("v", F.when(F.col("v").isNotNull(), F.col("o")))
    )
    got = op.timeline_profile(
        spark.createDataFrame(anchors + anchors, "k int, s date"), daily, ["k"], "s",
        [
            op.Measure("n10", "sum", "n", 10), op.Measure("top", "max", "top"), op.Measure("latest", "last", "latest", 20),
            op.Measure("last_day", "max", "day"), op.Measure("next_day", "min", "day", after=True),
            op.Measure("around", "sum", "n", 3, -4),
        ],
    ).collect()
    assert len(got) == len(anchors)
    for r in got:
        mine = [(d, v, o) for k, d, v, o in events if k == r.k]
        before = [e for e in mine if e[0] <= r.s]
        within = lambda lo, hi: [e for e in mine if lo <= (r.s - e[0]).days <= hi]
        known = sorted((d, o, v) for d, v, o in within(0, 20) if v is not None)
        assert r.n10 == (len(within(0, 10)) or None)
        assert r.top == max((e[1] for e in before if e[1] is not None), default=None)
        assert r.latest == (known[-1][2] if known else None)
        assert r.last_day == max((e[0] for e in before), default=None)
        assert r.next_day == min((e[0] for e in mine if e[0] > r.s), default=None)
        assert r.around == (len(within(-4, 3)) or None)


def test_cumulative_totals_equal_one_window(spark):
    rng = random.Random(1)
    data = [(g, i, rng.randint(0, 5)) for g in "ab" for i in range(300)]
    df = spark.createDataFrame(data, "g string, o int, v int").withColumn("b", F.floor(F.col("o") / 40))
    got = op.cumulative_totals(df, ["g"], "b", [F.col("o")], {"run": "v"}, overall={"run": "total"})
    for r in got.collect():
        assert r.run == sum(v for g, o, v in data if g == r.g and o <= r.o)
        assert r.total == sum(v for g, _, v in data if g == r.g)


def test_hash_split_is_exact_and_repeatable(spark):
    df = spark.range(1001).select("id", F.when(F.col("id") < 700, "big").when(F.col("id") < 1000, "small").otherwise("one").alias("s"))
    a = op.hash_split(df, ["id"], "s")
    counts = {r.s: r.n for r in a.where("is_train").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"big": 525, "small": 225, "one": 1}
    b = op.hash_split(df.repartition(5), ["id"], "s")
    assert rows(a, "id", "is_train") == rows(b, "id", "is_train")
    assert rows(a, "id", "is_train") != rows(op.hash_split(df, ["id"], "s", seed=1), "id", "is_train")


def test_shuffled_rank_is_a_permutation(spark):
    got = op.shuffled_rank(spark.range(500), ["id"], 3, "r")
    assert sorted(r.r for r in got.collect()) == list(range(1, 501))


def test_modal_value_and_first_and_top(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 2), (1, None, 1), (2, "z", 9), (2, "y", 8), (2, "z", 7), (3, None, 1)], "k int, v string, o int")
    assert rows(op.modal_value(df, ["k"], "v")) == [(1, "a"), (2, "z")]
    assert rows(op.first_by_order(df.where("v is not null"), "k", "v", "o")) == [(1, "a"), (2, "z")]
    assert [r.o for r in op.top_rows(df, "o", 2, "v").collect()] == [9, 8]


def test_explode_and_pivot(spark):
    df = spark.createDataFrame([(1, "a ,b ,c ,d ,e"), (2, None), (3, ""), (4, "a")], "k int, l string")
    assert rows(op.longest_list(df, "l", " ,")) == [(5,)]
    assert rows(op.explode_codes(df, "l", " ,", "c", 4)) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (4, "a")]
    long = op.long_features(op.explode_codes(df, "l", " ,", "c"), ["k"], "fam", "x_", "c")
    wide = op.pivot_indicators(long, ["k"])
    assert wide.columns == ["k", "x_a", "x_b", "x_c", "x_d", "x_e"]
    assert rows(wide) == [(1, 1, 1, 1, 1, 1), (4, 1, 0, 0, 0, 0)]
    unnamed = spark.createDataFrame([(1, None)], "k int, c string")
    assert rows(op.long_features(unnamed, ["k"], "f", "rec_", "c")) == [(1, "f", "rec_NA", 1.0)]


CROSSWALK = [("1985", "C7951"), ("1740", "C50019"), ("18500", "C61"), ("2509", "E119"), ("V100", "Z8500")]


def _map(spark, given, **options):
    df = spark.createDataFrame([(c,) for c in given], "code string")
    x = spark.createDataFrame(CROSSWALK, "a string, b string")
    return {r.code: (r.code_final, r.code_mapped) for r in codes.map_codes(df, "code", x, "a", "b", **options).collect()}


def test_code_repair_keeps_padded_code(spark):
    assert _map(spark, ["1985", "174", "185", "C61", "C795", "C7951", "Z29", None]) == {
        "1985": ("1985", "C7951"), "174": ("1740", "C50019"), "185": ("18500", "C61"), "C61": ("C6100", "C6100"),
        "C795": ("C7950", "C7950"), "C7951": ("C7951", "C7951"), "Z29": ("Z2900", "Z2900"),
    }


def test_code_repair_with_closing_nine(spark):
    got = _map(spark, ["2501", "250", "V10", "99999", "174"], last_nine=True, keep_unmatched=False)
    # 2501 pads to 25010, whose last character gives 25019: no match; V10 pads to V100.
    assert got == {"V10": ("V100", "Z8500"), "174": ("1740", "C50019")}
    x = spark.createDataFrame([("25009", "E11")], "a string, b string")
    df = spark.createDataFrame([("250",)], "code string")
    assert rows(codes.map_codes(df, "code", x, "a", "b", last_nine=True, keep_unmatched=False)) == [("250", "25009", "E11")]


def test_roll_up_describe_and_chapters(spark):
    df = spark.createDataFrame([("C7950",), ("C5001",), ("Z2900",)], "code_mapped string").withColumn(
        "category", codes.roll_up(F.col("code_mapped"))
    )
    assert rows(df, "category") == [("C50",), ("C7950",), ("Z29",)]
    terms = spark.createDataFrame([("C795", "Bone"), ("C50", None)], "code string, short_desc string")
    short = spark.createDataFrame([("C50", "Breast")], "code string, short_desc string")
    assert rows(codes.describe_codes(df, "category", terms, short), "category", "description") == [
        ("C50", "Breast"), ("C7950", "Bone"), ("Z29", "Prophylactic measures"),
    ]
    tree = spark.createDataFrame([("C79", "wrong", 1), ("C50", "first", 1), ("C50", "second", 2)], "three_digit string, sub_chapter string, o int")
    chapters = codes.subchapter_map(tree, "o")
    assert rows(codes.label_subchapter(df, "code_mapped", chapters), "code_mapped", "sub_chapter") == [
        ("C5001", "first"), ("C7950", "Secondary malignant neoplasm of other and unspecified sites"), ("Z2900", "Prophylactic measures"),
    ]
    assert codes.label_subchapter(df, "code_mapped", chapters, unmatched=None).count() == 2


def test_canonical_lab_names(spark):
    data = [
        ("Sodium", "NA", "sodium level", 1), ("Sodium", "SOD", "x", 2), ("Potassium", "K", "Kalium", 3), ("Kalium", "", "q", 4),
        ("", "Z", "d", 5), ("Loose", None, "e", 6), (None, "Y", "f", 7), ("K2", "sodium level", "g", 8),
    ]
    df = spark.createDataFrame(data, "test string, base string, descr string, o int")
    got = {r.o: r.canonical for r in codes.canonical_names(df, "test", "base", "descr", "o").collect()}
    # "Kalium" has no base name of its own but equals the description first listed for K;
    # the base name of K2 equals a description first listed for NA.
    # A missing test name is sodium's, a blank one has no name.
    assert got == {1: "NA", 2: "NA", 3: "K", 4: "K", 6: "Loose", 7: "NA", 8: "NA"}


def test_first_test_names(spark):
    data = [("Sodium", "NA", 2), ("Natrium", "NA", 1), ("", "Z", 0), ("K", "", 3), ("x", None, 4)]
    df = spark.createDataFrame(data, "test string, base string, o int")
    got = {r.o: r.first_test for r in codes.first_test_names(df, "test", "base", "o").collect()}
    assert got == {2: "Natrium", 1: "Natrium", 0: "Z", 3: "", 4: None}


def test_cohort_ingredients(spark):
    rx = spark.createDataFrame(
        [("d1", "cis", "Antineoplastic Agents"), ("d1", "cis", "X"), ("d2", "Sulindac", "Antineoplastic"), ("d3", "late", "Antineoplastic"), ("d4", "", "")],
        "drug_name string, ingredient string, class string",
    )
    orders = spark.createDataFrame([("d1",), ("d2",), ("d4",), ("d9",)], "drug_name string")
    classes = codes.drug_classes(rx)
    assert ("d4", "other", "other") in rows(classes)
    assert rows(codes.cohort_ingredients(classes, orders)) == [("cis",)]


def test_open_ended_intervals_equal_brute_force_in_few_rows(spark, day):
    rng = random.Random(9)
    points = [(rng.randint(1, 3), i, day(rng.randint(-900, 900)) if i % 11 else None) for i in range(200)]
    points += [(1, 500, date(1, 1, 1)), (1, 501, date(9999, 12, 31))]
    intervals = []
    for i in range(80):
        low, kind = rng.randint(-900, 900), i % 4
        high = date(9999, 12, 31) if kind == 0 else day(low + rng.choice([-3, 0, 1, 40, 700]))
        intervals.append((rng.randint(1, 3), i, date(1, 1, 1) if kind == 1 and i % 8 == 1 else day(low), high))
    p = spark.createDataFrame(points, "k int, p int, at date")
    q = spark.createDataFrame(intervals, "k int, q int, low date, high date")
    want = sorted((a, b) for k, a, t in points for j, b, lo, hi in intervals if k == j and t and lo <= t <= hi)
    for width in (1, 16, 64):
        got = op.point_in_any_interval(p, q, ["k"], "at", "low", "high", width)
        assert sorted((r.p, r.q) for r in got.collect()) == want
    assert op.point_in_any_interval(p, q.limit(0), ["k"], "at", "low", "high").count() == 0
    number = lambda c: F.floor(F.unix_date(c) / 64)
    sizes = q.where("low <= high").select(F.size(dyadic_pieces(number(F.col("low")), number(F.col("high")))).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] < 40


def test_days_in_intervals_match_a_comparison_of_every_pair(spark):
    from datetime import date, timedelta
    from random import Random

    from coursemill.operators.intervals import days_in_intervals

    draw, origin = Random(3), date(1969, 11, 1)  # day numbers below and above zero
    at = lambda n: origin + timedelta(days=n)
    points = sorted({(draw.choice("ab"), draw.randrange(400)) for _ in range(150)})
    spans = [(draw.choice("abc"), draw.choice(["x", "y", None]), low, low + draw.choice([-1, 0, 1, 30, 63, 64, 65, 200])) for low in (draw.randrange(400) for _ in range(60))]
    spans += spans[:20]
    found = days_in_intervals(
        spark.createDataFrame([(k, at(n)) for k, n in points], "k string, day date"),
        spark.createDataFrame([(k, v, at(low), at(high)) for k, v, low, high in spans], "k string, v string, low date, high date"),
        ["k"], ["v"], "day", "low", "high",
    )
    expected = {(k, at(n), v) for k, n in points for kk, v, low, high in spans if kk == k and low <= n <= high}
    got = [tuple(r) for r in found.select("k", "day", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
