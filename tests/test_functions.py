from datetime import date

from conftest import rows
from pyspark.sql import functions as F

from coursemill import functions as fn


def test_dates_ignore_trailing_text_and_reject_garbage(spark):
    df = spark.createDataFrame(
        [(t,) for t in ("1/2/2015", "01/02/2015 10:11:12", " 3/4/2015 x", "13/01/2015", "garbage", None, "")], "t string"
    )
    assert [r[0] for r in df.select(fn.parse_date(F.col("t"))).collect()] == [
        date(2015, 1, 2), date(2015, 1, 2), date(2015, 3, 4), None, None, None, None,
    ]


def test_dates_can_demand_a_clock_part(spark):
    df = spark.createDataFrame([("1/2/2015",), ("1/2/2015 9:05",), ("1/2/2015 9:05:07",)], "t string")
    got = df.select(fn.parse_date(F.col("t"), "minute"), fn.parse_date(F.col("t"), "second")).collect()
    d = date(2015, 1, 2)
    assert [tuple(r) for r in got] == [(None, None), (d, None), (d, d)]


def test_strict_aggregates_are_null_when_any_value_is(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None)], "k string, v double")
    got = df.groupBy("k").agg(fn.strict(F.sum, F.col("v")).alias("s"), fn.strict(F.max, F.col("v")).alias("m"))
    assert rows(got, "k", "s", "m") == [("a", 3.0, 2.0), ("b", None, None)]


def test_missing_text_lacks_everything_but_does_not_contain(spark):
    df = spark.createDataFrame([("CHEMOTHERAPY",), ("chemo",), (None,)], "t string")
    got = df.select(fn.lacks_text(F.col("t"), "CHEMO"), fn.has_text(F.col("t"), ["CHEMO", "X"])).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, False), (True, None)]


def test_flag_rules(spark):
    df = spark.createDataFrame([("IMRT",), ("xStereo",), ("stereo",), (None,)], "d string")
    got = fn.with_flags(df, "d", {"a": {"equals": ["IMRT"], "contains": ["Stereo"]}, "b": {"equals": ["IMRT"]}})
    assert [tuple(r)[1:] for r in got.collect()] == [(1, 1), (1, 0), (0, 0), (0, 0)]


def test_fill_zero_covers_numbers_and_text(spark, day):
    df = spark.createDataFrame([(None, None, None, None)], "i int, d double, s string, t date")
    assert rows(fn.fill_zero(df)) == [(0, 0.0, "0", None)]
    assert rows(fn.fill_zero(df, skip=("i",))) == [(None, 0.0, "0", None)]


def test_finite_recode_blank_number(spark):
    df = spark.createDataFrame([(float("inf"), "Defer", "20+"), (1.5, "", "x"), (float("nan"), None, "7")], "v double, t string, n string")
    got = df.select(
        fn.finite(F.col("v")), fn.recode_tokens(F.col("t"), ["Defer"], "U"), fn.blank_to(F.col("t"), "other"), fn.parse_number(F.col("n"))
    ).collect()
    assert [tuple(r) for r in got] == [(None, "U", "Defer", 20.0), (1.5, "", "other", None), (None, "U", None, 7.0)]


def test_null_profile_and_empty_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "a int, b int, c string")
    assert rows(fn.null_profile(df)) == [("a", 1, 1), ("b", 0, 2), ("c", 2, 0)]
    assert fn.drop_empty_columns(df).columns == ["a", "c"]
    assert rows(fn.drop_incomplete(df.drop("b"))) == [(1, "x")]


def test_text_helpers(spark, day):
    df = spark.createDataFrame([("C79.51 ,C61", 2, 3)], "c string, x int, y int").withColumn("d", F.lit(day(0)))
    got = df.select(
        fn.first_token(fn.strip_dots(F.col("c")), " ,"),
        fn.row_sum(["x", "y"]),
        F.round(fn.age_years(F.col("d"), F.lit(date(1997, 6, 1))), 2),
        fn.nonblank(F.lit("")),
    ).first()
    assert tuple(got) == ("C7951", 5, 18.0, False)
