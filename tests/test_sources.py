import csv
from datetime import date

from conftest import rows

from coursemill import sources


def test_names_are_repaired_and_unique():
    assert sources.syntactic_names(["1st Day", "Revision #", "a b", "a b", "a.b.1", "_x", ".5", ".ok", "NA"]) == [
        "X1st.Day", "Revision..", "a.b", "a.b.2", "a.b.1", "X_x", "X.5", ".ok", "NA.",
    ]


def test_csv_tells_missing_from_blank(spark, tmp_path):
    (tmp_path / "labs.csv").write_text(
        'Test Name,Value,Date\nNA,1.5,01/02/2015 10:00:00\n,NA,1/2/2015\n"a, b",x,bad\n""" q",,13/40/2015\n'
    )
    df = sources.read_table(
        spark, str(tmp_path / "labs.csv"), {"Test.Name": "string", "Value": "double", "Date": "date"}, rename={"Date": "day"}
    )
    assert df.columns == ["Test.Name", "Value", "day"]
    assert [tuple(r) for r in df.collect()] == [
        (None, 1.5, date(2015, 1, 2)), ("", None, date(2015, 1, 2)), ("a, b", None, None), ('" q', None, None),
    ]


def test_folder_gives_one_table_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k\n1\n2\n")
    (tmp_path / "b.csv").write_text("k,v\n1,NA\n")
    (tmp_path / "note.txt").write_text("x")
    tables = sources.read_folder(spark, str(tmp_path), types={"a.csv": {"k": "int"}})
    assert sorted(tables) == ["a.csv", "b.csv"]
    assert rows(tables["a.csv"]) == [(1,), (2,)]
    assert rows(tables["b.csv"]) == [("1", None)]


def test_source_order_is_file_order(spark, tmp_path):
    for name, keys in (("1.csv", "xyz"), ("2.csv", "abc")):
        (tmp_path / name).write_text("k\n" + "\n".join(keys) + "\n")
    df = sources.read_table(spark, str(tmp_path), {"k": "string"}, ordered=True)
    assert [r.k for r in df.orderBy("source_order").collect()] == list("xyzabc")


def test_crosswalk_and_first_row_wins(spark, tmp_path):
    from coursemill.operators.codes import build_crosswalk

    (tmp_path / "gem.txt").write_text("  1985   C7951  10000\n1985 C7952 10000\n\n0010\tA000 00000\n")
    raw = sources.read_crosswalk(spark, str(tmp_path / "gem.txt"), ["code9", "code10", "flags"])
    assert rows(build_crosswalk(raw, "code9", "code10", "source_order")) == [("0010", "A000"), ("1985", "C7951")]


def test_positional_file_fills_short_lines(spark, tmp_path):
    (tmp_path / "rx.text").write_text("a|b\nq|r|s|drug A|x|class 1|more\nq|r|s|drug B\n")
    df = sources.read_positional(spark, str(tmp_path / "rx.text"), {"drug": 4, "class": 6})
    assert rows(df) == [("", ""), ("drug A", "class 1"), ("drug B", "")]


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("y", 2), ("y", 2)], "w string, k int")
    assert rows(sources.union_by_name([a, b], distinct=True), "k", "v", "w") == [(1, "x", None), (2, None, "y")]


def test_sinks_write_readable_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, None), ("", None, "z"), ("a", 2.0, "z")], "`k x` string, v double, w string")
    sources.write_keys(df, "k x", str(tmp_path / "keys"))
    assert rows(sources.read_table(spark, str(tmp_path / "keys"))) == [("",), ("a",)]
    sources.write_table(df, str(tmp_path / "t"), csv_copy=str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["k.x", "v", "w"]
    back = sources.read_table(spark, str(tmp_path / "c"), {"k.x": "string", "v": "double", "w": "string"})
    assert rows(back) == sorted([("a", 1.0, None), ("", None, "z"), ("a", 2.0, "z")], key=str)
    part = next((tmp_path / "c").glob("part-*.csv"))
    assert next(csv.reader(part.open())) == ["k.x", "v", "w"]
