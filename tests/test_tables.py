import re

import pytest
from pyspark.sql import functions as F

from coursemill.operators.reshape import pivot_indicators
from coursemill.plans import tables


def test_bucketed_tables_join_without_exchange(spark):
    spine = spark.range(50).selectExpr("id % 7 AS pid", "concat('c', id) AS course", "id AS start")
    parts = [spark.range(60).selectExpr("id % 7 AS pid", "concat('c', id) AS course", f"id AS v{i}").where(f"id % {i + 2} = 0") for i in range(5)]
    joined = tables.join_bucketed(tables.bucketed(spine, "spine"), [tables.bucketed(p, f"p{i}") for i, p in enumerate(parts)])
    assert joined.count() == 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange|Broadcast|Sort \[", plan) and plan.count("SortMergeJoin") >= 5
    want = {(i % 7, f"c{i}"): tuple(i if i % (k + 2) == 0 else None for k in range(5)) for i in range(50)}
    assert {(r.pid, r.course): tuple(r[f"v{k}"] for k in range(5)) for r in joined.collect()} == want


@pytest.fixture(scope="module")
def store(spark):
    rows = [(i % 5, f"c{i}", family, f"f {i * k % 11}.x") for i in range(40) for k, family in ((1, "a"), (3, "b"))]
    return spark.createDataFrame(rows, "pid long, course string, family string, feature string").distinct()


def test_positions_are_numbers_without_gaps(store):
    got = tables.feature_positions(store).collect()
    assert sorted(r.position for r in got) == list(range(22))
    assert len({r.name for r in got}) == 22 and all(r.name == f"{r.feature}.{r.family}" for r in got)


def test_expanded_positions_equal_a_pivot(spark, store, monkeypatch):
    monkeypatch.setattr(tables, "CELLS", 60)  # a few rows at a time
    positions = tables.feature_positions(store)
    names = [r["name"] for r in positions.orderBy("position").collect()]
    rows = tables.position_table(store, positions, "present")
    empty = spark.createDataFrame([(9, "none", None)], "pid long, course string, present array<int>")
    wide = tables.expand_positions(rows.unionByName(empty), "present", names)
    named = store.withColumn("feature", F.concat_ws(".", "feature", "family"))
    want = pivot_indicators(named, ["pid", "course"], names)
    order = lambda df: sorted(tuple(r[c] for c in ("pid", "course", *names)) for r in df.collect())
    got = order(wide)
    assert [g for g in got if g[1] != "none"] == order(want)
    assert [sum(g[2:]) for g in got if g[1] == "none"] == [0]


def test_wide_rows_without_columns(spark):
    rows = spark.createDataFrame([(1, "a", [])], "pid long, course string, present array<int>")
    assert tables.expand_positions(rows, "present", []).columns == ["pid", "course"]


def test_tables_clustered_by_patient_meet_by_patient_and_day_without_a_shuffle(spark):
    from coursemill.plans.tables import bucketed

    rows = spark.range(200).selectExpr("id % 7 AS pid", "id % 11 AS course", "id % 5 AS day")
    left, right = (bucketed(rows.distinct(), n, ["pid"], 4) for n in ("left", "right"))
    joined = left.join(right.withColumnRenamed("course", "other").hint("merge"), ["pid", "day"])
    assert "Exchange" not in joined.groupBy("pid", "day", "course").count()._jdf.queryExecution().executedPlan().toString()
    expected = rows.distinct().join(rows.distinct().withColumnRenamed("course", "other"), ["pid", "day"])
    assert sorted(joined.collect()) == sorted(expected.collect())


def test_shuffles_start_with_more_partitions_for_larger_files(spark, tmp_path, monkeypatch):
    from coursemill import session
    from coursemill.workload import roles

    setting = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(setting, None)
    spark.range(5000).write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(session, "PARTITION_BYTES", 64)
    try:
        assert roles.table(spark, str(tmp_path), "t").count() == 5000
        assert session.partitions(spark) == int(spark.conf.get(setting)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def test_shared_names_do_not_shuffle_the_store(spark):
    from coursemill.operators.reshape import family_safe

    rows = spark.createDataFrame([(1, "A", "x", "n"), (1, "A", "y", "n"), (2, "B", "x", "m")], "pid int, course string, family string, feature string")
    told = family_safe(rows)
    assert "SortMergeJoin" not in told._jdf.queryExecution().executedPlan().toString()
    assert {r["feature"] for r in told.collect()} == {"n.x", "n.y", "m"}
