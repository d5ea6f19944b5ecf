"""The whole run at the smallest scale: its plan, its wide table, and ids that have been merged."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from coursemill.plans.cohort import KEYS
from coursemill.workload import course_run

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def run(spark):
    return course_run.course_run(spark, SF)


def test_the_tables_meet_without_exchange(run):
    assert len(run.scalars) + len(run.presence) + 1 == 18  # patient and address are one table here
    plan = course_run.joined_courses(run)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange|Broadcast|Sort \[", plan)  # nor a sort buffer for each of them
    assert plan.count("SortMergeJoin") >= len(run.scalars) + len(run.presence)


def test_wide_table_holds_every_course_and_feature(run):
    wide, names = course_run.wide_courses(run)
    final = course_run.final_scalars(run)
    assert wide.count() == final.count() == final.select(*KEYS).distinct().count()
    assert len(names) == len(set(names)) == run.positions.count() > 50
    assert all(re.fullmatch(r"[A-Za-z.][A-Za-z0-9._]*", c) for c in wide.columns)
    ones = wide.select(sum(F.col(f"`{n}`") for n in names).alias("n")).agg(F.sum("n")).first()[0]
    stored = run.store.join(final.select(*KEYS), list(KEYS), "left_semi").select(*KEYS, "family", "feature").distinct().count()
    assert ones == stored
    assert wide.where(" OR ".join(f"`{c}` IS NULL" for c in wide.columns if c not in ("dob",))).count() == 0


def test_patients_come_once(spark, run):
    _, _, customers = course_run._sources(spark, SF)
    assert customers.count() == customers.select("pid").distinct().count()
