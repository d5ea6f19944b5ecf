from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from coursemill.plans import cohort as c

PLAN = (
    "patient_id string, course_id string, machine string, planned_dose double, planned_fractions double,"
    "delivered_dose double, delivered_fractions double, revision double, first_day date, last_day date"
)


def plan(pid, course, first, last, machine="M1", planned=10.0, delivered=5.0, revision=0.0):
    return (pid, course, machine, planned, 2.0, delivered, 1.0, revision, first, last)


@pytest.fixture
def changes(spark):
    return spark.createDataFrame([("old1", "new"), ("old2", "new")], "old_id string, new_id string")


def test_cohort_rolls_plan_lines_up(spark, changes):
    d = date
    lines = [
        plan("p", "1", d(2015, 1, 5), d(2015, 2, 1), revision=1.0),
        plan("p", "1", d(2015, 1, 5), d(2015, 2, 1), revision=1.0),  # exact copy
        plan("p", "1", d(2015, 1, 2), d(2015, 1, 20), planned=None, revision=3.0),
        plan("p", "1", d(2014, 1, 2), d(2016, 1, 20), machine="TBCary"),
        plan("p", "1", d(2014, 1, 2), d(2016, 1, 20), machine=None),
        plan("p", "1", d(2014, 1, 2), d(2016, 1, 20), delivered=0.0),
        plan("q", "1", d(2012, 1, 5), d(2012, 12, 31)),  # ends too early
        plan("r", "1", d(2017, 1, 1), d(2017, 2, 1)),  # starts too late
        plan("s", "1", d(2012, 12, 1), d(2013, 1, 1)),
        plan("old1", "X", d(2015, 1, 1), d(2015, 2, 1)),
        plan("old2", "X", d(2015, 3, 1), d(2015, 4, 1)),
    ]
    got = c.course_cohort(spark.createDataFrame(lines, PLAN), changes)
    assert rows(got, "mrn", "course", "numplans", "planneddose", "dose", "revisions", "start", "end") == [
        ("new", "X", 1, 10.0, 5.0, 0.0, d(2015, 1, 1), d(2015, 2, 1)),
        ("new", "X", 1, 10.0, 5.0, 0.0, d(2015, 3, 1), d(2015, 4, 1)),
        ("p", "1", 2, None, 10.0, 3.0, d(2015, 1, 2), d(2015, 2, 1)),
        ("s", "1", 1, 10.0, 5.0, 0.0, d(2012, 12, 1), d(2013, 1, 1)),
    ]


def test_edge_rows_only_of_known_patients(spark):
    core = spark.createDataFrame([("a", 1)], "patient_id string, v int")
    edge = spark.createDataFrame([("a", "x"), ("b", "y")], "patient_id string, w string")
    assert rows(c.edge_charges(core, edge), "patient_id", "v", "w") == sorted([("a", 1, None), ("a", None, "x")], key=str)


CHARGE = "patient_id string, service_date date, description string, attending string"


def test_spine_from_assigned_charges(spark, changes):
    d = date
    cohort = spark.createDataFrame(
        [
            ("new", "X", d(2015, 1, 1), d(2015, 2, 1), 10.0), ("new", "X", d(2015, 3, 1), d(2015, 4, 1), 20.0),
            ("new", "Y", d(2015, 1, 20), d(2015, 1, 25), None), ("new", "none", d(2016, 1, 1), d(2016, 2, 1), 1.0),
            ("t", "T", d(2015, 1, 1), d(2015, 2, 1), 1.0),
        ],
        "mrn string, course string, start date, end date, planneddose double",
    )
    charges = [
        ("old1", d(2015, 1, 1), "Treatment Delivery", "Ann"),  # first day
        ("old2", d(2015, 2, 1), "xStereox", "Bob"),  # last day
        ("new", d(2014, 12, 31), "IMRT- Rapid Arc", "Zed"), ("new", d(2015, 2, 2), "IMRT- Rapid Arc", "Zed"),
        ("new", d(2015, 1, 20), "plain", "Bob"), ("new", d(2015, 3, 1), "plain", "Ann"),
        ("new", d(2015, 1, 21), "a marker", "Zed"), ("new", d(2015, 1, 21), "Ultrasound", "Zed"),
        ("new", d(2015, 1, 21), None, "Zed"), ("new", d(2015, 1, 21), "plain", None),
        ("stranger", d(2015, 1, 21), "plain", "Zed"), ("t", d(2015, 1, 5), "Total Body Photon Irradiation", "Ann"),
    ]
    people = spark.createDataFrame([("new", "P"), ("t", "T")], "mrn string, pid string")
    raw = spark.createDataFrame(charges, CHARGE)
    spine = c.course_spine(cohort, c.treatment_rows(raw), people, changes)
    assert rows(
        spine, "pid", "course", "start", "end", "attending", "planneddose", "numcharge", "srssbrt", "conv", "imrtvmat", "duration"
    ) == [
        ("P", "X", d(2015, 1, 1), d(2015, 4, 1), "Ann", 20.0, 4, 1, 1, 0, 90),
        ("P", "Y", d(2015, 1, 20), d(2015, 1, 25), "Bob", None, 1, 0, 0, 0, 5),
    ]
    # The same through the row-level assignment.
    assigned = c.assign_courses(cohort, c.treatment_charges(raw, people, changes))
    by_hand = assigned.groupBy("pid", "course").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("s"))
    assert rows(by_hand.where("pid = 'P'"), "course", "n", "s") == [("X", 4, d(2015, 1, 1)), ("Y", 1, d(2015, 1, 20))]
