import random

import pytest
from conftest import rows

from coursemill.plans import assemble
from coursemill.plans import features as f


def test_admissions_boundaries(spark, one_course, day):
    def run(*stays):
        df = spark.createDataFrame(
            [(1, a, x, 2.0, drg) for a, x, drg in stays],
            "pid int, admit_date date, discharge_date date, los_days double, drg string",
        )
        got = f.admissions(one_course, df).collect()
        assert len(got) == 2
        other = next(r for r in got if r.pid == 2)
        assert tuple(other)[2:] == (0, 1e100, 0, 0, 0, 0, 0.0)
        r = next(r for r in got if r.pid == 1)
        return tuple(r)[2:]

    # (admit, lastadmit, admitatstart, notdisch, numyear, nummonth, daysyear)
    assert run((day(0), day(3), None)) == (0, 1e100, 1, 0, 0, 0, 0.0)
    assert run((day(1), day(3), None))[0] == 1
    assert run((day(30), day(33), "X"))[0] == 1
    assert run((day(31), day(33), "X"))[0] == 0
    assert run((day(1), day(3), "CHEMOTHERAPY W/O"))[0] == 0
    assert run((day(-5), day(0), None)) == (0, 0.0, 0, 0, 1, 1, 2.0)
    assert run((day(-5), day(1), None))[2:4] == (1, 0)
    assert run((day(-5), day(29), None))[2:4] == (1, 0)
    assert run((day(-5), day(30), None))[2:4] == (1, 1)
    assert run((day(-5), None, None)) == (0, 1e100, 0, 0, 0, 0, 0.0)
    assert run((day(-40), day(-30), None)) == (0, 30.0, 0, 0, 1, 1, 2.0)
    assert run((day(-40), day(-31), None)) == (0, 31.0, 0, 0, 1, 0, 2.0)
    assert run((day(-400), day(-365), None)) == (0, 365.0, 0, 0, 1, 0, 2.0)
    assert run((day(-400), day(-366), None)) == (0, 366.0, 0, 0, 0, 0, 0.0)
    assert run((None, day(-10), None)) == (0, 1e100, 0, 0, 0, 0, 0.0)
    assert run((day(-50), day(40), None), (day(-40), day(-31), None), (day(-3), day(-2), None), (day(9), day(11), None)) == (
        1, 2.0, 1, 1, 2, 1, 4.0,
    )


def test_admissions_equal_brute_force(spark, day):
    rng = random.Random(11)
    stays = []
    for _ in range(200):
        a = rng.randint(-500, 100)
        x = None if rng.random() < 0.1 else day(a + rng.randint(-2, 60))
        stays.append((rng.randint(1, 4), day(a), x, float(rng.randint(0, 9)), rng.choice([None, "CHEMO A", "OTHER"])))
    courses = [(rng.randint(1, 5), f"c{i}", day(s), day(s + rng.randint(0, 40))) for i in range(40) for s in [rng.randint(-200, 60)]]
    spine = spark.createDataFrame(courses, "pid int, course string, start date, end date")
    enc = spark.createDataFrame(stays, "pid int, admit_date date, discharge_date date, los_days double, drg string")
    got = {r.course: tuple(r)[2:] for r in f.admissions(spine, enc).collect()}
    for pid, course, s, e in courses:
        mine = [t for t in stays if t[0] == pid]
        prior = [((s - x).days, los) for _, _, x, los, _ in mine if x and x <= s]
        at_start = [x for _, a, x, _, _ in mine if x and a <= s < x]
        assert got[course] == (
            int(any(s < a <= e and "CHEMO" not in (drg or "") for _, a, _, _, drg in mine)),
            float(min((p for p, _ in prior), default=1e100)),
            int(bool(at_start)),
            int(any(not (s <= x < e) for x in at_start)),
            sum(p <= 365 for p, _ in prior),
            sum(p <= 30 for p, _ in prior),
            sum(los for p, los in prior if p <= 365),
        )


def test_unplanned_admissions_keep_their_reason(spark, one_course, day):
    df = spark.createDataFrame([(1, day(0), "a"), (1, day(1), "b"), (1, day(30), None), (1, day(31), "c"), (1, day(2), "CHEMO")], "pid int, admit_date date, drg string")
    assert rows(f.unplanned_admissions(one_course, df), "course", "drg") == sorted([("A", "b"), ("A", None)], key=str)


def test_ed_visit_boundaries(spark, one_course, day):
    def run(*days):
        df = spark.createDataFrame([(1, day(d) if d is not None else None) for d in days], "pid int, ed_arrival_date date")
        return tuple(next(r for r in f.ed_visits(one_course, df).collect() if r.pid == 1))[2:]

    assert run(0) == (0, 0.0, 1, 1)
    assert run(1) == (1, 1e100, 0, 0)
    assert run(30, None) == (1, 1e100, 0, 0)
    assert run(31) == (0, 1e100, 0, 0)
    assert run(-30, -31, -365, -366) == (0, 30.0, 1, 3)


VITAL = "pid int, taken_date date, dbp double, sbp double, weight_kg double, bmi double, temp_c double, pulse double, spo2 double, pain double, source_order int"


def test_vitals(spark, one_course, day):
    blank = (None,) * 8

    def run(*readings):
        df = spark.createDataFrame([(1, day(d), *v, i) for i, (d, v) in enumerate(readings)], VITAL)
        return next(r for r in f.abnormal_vitals(one_course, df).collect() if r.pid == 1).asDict()

    normal = (60.0, 90.0, 70.0, 20.0, 37.9, 100.0, 90.0, 3.0)
    got = run((0, normal))
    assert [got[k] for k in ("weightloss", "maxpain", "hypo", "hyper", "tachy", "brady", "hypox", "fever", "pain")] == [0.0, 3.0, 0, 0, 0, 0, 0, 0, 0]
    assert run((0, (79.0, 129.0, *normal[2:])))["hyper"] == 0
    assert run((0, (80.0, None, *normal[2:])))["hyper"] == 1
    assert run((0, (None, 130.0, *normal[2:])))["hyper"] == 1
    assert run((0, (59.0, None, *normal[2:])))["hypo"] == 1
    assert run((0, (None, 89.0, *normal[2:])))["hypo"] == 1
    abnormal = run((0, (60.0, 90.0, 70.0, 20.0, 38.0, 101.0, 89.0, 4.0)), (-1, (None,) * 5 + (49.0, None, None)))
    assert [abnormal[k] for k in ("tachy", "brady", "hypox", "fever", "pain", "maxpain")] == [1, 1, 1, 1, 1, 4.0]
    weight = lambda w: (None, None, w, None, None, None, None, None)
    # Latest known weight: by day, then by source order; a later reading without a weight is ignored.
    got = run((-100, weight(100.0)), (-2, weight(90.0)), (-2, weight(80.0)), (-1, blank), (1, weight(10.0)), (-366, weight(500.0)))
    assert got["weightloss"] == pytest.approx(0.2)
    assert run((-365, weight(50.0)), (0, weight(40.0)))["weightloss"] == pytest.approx(0.2)
    assert run((0, weight(0.0)))["weightloss"] == 0.0
    assert set(run((0, blank)).values()) == {1, "A", 0.0}


def test_labs_window_flags_and_status(spark, one_course, day):
    def lab(d, flag="H", status="F", test="ALB", base="Albumin", pid=1):
        return (pid, day(d), test, base, "", flag, status)

    def run(*labs):
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(labs)], "pid int, specimen_date date, test_name string, base_name string, test_description string, abnormal_flag string, status_code string, source_order int")
        return rows(f.abnormal_labs(one_course, df), "course", "feature")

    assert run(lab(0), lab(-3)) == [("A", "Albumin")]
    assert run(lab(-28)) == [("A", "Albumin")]
    assert run(lab(-29)) == run(lab(1)) == run(lab(0, "")) == run(lab(0, None)) == run(lab(0, status="P")) == []
    assert run(lab(0, " ")) == [("A", "Albumin")]


def _drugs(spark, *orders):
    return spark.createDataFrame(list(orders), "pid int, drug_name string, start_date date, end_date date")


def test_drug_state_boundaries(spark, one_course, day):
    def states(begun, ended):
        when = lambda n: None if n is None else day(n)
        got = f.drug_states(one_course, _drugs(spark, (1, "d", when(begun), when(ended))))
        return {r.state for r in got.collect()}

    assert states(-180, 0) == {"recent"}
    assert states(-181, 0) == set()
    assert states(-30, 1) == {"concurrent", "current"}
    assert states(-31, 1) == {"current"}
    assert states(14, 20) == {"concurrent"}
    assert states(15, 20) == set()
    assert states(0, 1) == {"concurrent", "current"}
    assert states(0, 0) == {"recent"}
    assert states(5, -5) == {"recent"}  # ends before it begins
    assert states(-10, None) == states(None, 10) == states(None, None) == set()


RX = [("d", "cis", "Antineoplastic Agents"), ("d", "cis", "Alkylators"), ("p", "Prednisone", "Antineoplastic Agents"), ("b", "", "")]


def test_drug_families(spark, one_course, day):
    rx = spark.createDataFrame(RX, "drug_name string, ingredient string, class string")
    orders = _drugs(
        spark, (1, "d", day(-5), day(5)), (1, "d", day(-50), day(-40)), (1, "p", day(-5), day(5)), (1, "b", day(-5), day(5)), (1, "unlisted", day(-9), day(-8))
    )
    got = rows(f.drug_features(one_course, orders, rx), "family", "feature")
    assert got == sorted(
        [
            ("conagent", "con_cis"), ("recagent", "rec_cis"), ("conclass", "con_Alkylators"), ("conclass", "con_Antineoplastic Agents"),
            ("recclass", "rec_Alkylators"), ("recclass", "rec_Antineoplastic Agents"),
            ("recmed", "rec_Alkylators"), ("recmed", "rec_Antineoplastic Agents"), ("recmed", "rec_NA"),
            ("curmed", "cur_Alkylators"), ("curmed", "cur_Antineoplastic Agents"), ("curmed", "cur_other"),
        ],
        key=str,
    )
    agents = f.systemic_agents(one_course, orders, rx)
    assert {r.family for r in agents.collect()} == set(f.AGENT_FAMILIES)


def test_any_agent_equals_three_valued_logic(spark, day):
    rng = random.Random(2)
    pick = lambda: None if rng.random() < 0.25 else rng.randint(-220, 40)
    orders = [(rng.randint(1, 60), pick(), pick()) for _ in range(110)]
    when = lambda n: None if n is None else day(n)
    spine = spark.createDataFrame([(p, f"c{p}-{s}", day(s), day(s + 9)) for p in range(1, 65) for s in (-40, 0)], "pid int, course string, start date, end date")
    rx = spark.createDataFrame(RX, "drug_name string, ingredient string, class string")
    df = _drugs(spark, *[(p, "d", when(a), when(b)) for p, a, b in orders])
    got = {r.course: (r.concurrent, r.recent) for r in f.any_agent(spine, df, rx).collect()}

    def both(*parts):
        return False if False in parts else None if None in parts else True

    def top(values):
        return None if None in values else int(max(values))

    want = {}
    for p in {o[0] for o in orders}:
        for s in (-40, 0):
            con, rec = [], []
            for q, a, b in orders:
                if q == p:
                    lt = lambda x, y: None if x is None or y is None else x < y
                    con.append(both(lt(s, b), lt(a, s + 15), lt(s - 31, a)))
                    rec.append(both(None if b is None else b <= s, lt(s - 181, a)))
            want[f"c{p}-{s}"] = (top(con), top(rec))
    assert got == want


def test_prior_procedures(spark, one_course, day):
    df = spark.createDataFrame([(1, day(0), "Biopsy"), (1, day(-5000), "Scan"), (1, day(1), "Late"), (1, day(-1), ""), (1, None, "Undated"), (1, day(-3), "Biopsy")], "pid int, date date, category string")
    assert rows(f.prior_procedures(one_course, df, "category", "date"), "course", "feature") == [("A", "proc_Biopsy"), ("A", "proc_Scan")]


def test_history_from_three_sources(spark, one_course, day):
    problems = spark.createDataFrame(
        [(1, "E11.9, I10", None, day(-1)), (1, "C50.1", day(-5), day(9)), (1, "J44", day(1), day(-9)), (1, None, day(-1), None), (1, "A00, B00, C00, D00, Z99", day(-1), None)],
        "pid int, icd10_list string, noted_date date, entered_date date",
    )
    diagnoses = spark.createDataFrame(
        [(1, "250.1", "ICD-9-CM", day(-2)), (1, "N18.3", "ICD-10-CM", day(0)), (1, "K21", "LOCAL", day(-1)), (1, "", "ICD-10-CM", day(-1)), (1, "999.8", "ICD-9-CM", day(-1)), (1, "F32", "ICD-10-CM", day(1))],
        "pid int, code string, code_set string, date date",
    )
    crosswalk = spark.createDataFrame([("25019", "E10")], "code9 string, code10 string")
    history = f.history_codes(problems, diagnoses, crosswalk)
    known = ["E11", "I10", "C50", "J44", "E10", "N18", "K21", "F32", "Z99", "A00"]
    chapters = spark.createDataFrame([(c, f"ch {c}") for c in known], "three_digit string, sub_chapter string")
    got = {r.feature for r in f.past_history(one_course, history, chapters).collect()}
    assert got == {"ch E11", "ch I10", "ch C50", "ch E10", "ch N18", "ch A00", "ch Z99"}
    terms = spark.createDataFrame([("E11", "Diabetes")], "code string, short_desc string")
    both = f.past_history(one_course, history, chapters, terms)
    assert rows(both.where("family = 'pmhdx'"), "course", "feature") == [("A", "Diabetes")]


def test_course_diagnoses(spark, day):
    cohort = spark.createDataFrame([("m", "A", day(0), day(10))], "mrn string, course string, start date, end date")
    charges = spark.createDataFrame(
        [("m", 1, day(0), "C79.5 ,174"), ("m", 1, day(10), "C79.51 ,C50.1 ,Z29 ,Z29 ,I10"), ("m", 1, day(11), "J44"), ("m", 1, day(5), None)],
        "mrn string, pid int, service_date date, diagnosis_list string",
    )
    crosswalk = spark.createDataFrame([("1740", "C50019")], "code9 string, code10 string")
    chapters = spark.createDataFrame([("C50", "Breast"), ("C79", "Mets"), ("I10", "Pressure")], "three_digit string, sub_chapter string")
    terms = spark.createDataFrame([("C50", "Breast cancer"), ("C795", "Bone mets"), ("C7951", "Bone")], "code string, short_desc string")
    got = rows(f.course_diagnoses(cohort, charges, crosswalk, chapters, terms), "family", "feature")
    assert sorted(got) == [
        ("coursedx", "coursedx_Bone"), ("coursedx", "coursedx_Bone mets"), ("coursedx", "coursedx_Breast cancer"),
        ("coursedx", "coursedx_Prophylactic measures"), ("coursesub", "coursesub_Breast"), ("coursesub", "coursesub_Mets"),
        ("coursesub", "coursesub_Pressure"), ("coursesub", "coursesub_Prophylactic measures"),
    ]


SOCIAL = "pid int, reported_date date, tobacco string, alcohol string, illicit_drug string, sexually_active string, source_order int"


def test_social_history(spark, one_course, day):
    df = spark.createDataFrame(
        [(1, day(-9), "Yes", "Defer", None, "No", 1), (1, day(0), "Quit", "Not Asked", "", "No", 2), (1, day(-3), "Yes", "Defer", None, "No", 3), (1, day(1), "Late", "x", "x", "x", 4)],
        SOCIAL,
    )
    u = "UNKNOWN"
    assert rows(f.social_history(one_course, df)) == [(1, "A", "Quit", u, "", "No"), (1, "A", "Yes", u, u, "No"), (2, "B", u, u, u, u)]
    assert rows(f.social_history(one_course, df, latest_only=True)) == [(1, "A", "Quit", u, "", "No"), (2, "B", u, u, u, u)]


def test_assembly(spark, day):
    spine = spark.createDataFrame([(p, f"c{p}", day(0), day(30), 1.0) for p in (1, 2, 3, 4)], "pid int, course string, start date, end date, dose double")
    people = spark.createDataFrame(
        [(1, day(-365 * 40), "w"), (2, day(-365 * 10), "w"), (3, day(-365 * 50), None), (4, day(-365 * 60), "b")], "pid int, dob date, race string"
    ).select("*", )
    stays = spark.createDataFrame([(3, day(-5), day(30), 1.0, None), (4, day(3), day(4), 1.0, None)], "pid int, admit_date date, discharge_date date, los_days double, drg string")
    ed = spark.createDataFrame([(1, day(2))], "pid int, ed_arrival_date date")
    extra = spark.createDataFrame([(1, "c1", 0.5, None)], "pid int, course string, weightloss double, empty string")
    table = assemble.course_table(
        spine, people, f.admissions(spine, stays), f.ed_visits(spine, ed), [extra], f.zip_areas(spark.createDataFrame([(1, "94110-1234")], "pid int, postal_code string"))
    )
    assert "notdisch" not in table.columns
    assert rows(table, "course", "adm_ed", "admit", "ed", "zip", "weightloss") == [("c1", 1, 0, 1, "94110", 0.5), ("c4", 1, 1, 0, "0", 0.0)]
    store = assemble.long_store([spark.createDataFrame([(1, "c1", "lab", "ALB", 1.0), (2, "c2", "lab", "K", 1.0)], "pid int, course string, family string, feature string, value double")])
    kept = assemble.eligible_features(store, table)
    wide = assemble.wide_table(table, kept)
    assert rows(wide, "course", "ALB") == [("c1", 1), ("c4", 0)]
    assert wide.groupBy("pid", "course").count().where("count > 1").count() == 0


def test_wide_export_drops_before_it_fills_and_takes_any_name(spark):
    courses = spark.createDataFrame([(1, "a", None, 2.0), (2, "b", None, None)], "pid int, course string, attending string, dose double")
    store = spark.createDataFrame(
        [(1, "a", "coursedx", "dx_a.b, c", 1.0), (1, "a", "recclass", "rec_x", 1.0), (2, "b", "recmed", "rec_x", 1.0)],
        "pid int, course string, family string, feature string, value double",
    )
    wide = assemble.wide_table(courses, store)
    assert wide.columns == ["pid", "course", "dose", "dx_a.b, c", "rec_x.recclass", "rec_x.recmed"]
    assert rows(wide) == [(1, "a", 2.0, 1, 1, 0), (2, "b", 0.0, 0, 0, 1)]
