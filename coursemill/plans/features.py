"""Feature families, each keyed by (pid, course).

``spine`` always has ``pid, course, start, end``. Day differences are ``p = start - event day``.
Families with numeric aggregates come back wide with one row per course, presence families come back
as long rows ``(pid, course, family, feature, value)``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursemill.functions.nulls import lacks_text, nonblank
from coursemill.functions.text import recode_tokens, strip_dots
from coursemill.operators import codes
from coursemill.operators.intervals import days_in_intervals, point_in_any_interval, point_in_interval
from coursemill.operators.joins import backfill, keep_members
from coursemill.operators.reshape import explode_codes, long_features
from coursemill.operators.timeline import Measure, by_day, timeline_profile
from coursemill.plans.cohort import KEYS
from coursemill.session import materialise

# Day limits of the lookback windows.
YEAR, MONTH, LAB_DAYS = 365, 30, 28
RECENT_DAYS, CONCURRENT_BEFORE, CONCURRENT_AFTER = 180, 30, 14

# Fixed value: stands for "never" in the days-since features.
NEVER = 1e100

# Fixed value: marks a planned admission.
PLANNED_MARK = "CHEMO"

# Social-history answers that say nothing.
NO_ANSWER, UNKNOWN = ("Defer", "Not Asked"), "UNKNOWN"
SOCIAL_FIELDS = ("tobacco", "alcohol", "illicit_drug", "sexually_active")


def _starts(spine: DataFrame) -> DataFrame:
    return spine.select("pid", "start").distinct()


def _to_courses(spine: DataFrame, per_start: DataFrame) -> DataFrame:
    """Spread rows per (pid, start) over the courses that start on that day."""
    return spine.select(*KEYS, "start").join(per_start, ["pid", "start"]).drop("start")


# --- encounters -------------------------------------------------------------------------------


def admissions(spine: DataFrame, encounters: DataFrame, planned_mark: str = PLANNED_MARK) -> DataFrame:
    """Unplanned admission during the course, and the admission history before it.

    ``admit``: an admission after the first day and up to the last, not marked as planned.
    ``lastadmit``: days since the latest discharge. ``admitatstart`` / ``notdisch``: in hospital on
    the first day / and not discharged before the last. ``numyearadmit``, ``nummonthadmit``,
    ``daysyearadmit``: discharges of the last 365 and 30 days, and hospital days of the former.
    """
    unplanned = lacks_text(F.col("drg"), planned_mark)
    rows = encounters.where(F.col("admit_date").isNotNull()).select(
        "pid",
        F.explode(
            F.array(
                F.struct(
                    F.col("admit_date").alias("at"),
                    F.col("discharge_date").alias("until"),
                    F.when(unplanned, F.col("admit_date")).alias("unplanned"),
                    F.lit(None).cast("date").alias("discharged"),
                    F.lit(None).cast("double").alias("los"),
                ),
                F.struct(
                    F.col("discharge_date").alias("at"),
                    F.lit(None).cast("date").alias("until"),
                    F.lit(None).cast("date").alias("unplanned"),
                    F.col("discharge_date").alias("discharged"),
                    F.col("los_days").cast("double").alias("los"),
                ),
            )
        ).alias("e"),
    ).select("pid", "e.*")
    daily = by_day(
        rows,
        ["pid"],
        "at",
        until=F.max("until"),
        unplanned=F.max("unplanned"),
        discharged=F.max("discharged"),
        n=F.count("discharged"),
        los=F.sum("los"),
    )
    profile = timeline_profile(
        spine,
        daily,
        ["pid"],
        "start",
        [
            Measure("next_admit", "min", "unplanned", after=True),
            Measure("last_discharge", "max", "discharged"),
            Measure("in_until", "max", "until"),
            Measure("n_year", "sum", "n", YEAR),
            Measure("n_month", "sum", "n", MONTH),
            Measure("los_year", "sum", "los", YEAR),
        ],
    )
    at_start = F.col("in_until") > F.col("start")
    return spine.select(*KEYS, "start", "end").join(profile, ["pid", "start"], "left").select(
        *KEYS,
        _flag(F.col("next_admit") <= F.col("end")).alias("admit"),
        _days_since("last_discharge").alias("lastadmit"),
        _flag(at_start).alias("admitatstart"),
        _flag(at_start & (F.col("in_until") >= F.col("end"))).alias("notdisch"),
        F.coalesce("n_year", F.lit(0)).alias("numyearadmit"),
        F.coalesce("n_month", F.lit(0)).alias("nummonthadmit"),
        F.coalesce("los_year", F.lit(0.0)).alias("daysyearadmit"),
    )


def unplanned_admissions(
    spine: DataFrame, encounters: DataFrame, planned_mark: str = PLANNED_MARK, bucket_days: int = 64
) -> DataFrame:
    """Side table: the admission rows behind ``admit = 1`` with their reason."""
    counted = encounters.where(F.col("admit_date").isNotNull() & lacks_text(F.col("drg"), planned_mark))
    during = spine.select(*KEYS, "start", "end").withColumn("_after_start", F.date_add("start", 1))
    return point_in_any_interval(
        counted, during, ["pid"], "admit_date", "_after_start", "end", bucket_days
    ).drop("_after_start")


def ed_visits(spine: DataFrame, visits: DataFrame, day: str = "ed_arrival_date") -> DataFrame:
    """Emergency visit during the course, days since the last one, counts over 30 and 365 days."""
    daily = by_day(visits, ["pid"], day, n=F.count(F.lit(1)))
    profile = timeline_profile(
        spine,
        daily,
        ["pid"],
        "start",
        [
            Measure("next_visit", "min", "day", after=True),
            Measure("last_visit", "max", "day"),
            Measure("n_month", "sum", "n", MONTH),
            Measure("n_year", "sum", "n", YEAR),
        ],
    )
    return spine.select(*KEYS, "start", "end").join(profile, ["pid", "start"], "left").select(
        *KEYS,
        _flag(F.col("next_visit") <= F.col("end")).alias("ed"),
        _days_since("last_visit").alias("lasted"),
        F.coalesce("n_month", F.lit(0)).alias("nummonthed"),
        F.coalesce("n_year", F.lit(0)).alias("numyeared"),
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _days_since(day: str) -> Column:
    return F.coalesce(F.datediff("start", day).cast("double"), F.lit(NEVER))


# --- vitals -----------------------------------------------------------------------------------

VITAL_COLUMNS = ("dbp", "sbp", "weight_kg", "bmi", "temp_c", "pulse", "spo2", "pain")


def vital_signs(spine: DataFrame, vitals: DataFrame, order: str = "source_order") -> DataFrame:
    """Extremes over the year before each course, latest weight and body-mass index (nulls kept)."""
    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))

    daily = by_day(
        vitals,
        ["pid"],
        "taken_date",
        weight=latest("weight_kg"),
        bmi=latest("bmi"),
        maxweight=F.max("weight_kg"),
        minsbp=F.min("sbp"),
        maxsbp=F.max("sbp"),
        mindbp=F.min("dbp"),
        maxdbp=F.max("dbp"),
        minpulse=F.min("pulse"),
        maxpulse=F.max("pulse"),
        minsat=F.min("spo2"),
        maxtemp=F.max("temp_c"),
        maxpain=F.max("pain"),
    )
    extremes = [c for c in daily.columns if c.startswith(("min", "max"))]
    profile = timeline_profile(
        spine,
        daily,
        ["pid"],
        "start",
        [Measure(c, c[:3], c, YEAR) for c in extremes]
        + [Measure("lastweight", "last", "weight", YEAR), Measure("lastbmi", "last", "bmi", YEAR)],
    )
    return (
        spine.select(*KEYS, "start")
        .join(profile, ["pid", "start"], "left")
        .withColumn("weightloss", (F.col("maxweight") - F.col("lastweight")) / F.nullif("maxweight", F.lit(0.0)))
        .drop("start")
    )


def abnormal_vitals(spine: DataFrame, vitals: DataFrame, order: str = "source_order") -> DataFrame:
    """Weight loss, worst pain and abnormality flags; what was not measured counts as normal."""
    v = vital_signs(spine, vitals, order)
    return v.select(
        *KEYS,
        F.coalesce("weightloss", F.lit(0.0)).alias("weightloss"),
        F.coalesce("maxpain", F.lit(0.0)).alias("maxpain"),
        _flag((F.col("minsbp") < 90) | (F.col("mindbp") < 60)).alias("hypo"),
        _flag((F.col("maxsbp") > 129) | (F.col("maxdbp") > 79)).alias("hyper"),
        _flag(F.col("maxpulse") > 100).alias("tachy"),
        _flag(F.col("minpulse") < 50).alias("brady"),
        _flag(F.col("minsat") < 90).alias("hypox"),
        _flag(F.col("maxtemp") >= 38).alias("fever"),
        _flag(F.col("maxpain") > 3).alias("pain"),
    )


# --- presence families ------------------------------------------------------------------------


def first_seen(spine: DataFrame, events: DataFrame, values: Iterable[str], day: str) -> DataFrame:
    """Values an entity had on or before the start of each course, without a lower time limit.

    Presence up to a day depends on the first date only, so events shrink to one row per (entity,
    value) ahead of the join, and each joined pair with an early enough date is a result row.
    """
    values = list(values)
    firsts = events.groupBy("pid", *values).agg(F.min(day).alias("_first"))
    met = spine.select(*KEYS, "start").join(firsts, "pid").where(F.col("_first") <= F.col("start"))
    return met.select(*KEYS, *values)


def prior_procedures(
    spine: DataFrame, events: DataFrame, name: str, day: str, family: str = "proc", prefix: str = "proc_"
) -> DataFrame:
    """Presence of each procedure category (or code description) before the course."""
    named = events.where(nonblank(F.col(name)))
    return long_features(first_seen(spine, named, [name], day), KEYS, family, prefix, name, unique=True)


def abnormal_labs(
    spine: DataFrame, labs: DataFrame, order: str = "source_order", bucket_days: int = 64
) -> DataFrame:
    """Labs flagged abnormal, in final status, in the 28 days up to the start; canonical names."""
    named = codes.canonical_names(labs, "test_name", "base_name", "test_description", order)
    abnormal = (
        named.where(nonblank(F.col("abnormal_flag")) & (F.col("status_code") == "F"))
        .select("pid", "specimen_date", "canonical")
        .distinct()
    )
    windows = _starts(spine).withColumn("_low", F.date_sub("start", LAB_DAYS))
    hits = (
        point_in_interval(abnormal, windows, ["pid"], "specimen_date", "_low", "start", bucket_days)
        .select("pid", "start", "canonical")
        .distinct()
    )
    return long_features(_to_courses(spine, hits), KEYS, "lab", "", "canonical", unique=True)


# --- medications ------------------------------------------------------------------------------


def _starts_within(spine: DataFrame, rows: DataFrame, values: Iterable[str]) -> DataFrame:
    """Distinct (pid, start, values): course starts of the same patient inside ``[low, high]``; a null end is open.

    Ends are cut to the days on which courses start at all, which loses no match and bounds the
    number of time buckets an interval can touch.
    """
    limits = spine.agg(F.struct(F.min("start").alias("first"), F.max("start").alias("last")).alias("l")).scalar()
    cut = rows.withColumns(
        {"_low": F.greatest("low", limits["first"]), "_high": F.least("high", limits["last"])}
    ).drop("low", "high")
    return days_in_intervals(_starts(spine), cut, ["pid"], values, "start", "_low", "_high")


def _state_rules() -> dict[str, tuple[Column, Column, Column]]:
    """State: (dates needed, first and last course start for which the order has it)."""
    begun, ended = F.col("start_date"), F.col("end_date")
    dated = begun.isNotNull() & ended.isNotNull()
    return {
        "recent": (dated, ended, F.date_add(begun, RECENT_DAYS)),
        "concurrent": (
            dated,
            F.date_sub(begun, CONCURRENT_AFTER),
            F.least(F.date_sub(ended, 1), F.date_add(begun, CONCURRENT_BEFORE)),
        ),
        "current": (dated, begun, F.date_sub(ended, 1)),
    }


def _order_intervals(orders: DataFrame, columns: list[str], rules: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    entries = [
        F.when(needed, F.struct(F.lit(state).alias("state"), low.alias("low"), high.alias("high")))
        for state, (needed, low, high) in rules.items()
    ]
    spread = orders.select(*columns, F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull())
    return spread.select(*columns, "e.state", "e.low", "e.high")


def drug_states(spine: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct (pid, start, drug_name, state) with state recent, concurrent or current.

    Recent: ended on or before the start and begun within 180 days of it. Concurrent: ends after
    the start and begun from 30 days before to 14 days after it. Current: begun on or before the
    start and ends after it. Each rule says that the course start lies in an interval given by the
    order; orders without an end date satisfy none.
    """
    intervals = _order_intervals(orders, ["pid", "drug_name"], _state_rules())
    return _starts_within(spine, intervals, ["drug_name", "state"]).select("pid", "start", "drug_name", "state")


AGENT_FAMILIES = ("recagent", "conagent", "recclass", "conclass")
CLASS_FAMILIES = ("recmed", "curmed")


def drug_features(
    spine: DataFrame,
    orders: DataFrame,
    dictionary: DataFrame,
    keyword: str = codes.AGENT_CLASS_KEYWORD,
    exclude: Iterable[str] = codes.EXCLUDED_INGREDIENTS,
    families: Iterable[str] = AGENT_FAMILIES + CLASS_FAMILIES,
) -> DataFrame:
    """Drug families in one pass over the orders.

    ``recagent`` / ``conagent`` and ``recclass`` / ``conclass``: recent and concurrent systemic agents
    and all their classes. ``recmed`` / ``curmed``: classes of all recent and all current drugs. A drug
    that the dictionary does not list counts under the class ``NA``. ``orders`` are read twice; the distinct classes are
    written to the shared folder while the plan is built.
    """
    families = list(families)
    classes = codes.drug_classes(dictionary)
    agents = codes.cohort_ingredients(classes, orders, keyword, exclude).withColumn("_agent", F.lit(True))
    known = materialise(classes.join(agents, "ingredient", "left"), "drug-classes")
    taken = drug_states(spine, orders).join(known, "drug_name", "left")

    def entry(family: str, state: str, prefix: str, name: str, agents_only: bool) -> Column:
        applies = F.col("state") == state
        if agents_only:
            applies = applies & F.col("_agent").isNotNull()
        feature = F.concat(F.lit(prefix), F.coalesce(F.col(name), F.lit("NA")))
        return F.when(applies, F.struct(F.lit(family).alias("family"), feature.alias("feature")))

    entries = {
        "recagent": entry("recagent", "recent", "rec_", "ingredient", True),
        "conagent": entry("conagent", "concurrent", "con_", "ingredient", True),
        "recclass": entry("recclass", "recent", "rec_", "class", True),
        "conclass": entry("conclass", "concurrent", "con_", "class", True),
        "recmed": entry("recmed", "recent", "rec_", "class", False),
        "curmed": entry("curmed", "current", "cur_", "class", False),
    }
    per_start = (
        taken.select("pid", "start", F.explode(F.array(*[entries[f] for f in families])).alias("e"))
        .where(F.col("e").isNotNull())
        .select("pid", "start", "e.family", "e.feature")
        .distinct()
    )
    return _to_courses(spine, per_start).select(*KEYS, "family", "feature", F.lit(1.0).alias("value"))


def systemic_agents(
    spine: DataFrame,
    orders: DataFrame,
    dictionary: DataFrame,
    keyword: str = codes.AGENT_CLASS_KEYWORD,
    exclude: Iterable[str] = codes.EXCLUDED_INGREDIENTS,
) -> DataFrame:
    """Recent and concurrent systemic agents and all their classes."""
    return drug_features(spine, orders, dictionary, keyword, exclude, AGENT_FAMILIES)


def any_agent(
    spine: DataFrame,
    orders: DataFrame,
    dictionary: DataFrame,
    keyword: str = codes.AGENT_CLASS_KEYWORD,
    exclude: Iterable[str] = codes.EXCLUDED_INGREDIENTS,
) -> DataFrame:
    """Per course with any agent order: whether one is concurrent and whether one is recent.

    Null, and not 0, where an undated or open-ended order leaves the answer unknown.
    """
    classes = codes.drug_classes(dictionary)
    agents = codes.cohort_ingredients(classes, orders, keyword, exclude)
    agent_drugs = keep_members(classes, agents, "ingredient").select("drug_name").distinct()
    mine = keep_members(orders, agent_drugs, "drug_name").select("pid", "start_date", "end_date").distinct()
    begun, ended = F.col("start_date"), F.col("end_date")
    no_end, no_begin = begun.isNotNull() & ended.isNull(), begun.isNull() & ended.isNotNull()
    # an order without one of its dates leaves a state open on one side of a day: the farthest such
    # day of a patient decides for all of its starts
    open_ended = mine.groupBy("pid").agg(
        F.max(F.when(no_begin, F.date_sub(ended, 1))).alias("_concurrent_until"),
        F.max(F.when(no_end, F.date_add(begun, RECENT_DAYS))).alias("_recent_until"),
        F.min(F.when(no_begin, ended)).alias("_recent_from"),
        F.max(begun.isNull() & ended.isNull()).alias("_undated"),
    )
    rules = {k: v for k, v in _state_rules().items() if k != "current"}
    rules["concurrent?"] = (no_end, F.date_sub(begun, CONCURRENT_AFTER), F.date_add(begun, CONCURRENT_BEFORE))
    held = _starts_within(spine, _order_intervals(mine, ["pid"], rules), ["state"])
    known = held.groupBy("pid", "start").agg(
        *[F.max(F.col("state") == state).alias(name) for name, state in (("_con", "concurrent"), ("_rec", "recent"), ("_con_open", "concurrent?"))]
    )
    starts = _starts(spine).join(open_ended, "pid").join(known, ["pid", "start"], "left")
    no = F.lit(False)
    start = F.col("start")
    concurrent_unknown = F.col("_undated") | F.coalesce("_con_open", no) | F.coalesce(start <= F.col("_concurrent_until"), no)
    recent_unknown = (
        F.col("_undated") | F.coalesce(start <= F.col("_recent_until"), no) | F.coalesce(start >= F.col("_recent_from"), no)
    )
    per_start = starts.select(
        "pid",
        "start",
        F.when(~concurrent_unknown, _flag(F.coalesce("_con", no))).alias("concurrent"),
        F.when(~recent_unknown, _flag(F.coalesce("_rec", no))).alias("recent"),
    )
    return _to_courses(spine, per_start)


def medication_classes(spine: DataFrame, orders: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Classes of all recent and of all current drugs."""
    return drug_features(spine, orders, dictionary, families=CLASS_FAMILIES)


# --- diagnoses and history --------------------------------------------------------------------


def _codes_of(listed: DataFrame, separator: str, max_slots: int | None) -> DataFrame:
    """One row per code of each list, without dots."""
    slots = explode_codes(listed, "diagnosis_list", separator, "code", max_slots)
    return slots.withColumn("code", strip_dots(F.col("code")))


def course_diagnoses(
    cohort: DataFrame,
    charges: DataFrame,
    crosswalk: DataFrame,
    subchapters: DataFrame,
    terms: DataFrame,
    short_terms: DataFrame | None = None,
    separator: str = " ,",
    max_slots: int | None = None,
    on: str | Iterable[str] = "mrn",
    bucket_days: int = 64,
) -> DataFrame:
    """Diagnosis and sub-chapter indicators from the code lists of a course's charges.

    Every code of a list counts; ``max_slots`` keeps only the leading ones. ``charges`` are read twice; the names of the
    distinct codes are written to the shared folder while the plan is built.

    Distinct days of the charges meet distinct date ranges of the patient. Charges of a day within a range give their codes,
    which become names per distinct (day, code); these meet the day's ranges, and only the names found in a range are spread over
    its courses: each step is bounded by calendar and vocabulary, however many charges or courses a patient has, and most
    charges, which are in no range, leave before their codes do.
    """
    on = [on] if isinstance(on, str) else list(on)
    ids = list(dict.fromkeys([*on, "pid"]))
    keys, day = [*on, "start", "end"], [*on, "service_date"]
    held = point_in_any_interval(
        charges.select(*day).distinct(), cohort.select(*keys).distinct(), on, "service_date", "start", "end", bucket_days
    )
    listed = charges.select(*ids, "service_date", "diagnosis_list")
    every_code = _codes_of(listed, separator, max_slots).select("code").distinct()
    per_day = _codes_of(keep_members(listed, held.select(*day), day), separator, max_slots).distinct()
    # the distinct codes get their names, and these meet the rows once
    mapped = codes.map_codes(every_code, "code", crosswalk, "code9", "code10")
    rolled = mapped.withColumn("category", codes.roll_up(F.col("code_mapped")))
    described = codes.describe_codes(rolled, "category", terms, short_terms)
    named = codes.label_subchapter(described, "code_mapped", subchapters)
    features = F.array(
        *[
            F.struct(F.lit(family).alias("family"), F.concat(F.lit(f"{family}_"), F.col(c)).alias("feature"))
            for family, c in (("coursedx", "description"), ("coursesub", "sub_chapter"))
        ]
    )
    named = materialise(named.select("code", features.alias("_names")), "code-names")
    per_day_names = per_day.join(named, "code").select(*ids, "service_date", F.inline("_names")).distinct()
    per_range = per_day_names.join(held, day).select(*dict.fromkeys([*keys, "pid"]), "family", "feature").distinct()
    # A course can have several ranges (merged ids), hence the last distinct.
    return (
        cohort.select(*keys, "course")
        .distinct()
        .join(per_range, keys)
        .select(*KEYS, "family", "feature")
        .distinct()
        .withColumn("value", F.lit(1.0))
    )


def history_codes(
    problems: DataFrame,
    diagnoses: DataFrame,
    crosswalk: DataFrame,
    separator: str = ", ",
    max_slots: int | None = None,
) -> DataFrame:
    """``(pid, date, three_digit)``, first dates only, from problem lists and both diagnosis code sets."""
    listed = problems.select(
        "pid", F.coalesce("noted_date", "entered_date").alias("date"), "icd10_list"
    )
    problem = explode_codes(listed, "icd10_list", separator, "code", max_slots)
    coded = diagnoses.where(nonblank(F.col("code")))
    ten = coded.where(F.col("code_set") == "ICD-10-CM").select("pid", "date", "code")
    nine = (
        coded.where(F.col("code_set") == "ICD-9-CM")
        .groupBy("pid", strip_dots(F.col("code")).alias("code"))
        .agg(F.min("date").alias("date"))
    )
    # the distinct codes are mapped and written, and meet the rows once
    known = codes.map_codes(
        nine.select("code").distinct(), "code", crosswalk, "code9", "code10", last_nine=True, keep_unmatched=False
    )
    known = materialise(known.select("code", "code_mapped"), "history-codes")
    mapped = nine.join(known, "code").select("pid", "date", F.col("code_mapped").alias("code"))
    return (
        problem.unionByName(ten)
        .unionByName(mapped)
        .groupBy("pid", F.substring("code", 1, 3).alias("three_digit"))
        .agg(F.min("date").alias("date"))
    )


def past_history(
    spine: DataFrame,
    history: DataFrame,
    subchapters: DataFrame | None = None,
    terms: DataFrame | None = None,
) -> DataFrame:
    """History before the course as sub-chapters and / or as diagnosis descriptions.

    ``history`` comes from ``history_codes``; codes outside the given dictionaries are dropped.
    """
    parts = []
    if subchapters is not None:
        known = codes.label_subchapter(history, "three_digit", subchapters, unmatched=None)
        seen = first_seen(spine, known, ["sub_chapter"], "date")
        parts.append(long_features(seen, KEYS, "pmhsub", "", "sub_chapter", unique=True))
    if terms is not None:
        found = codes.describe_codes(history.select("three_digit").distinct(), "three_digit", terms, unmatched=None)
        known = history.join(materialise(found, "history-terms"), "three_digit")
        seen = first_seen(spine, known, ["description"], "date")
        parts.append(long_features(seen, KEYS, "pmhdx", "", "description", unique=True))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# --- social history and demographics ----------------------------------------------------------


def social_history(
    spine: DataFrame,
    social: DataFrame,
    day: str = "reported_date",
    fields: Iterable[str] = SOCIAL_FIELDS,
    latest_only: bool = False,
    order: str = "source_order",
) -> DataFrame:
    """Answers reported up to the start of each course; every course appears, unknowns spelled out.

    By default each distinct set of answers is a row. ``latest_only`` keeps the last reported set.
    """
    fields = list(fields)
    if latest_only:
        answers = F.struct(*fields)
        daily = by_day(social, ["pid"], day, answers=F.max_by(answers, F.col(order)))
        latest = timeline_profile(spine, daily, ["pid"], "start", [Measure("answers", "last", "answers")])
        known = _to_courses(spine, latest).select(*KEYS, *[F.col(f"answers.{f}").alias(f) for f in fields])
    else:
        known = first_seen(spine, social, fields, day)
    filled = backfill(spine, known, KEYS)
    return filled.withColumns({f: recode_tokens(F.col(f), NO_ANSWER, UNKNOWN) for f in fields})


def zip_areas(addresses: DataFrame, width: int = 5) -> DataFrame:
    """Leading characters of the postal code per patient."""
    return addresses.select("pid", F.substring("postal_code", 1, width).alias("zip"))


def demographics(patients: DataFrame) -> DataFrame:
    return patients.select("pid", "mrn", "dob", "race", "ethnic_group", "marital_status", "religion").distinct()
