import sys
import tempfile
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from coursemill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[*]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="coursemill-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def day():
    """``day(n)``: n days after the first of June 2015, the usual course start."""
    from datetime import timedelta

    return lambda n=0: date(2015, 6, 1) + timedelta(days=n)


@pytest.fixture
def one_course(spark, day):
    """Patient 1, course A, days 0 to 30; patient 2, course B, without any events."""
    return spark.createDataFrame(
        [(1, "A", day(0), day(30)), (2, "B", day(0), day(30))], "pid int, course string, start date, end date"
    )


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted([tuple(r) for r in picked.collect()], key=str)
