import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hearthgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("stage")),
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


T0 = datetime(2024, 1, 1)


def at(hours: float) -> datetime:
    return T0 + timedelta(hours=hours)


@pytest.fixture(scope="session")
def series(spark):
    """``series(values, first_hour)``: hourly load frame of one device; None is NULL."""

    def make(values, first_hour=0, household=1, device="Dishwasher"):
        rows = [
            (household, device, at(first_hour + i), None if v is None else float(v))
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(
            rows, "household_id int, device string, ts timestamp_ntz, load double"
        )

    return make
