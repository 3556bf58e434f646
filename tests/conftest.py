import os
import sys
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from knownby.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def series(spark, columns, key="a"):
    """A daily series from 2024-01-01 with one list per column."""
    from datetime import date, timedelta

    names = list(columns)
    rows = [
        (key, date(2024, 1, 1) + timedelta(days=i), *[None if v is None else float(v) for v in values])
        for i, values in enumerate(zip(*[columns[n] for n in names]))
    ]
    fields = "security_id string, session_date date, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, fields)


def column(df, name, order="session_date"):
    return [r[name] for r in df.orderBy(order).collect()]


def close_to(values, expected, tolerance=1e-9):
    assert len(values) == len(expected)
    for got, want in zip(values, expected):
        if want is None:
            assert got is None
        else:
            assert got == pytest.approx(want, abs=tolerance)
