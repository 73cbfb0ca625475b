import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from prepkit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "prepkit-tests", "4g", tempfile.mkdtemp(prefix="prepkit-tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def numbers(spark):
    """A one-column table of doubles from a list."""
    return lambda values, name="x": spark.createDataFrame([(v,) for v in values], f"{name} double")


@pytest.fixture
def texts(spark):
    return lambda values, name="k": spark.createDataFrame([(v,) for v in values], f"{name} string")


def by_column(df):
    return {r["column_name"]: r.asDict() for r in df.collect()}


def column(df, name, order=None):
    rows = df.orderBy(order).collect() if order else df.collect()
    return [r[name] for r in rows]
