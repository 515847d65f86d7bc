from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from questloom.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    ship_package()
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def path(spark):
    """Fresh paths in the shared folder of the session."""
    from questloom.session import new_path

    return lambda name="t": new_path(spark, name)


def rows(df, *columns):
    """The rows of a small result as sorted tuples."""
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())
