from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from quire.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.streaming.stateStore.stateSchemaCheck": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def heavy(spark):
    """Every input counts as large and every key as heavy."""
    spark.conf.set("quire.taskBytes", "0")
    spark.conf.set("quire.taskRows", "3")
    yield
    spark.conf.unset("quire.taskBytes")
    spark.conf.unset("quire.taskRows")


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(v) for v in r))
