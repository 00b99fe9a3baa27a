"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from quire.registry import oracles, queries
from tests.conftest import SF_DIR
from tools.check_oracle import compare, connect, type_note


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    found = [tuple(r) for r in df.collect()]
    sql = oracles().get(name)
    if sql is None:
        assert df.columns
        return
    relation = duck.sql(sql)
    assert compare(df.columns, found, relation.columns, relation.fetchall()) is None
    assert type_note(df, relation) == ""
