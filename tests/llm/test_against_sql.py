"""Queries that SQL can express give the same rows."""

import __spark_entry__ as entry
import pytest
from helpers import DATA, duck, rows_of, rows_of_sql

from spanfold.llm.oracles import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    frame = entry.queries()[name](spark, DATA)
    names, wanted = rows_of_sql(duck(), SQL[name])
    assert sorted(frame.columns) == names
    assert rows_of(frame) == wanted
