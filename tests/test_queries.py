"""Every query of the engine gives the rows of its SQL."""

import __spark_entry__ as entry
import pytest
from helpers import DATA, duck, rows_of, rows_of_sql

from spanfold.plans.oracles import SQL
from spanfold.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    frame = entry.queries()[name](spark, DATA)
    names, wanted = rows_of_sql(duck(), SQL[name])
    assert sorted(frame.columns) == names
    assert rows_of(frame) == wanted
    assert wanted


def test_entry_gives_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_views_answer_sql(spark):
    from spanfold.plans.views import register_views

    assert set(register_views(spark, DATA)) == {"tx_features", "refs", "zonemap", "queries", "scores"}
    row = spark.sql("SELECT count(*) AS n, sum(z.n) AS refs FROM zonemap z").first()
    assert row.refs == spark.table("refs").count() and row.n > 1
    assert spark.sql("SELECT count(*) FROM scores s JOIN queries q USING (query_id)").first()[0] == spark.table("queries").count()
