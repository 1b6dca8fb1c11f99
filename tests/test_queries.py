import pytest
from oracle import DATA, rows_of, rows_of_sql

from stratagraph.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert rows_of(Q.QUERIES[name](spark, str(DATA))) == rows_of_sql(Q.ORACLES[name])


def test_entry_has_a_query_for_every_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(Q.QUERIES) <= set(e.queries())


def test_json_report(spark):
    import json

    rows = Q.reports(spark, str(DATA)).collect()
    assert rows and all({"score", "violations", "package_metrics", "patterns"} <= set(json.loads(r.report)) for r in rows)
