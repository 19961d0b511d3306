import re

import pytest

from __spark_entry__ import entry
from checks import ORACLE, QUERIES
from tests.oracle import DATA, connect, spark_rows, sql_rows

FOLDER = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    expected = ORACLE.get(name)
    assert expected, f"{name} has no SQL"
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|CartesianProduct|NestedLoop", plan)
    names, rows = spark_rows(df)
    sql_names, wanted = sql_rows(duck, expected)
    assert names == sql_names
    assert len(rows) > 0
    assert rows == wanted


def test_entry(spark):
    assert entry(spark).count() == 4
