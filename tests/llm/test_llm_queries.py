import pytest

from contract import connect, rows
from verbatlas.llm import queries as Q

DATA = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    a, b = Q.queries()[name](spark, DATA).toPandas(), connect(DATA).execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_runs(spark, name):
    Q.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()
