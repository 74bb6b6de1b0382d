import pytest

from contract import connect, rows
from verbatlas.queries import exchange, general, reference

DATA = "/root/testdata/sf0.001"
SQL = general.oracle_sql() | reference.oracle_sql() | exchange.oracle_sql()
QUERIES = general.queries() | reference.queries() | exchange.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), connect(DATA).execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_stream(spark, tmp_path):
    from verbatlas.streaming import ingest

    v = spark.read.parquet(f"{DATA}/project_verbatims.parquet")
    v.limit(50).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(v.schema).parquet(f"{tmp_path}/in")
    q = ingest.clean_stream(stream).select("ord", "full_text_clean").writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned").count() == 50
