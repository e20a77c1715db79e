"""Every query with SQL gives the rows that DuckDB gives."""

import math
import zipfile

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_agrees_with_sql(spark, tables, name):
    found = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(found.columns)
    known = tables.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in known.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    rows = sorted(repr(tuple(map(plain, r))) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in known.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_every_query_is_callable():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_source_is_sent_once(spark):
    from pyspark import SparkFiles

    from unitloom.ship import ship

    for _ in range(2):
        ship(spark)
    assert sum(f.endswith("unitloom.zip") for f in spark.sparkContext.listFiles) == 1
    with zipfile.ZipFile(SparkFiles.get("unitloom.zip")) as sent:
        assert {"unitloom/__init__.py", "unitloom/operators/graph.py"} <= set(sent.namelist())


def test_batches_for_python_are_bounded(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from unitloom.ship import _BATCH, BATCH_BYTES, prepare

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    own = spark.newSession()
    prepare(own)
    texts = own.range(300).repartition(1).select(F.repeat(F.lit("long text "), 10_000).alias("text"))
    found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 1 and max(found) < 1.5 * BATCH_BYTES
    own.conf.set(_BATCH, "1m")
    prepare(own)
    assert own.conf.get(_BATCH) == "1m"
