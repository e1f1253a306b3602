import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from larkspur import ship

    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    ship(session)
    return session


@pytest.fixture(scope="session")
def twins(spark):
    """Runs a query and its SQL over the smallest tables and compares the rows."""
    import glob

    import duckdb

    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    queries, sql = entry.queries(), entry.oracle_sql()

    def compare(name):
        df = queries[name](spark, data)
        columns = sorted(df.columns)
        got = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
        assert got
        if name in sql:
            rel = db.sql(sql[name])
            order = [rel.columns.index(c) for c in columns]
            assert got == sorted((tuple(r[k] for k in order) for r in rel.fetchall()), key=str)
        for flag in {"recovered", "hidden"} & set(columns):
            assert all(r[columns.index(flag)] for r in got)

    return compare
