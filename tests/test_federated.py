"""Client datasets and sinks against SQL or numpy."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.plans import catalog, federated
from larkspur.sources import datasets, sinks

DATA = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == federated.__name__]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    if name in catalog.ORACLE_SQL:
        rel = db.sql(catalog.ORACLE_SQL[name])
        order = [rel.columns.index(c) for c in columns]
        assert got == sorted((tuple(r[k] for k in order) for r in rel.fetchall()), key=str)
    else:
        assert got
    if "recovered" in columns:
        assert all(r[columns.index("recovered")] for r in got)


def test_user_json_and_missing_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"users": ["u"], "user_data": {"u": {"x": ["ab", "c"], "y": ["1", "2"]}}}))
    assert sorted(tuple(r) for r in datasets.user_json(spark, str(tmp_path / "a.json")).collect()) == [("u", 0, "ab", "1"), ("u", 1, "c", "2")]
    out = str(tmp_path / "trials")
    for n in (3, 5, 5):
        sinks.append_missing(spark.range(n), out, ["id"])
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_client_files(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") % 3).alias("client_id"), F.lit("train").alias("split"))
    sinks.write_clients(rows, str(tmp_path / "c"))
    assert sorted(r["id"] for r in sinks.read_client(spark, str(tmp_path / "c"), 1).collect()) == [1, 4, 7]


def test_hashtags_and_capitals(spark):
    rows = spark.createDataFrame([("a #BIG b",), ("#myBigDay",), ("# x",), (None,)], "t string")
    got = [r[0] for r in rows.select(text.tag_hashtags(F.col("t"))).collect()]
    assert got == ["a  <hashtag> big <allcaps>  b", " <hashtag> my big day", "# x", None]
    assert rows.limit(1).select(text.tag_capitals(F.lit("so LOUD i"))).first()[0] == "so loud <allcaps>  i"
    assert rows.limit(1).select(text.char_ids(F.lit("ba?"), "ab")).first()[0] == [1, 0, None]
