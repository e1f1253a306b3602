"""Each query against its SQL twin, over the smallest tables; what SQL can't say, against numpy."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import aggregate, linalg, metrics, strategies
from larkspur.plans import catalog, clients  # noqa: F401  (registers its queries)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    rel = db.sql(catalog.ORACLE_SQL[name])
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[k] for k in order) for r in rel.fetchall()), key=str)


def test_trim_ratio_is_checked(spark):
    with pytest.raises(ValueError):
        aggregate.trim(spark.range(1), 0.5)


def test_svd_equals_numpy(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    x = np.array([r[0] for r in rows.select("embedding").collect()], float)
    values, _ = linalg.svd(rows, "embedding", 64, 5)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:5])


def test_masks_cancel_and_are_orthogonal(spark):
    cells = [(c, 0, p, float(c * 7 + p) / 3) for c in range(5) for p in range(6)]
    param = spark.createDataFrame(cells, "client_id long, layer int, pos int, value double")
    got = {r["pos"]: r["value"] for r in strategies.unmasked_sum(strategies.masked(param, strategies.pair_seeds(param, "s"))).collect()}
    assert all(abs(got[p] - sum(x[3] for x in cells if x[2] == p)) < 1e-3 for p in range(6))
    m = linalg.block_masks(spark, 7, 3)
    eye = {(r["row"], r["col"]): r["value"] for r in linalg.multiply(m, linalg.transpose(m)).collect()}
    assert all(abs(v - (i == j)) < 1e-9 for (i, j), v in eye.items())


def test_config_difference(spark):
    rows = [(run, k, v) for run, c in (("a", {"x": {"lr": 1, "b": None}}), ("b", {"x": {"lr": 2, "b": None}})) for k, v in metrics.flatten_config(c)]
    assert [r[0] for r in metrics.differing_keys(spark.createDataFrame(rows, "run_id string, key_chain string, value string")).collect()] == ["x$$lr"]


def test_sketch_finds_heavy_keys(spark):
    vector = spark.range(200).select(F.col("id").alias("key"), F.when(F.col("id") < 3, 1000.0).otherwise(1.0).alias("value"))
    assert {r["key"] for r in strategies.unsketch(strategies.sketch(vector), vector.select("key"), 3).collect()} == {0, 1, 2}


def test_sketch_rounds(spark):
    """Sketches are linear: their weighted mean is the mean's sketch; error keeps what a round didn't send."""
    cells = [(c, k, float((c + 1) * (50 if k < 2 else 1))) for c in range(3) for k in range(40)]
    clients = spark.createDataFrame(cells, "client_id long, key long, value double")
    sizes = spark.createDataFrame([(0, 1), (1, 2), (2, 5)], "client_id long, n_train long")
    parts = [strategies.sketch(clients.where(F.col("client_id") == c)).withColumn("client_id", F.lit(c).cast("long")) for c in range(3)]
    mean = strategies.sketch_mean(parts[0].unionByName(parts[1]).unionByName(parts[2]), sizes).cache()
    plain = clients.join(sizes, "client_id").groupBy("key").agg((F.sum(F.col("value") * F.col("n_train")) / 8).alias("value"))
    table = lambda t: {(r["row"], r["bucket"]): r["value"] for r in t.collect()}
    got, want = table(mean), table(strategies.sketch(plain))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    update, momentum, error = strategies.sketch_step(mean, plain.select("key"), 2)
    update = update.cache()
    assert {r["key"] for r in update.collect()} == {0, 1}
    _, again, after = strategies.sketch_step(mean, plain.select("key"), 2, momentum, error)
    assert all(abs(v - 1.9 * got[k]) < 1e-9 for k, v in table(again).items())
    left, sent = table(error), table(strategies.sketch(update))
    assert all(abs(v - (got[k] - sent.get(k, 0.0))) < 1e-9 for k, v in left.items()) and after.count() == len(got)


@pytest.mark.parametrize("size", [12, 14])
def test_spectral_clip_equals_numpy(spark, size):
    rng = np.random.default_rng(3)
    own, host = rng.normal(size=(3, 2, size)), rng.normal(size=(2, size))
    param = spark.createDataFrame([(c, y, p, float(own[c, y, p])) for c in range(3) for y in range(2) for p in range(size)], "client_id long, layer int, pos int, value double")
    server = spark.createDataFrame([(y, p, float(host[y, p])) for y in range(2) for p in range(size)], "layer int, pos int, value double")
    want = host.copy()
    for c in range(3):
        for y in range(2):
            d = own[c, y] - host[y]
            norm = np.linalg.norm(np.pad(d, (0, -size % 4)).reshape(-1, 4), 2)
            want[y] += d / max(1.0, norm / 0.5)
    got = {(r["layer"], r["pos"]): r["value"] for r in aggregate.norm_clip_spectral(param, server, 0.5, 4).collect()}
    assert len(got) == want.size and all(abs(v - want[k]) < 1e-9 for k, v in got.items())
