"""Blocks, factors and masks against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import blocks, factor, masking
from larkspur.plans import catalog, matrices
from larkspur.sources import datasets

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == matrices.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, twins, name):
    twins(name)


def cells_of(spark, x, extra=()):
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame([*rows, *extra], "row long, col long, value double").repartition(5)


def dense(cells, shape):
    out = np.zeros(shape)
    for r in cells.collect():
        out[r["row"], r["col"]] += r["value"]
    return out


def test_blocks_of_sparse_cells(spark):
    x = np.random.default_rng(1).normal(size=(37, 23)) * (np.random.default_rng(2).random((37, 23)) < 0.3)
    b = blocks.from_cells(cells_of(spark, x), 10, 7, 37, 23)
    assert {(r["rows"], r["cols"]) for r in b.collect()} == {(10, 7), (7, 7), (10, 2), (7, 2)}
    assert (dense(blocks.to_cells(b, 10, 7), x.shape) == x).all()
    assert (dense(blocks.to_cells(blocks.transpose(b), 7, 10), x.T.shape) == x.T).all()
    with pytest.raises(Exception, match="outside"):
        blocks.from_cells(cells_of(spark, x), 10, 7, 36, 23).count()
    assert blocks.from_cells(cells_of(spark, x).limit(0), 10, 7, 37, 23).count() == 0
    twice = blocks.from_cells(cells_of(spark, x).unionByName(cells_of(spark, x)), 10, 7, 37, 23)
    assert np.allclose(dense(blocks.to_cells(twice, 10, 7), x.shape), 2 * x)


@pytest.mark.parametrize("segment", [1, 3, 50])
def test_products_of_named_blocks(spark, segment):
    rng = np.random.default_rng(segment)
    xs, ys = rng.normal(size=(2, 21, 34)), rng.normal(size=(2, 34, 9))
    both = lambda ms: cells_of(spark, ms[0]).withColumn("who", F.lit("a")).unionByName(cells_of(spark, ms[1]).withColumn("who", F.lit("b")))
    a, b = blocks.from_cells(both(xs), 5, 6, 21, 34, ["who"]), blocks.from_cells(both(ys), 6, 4, 34, 9, ["who"])
    made = blocks.to_cells(blocks.multiply(a, b, ["who"], segment), 5, 4, ["who"])
    for k, who in enumerate("ab"):
        assert np.allclose(dense(made.where(F.col("who") == who), (21, 9)), xs[k] @ ys[k])


def test_shuffled_rows_grow_with_blocks(spark):
    x = cells_of(spark, np.random.default_rng(0).normal(size=(64, 64)))
    a = blocks.from_cells(x, 16, 16, 64, 64)
    # 16 blocks, each copied to 4 cells of the grid on either side: 128 rows instead of 64**3 products of cells.
    assert a.count() == 16 and blocks.multiply(a, a).count() == 16


def test_serialised_blocks(spark):
    b = blocks.from_cells(cells_of(spark, np.arange(12.0).reshape(3, 4)), 2, 3, 3, 4)
    texts = blocks.serialised(b, blocks.PLACE)
    assert sorted(map(tuple, blocks.restored(texts, blocks.PLACE).collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(Exception, match="digest"):
        blocks.restored(texts.withColumn("sha256", F.lit("0")), blocks.PLACE).count()
    with pytest.raises(ValueError):
        blocks.decode(blocks.encode(1, 2, b"\0" * 16)[:-4])
    assert blocks.decode(blocks.encode(0, 3, b"")) == (0, 3, b"")


def test_flat_vectors(spark):
    tensors = spark.createDataFrame([(c, layer, p, 100.0 * c + 10 * layer + p) for c in range(2) for layer, n in enumerate((3, 1, 5)) for p in range(n)], "client_id int, layer int, pos long, value double")
    layers = datasets.flat_offsets(spark.createDataFrame([(0, 3), (1, 1), (2, 5)], "layer int, size int"))
    chunks = blocks.flat_chunks(tensors, layers, 4, ["client_id"])
    assert chunks.count() == 6
    assert sorted(map(tuple, blocks.from_flat(chunks, layers, 4, ["client_id"]).collect())) == sorted(map(tuple, tensors.collect()))


def rows_of(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>").repartition(7)


@pytest.mark.parametrize("condition", [1e2, 1e10])
def test_tall_factors_keep_the_condition(spark, condition):
    rng = np.random.default_rng(5)
    u, v = np.linalg.qr(rng.normal(size=(500, 12)))[0], np.linalg.qr(rng.normal(size=(12, 12)))[0]
    x = u * np.geomspace(1, 1 / condition, 12) @ v.T
    tall = blocks.from_rows(rows_of(spark, x), "k", "v", 30, 500, 12)
    got_u, s, right = factor.svd(tall)
    got_u = dense(blocks.to_cells(got_u, 30, 12), (500, 12))
    assert np.allclose(s, np.geomspace(1, 1 / condition, 12), rtol=1e-4, atol=1e-15)
    assert np.allclose(got_u.T @ got_u, np.eye(12), atol=1e-12)
    assert np.allclose(got_u * s @ right.T, x, atol=1e-14)


def test_factors_of_low_rank_few_rows_and_none(spark):
    rng = np.random.default_rng(6)
    low = rng.normal(size=(90, 3)) @ rng.normal(size=(3, 8))
    for x, rank in ((low, 3), (low[:5], 3), (np.zeros((4, 8)), 0)):
        u, s, right = factor.svd(blocks.from_rows(rows_of(spark, x), "k", "v", 20, len(x), 8))
        assert len(s) == rank
        made = dense(blocks.to_cells(u, 20, 8), (len(x), max(rank, 1)))[:, :rank]
        assert np.allclose(made * s @ right.T, x)
    assert len(factor.svd(blocks.from_rows(rows_of(spark, low).limit(0), "k", "v", 20, 0, 8))[1]) == 0


def test_leading_factors_of_a_wide_matrix(spark):
    rng = np.random.default_rng(7)
    x = np.linalg.qr(rng.normal(size=(60, 60)))[0] * np.geomspace(1, 1e-6, 60) @ np.linalg.qr(rng.normal(size=(300, 60)))[0].T
    u, s, v = factor.leading(blocks.from_cells(cells_of(spark, x), 25, 40, 60, 300), 5)
    want = np.linalg.svd(x, compute_uv=False)[:5]
    assert np.allclose(s, want, rtol=1e-8)
    v = dense(blocks.to_cells(v, 40, 15), (300, 15))[:, :5]
    u = dense(blocks.to_cells(u, 25, 15), (60, 15))[:, :5]
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-10) and np.allclose(u.T @ x @ v, np.diag(s), atol=1e-8)


@pytest.mark.parametrize("owners,width", [(1, 6), (3, 4), (5, 5)])
def test_owners_recover_their_parts(spark, owners, width):
    x = np.random.default_rng(owners).normal(size=(40, 11))
    own = masking.split_columns(cells_of(spark, x), 11, owners)
    grid = spark.createDataFrame([(k, i, j, 0.0) for k in range(owners) for i in range(0, 40, 8) for j in range(0, 11, width)], "owner int, row long, col long, value double")
    own = blocks.from_cells(own.select("owner", "row", "col", "value").unionByName(grid), 8, width, 40, 11, ["owner"])
    seen = masking.server_sum(masking.with_noise(masking.masked(own, 1, 2, ["owner"]), owners, "s"))
    p = np.zeros((40, 40))
    for k in range(5):
        p[k * 8 : k * 8 + 8, k * 8 : k * 8 + 8] = masking.orthogonal(8, 1, k)
    q = np.zeros((11, 11))
    for k in range(-(-11 // width)):
        n = min(width, 11 - k * width)
        q[k * width : k * width + n, k * width : k * width + n] = masking.orthogonal(n, 2, k)
    server = dense(blocks.to_cells(seen, 8, width), x.shape)
    assert np.allclose(server, p @ x @ q)
    u, s, vt = np.linalg.svd(server, full_matrices=False)
    bounds = masking.owned_columns(11, owners)
    v = blocks.from_cells(cells_of(spark, vt.T), width, 11, 11, 11)
    found = masking.uncovered(masking.answered(v, masking.covered_right(spark, bounds, 11, width, 2, 3)), bounds, 11, width, 3)
    got = np.zeros((11, 11))
    for r in found.collect():
        assert bounds[r["owner"]][0] <= r["col"] < bounds[r["owner"]][1]
        got[r["col"], r["k"]] = r["value"]
    assert np.allclose(p.T @ u * s @ got.T, x)
    # Another cover gives something else: what the server returns is of no use without it.
    wrong = masking.uncovered(masking.answered(v, masking.covered_right(spark, bounds, 11, width, 2, 3)), bounds, 11, width, 4)
    assert not np.allclose(sorted(r["value"] for r in wrong.collect()), sorted(got.ravel()))


def test_batches_of_blocks_are_bounded(spark):
    """A kernel gets a few MB of blocks at a time, however many a task has."""
    found = spark.range(600).repartition(1).select(F.col("id").alias("block_row"), F.lit(0).cast("long").alias("block_col"), F.lit(256).alias("rows"), F.lit(8).alias("cols"), F.expr("cast(repeat('0', 16384) as binary)").alias("data"))
    sizes = blocks.mapped(found, lambda keys, m: [np.full((1, 1), len(m)) for _ in m])
    assert max(r["value"] for r in blocks.to_cells(sizes, 1, 1).collect()) < 400
