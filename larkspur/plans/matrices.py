"""Queries over matrices in blocks, their factors and masks; registered beside those of the catalog."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import blocks, factor, masking
from larkspur.plans.catalog import query
from larkspur.sources import datasets
from larkspur.sources.tables import client_params, read

_WIDTH = 64
_CELLS = "cells as (select vec_id as row, k - 1 as col, cast(embedding[k] as double) as value from embeddings, (select unnest(range(1, 65)) as k))"
_SAME = f"with {_CELLS} select row, col, round(value, 5) as value from cells"


def _vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v, v.agg(F.max("vec_id").alias("n")).first()["n"] + 1


def _tall(spark, sf_dir, height: int = 256):
    v, n = _vectors(spark, sf_dir)
    return blocks.from_rows(v, "vec_id", "embedding", height, n, _WIDTH), n


def _cells(spark, sf_dir):
    v, n = _vectors(spark, sf_dir)
    return v.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value")).withColumn("value", F.col("value").cast("double")), n


def _rounded(cells, digits: int = 5):
    return cells.select("row", "col", F.round("value", digits).alias("value"))


@query(f"with {_CELLS} select row, col, value from cells")
def p15_cells_through_blocks(spark, sf_dir):
    """Cells to blocks of 100 x 24 (ragged at both edges) and back."""
    cells, n = _cells(spark, sf_dir)
    return blocks.to_cells(blocks.from_cells(cells, 100, 24, n, _WIDTH), 100, 24)


@query("""with param as (select vec_id % 8 as client_id, cast((k - 1) // 16 as int) as layer, cast((k - 1) % 16 as int) as pos, avg(cast(embedding[k] as double)) as value
from embeddings, (select unnest(range(1, 65)) as k) group by all) select client_id, layer, cast(pos as bigint) as pos, round(value, 9) as value from param""")
def p15_k13_flat_tensors(spark, sf_dir):
    """Clients' layers to one flat vector in chunks, these as text with digests, and all the way back."""
    param, _ = client_params(spark, sf_dir)
    layers = datasets.flat_offsets(param.groupBy("layer").agg((F.max("pos") + 1).alias("size")))
    chunks = blocks.flat_chunks(param, layers, 24, ["client_id"])
    keys = ["client_id", *blocks.PLACE]
    again = blocks.restored(blocks.serialised(chunks, keys), keys)
    return blocks.from_flat(again, layers, 24, ["client_id"]).select("client_id", "layer", "pos", F.round("value", 9).alias("value"))


@query(f"with {_CELLS} select a.col as row, b.col as col, round(sum(a.value * b.value), 5) as value from cells a join cells b using (row) group by all")
def j17_block_product(spark, sf_dir):
    """X' X as a product of blocks: 24 features wide, 200 rows to a block, four blocks of the inner dimension to a segment."""
    cells, n = _cells(spark, sf_dir)
    x = blocks.from_cells(cells, 200, 24, n, _WIDTH)
    return _rounded(blocks.to_cells(blocks.multiply(blocks.transpose(x), x, segment=4), 24, 24))


@query(_SAME)
def l9_tall_factors(spark, sf_dir):
    """U S V' by the tree of QRs gives the table again."""
    tall, _ = _tall(spark, sf_dir)
    return _rounded(blocks.to_cells(factor.rebuilt(*factor.svd(tall)), 256, _WIDTH))


@query("select a.i as row, b.i as col, case when a.i = b.i then 1.0::double else 0.0::double end as value from (select unnest(range(64)) as i) a, (select unnest(range(64)) as i) b where (select count(*) from embeddings) > 0")
def l8_orthonormal_factors(spark, sf_dir):
    """U' U of the factors of the table: the identity."""
    tall, _ = _tall(spark, sf_dir)
    u, _, _ = factor.svd(tall)
    cells = blocks.to_cells(blocks.gram(u), _WIDTH, _WIDTH)
    return cells.select("row", "col", (F.round("value", 9) + 0.0).alias("value"))


@query(_SAME)
def l10_q10_leading_factors(spark, sf_dir):
    """Leading factors by random directions, over blocks of 24 columns; with all 64 the product is the table."""
    cells, n = _cells(spark, sf_dir)
    x = blocks.from_cells(cells, 256, 24, n, _WIDTH)
    u, s, v = factor.leading(x, _WIDTH, passes=1)
    return _rounded(blocks.to_cells(factor.rebuilt(u, s, v), 256, 24))


_OWNERS, _LEFT, _RIGHT, _COVER = 3, 11, 12, 13


def _server_view(spark, sf_dir):
    """The sum of three owners' masked and noisy blocks."""
    cells, n = _cells(spark, sf_dir)
    own = masking.split_columns(cells, _WIDTH, _OWNERS)
    # Each owner has all blocks of the whole width, zero outside its columns, so that noise covers where it has none.
    grid = own.select("owner").distinct().crossJoin(own.select("row").distinct()).select("owner", "row", F.lit(0).alias("col"), F.lit(0.0).alias("value"))
    own = blocks.from_cells(own.select("owner", "row", "col", "value").unionByName(grid), 128, _WIDTH, n, _WIDTH, ["owner"])
    seen = masking.masked(own, _LEFT, _RIGHT, ["owner"])
    return masking.server_sum(masking.with_noise(seen, _OWNERS, "a secret of the pair"))


@query(f"with {_CELLS} select case when col < 22 then 0 when col < 43 then 1 else 2 end::int as owner, row, col, round(value, 5) as value from cells")
def l4_l11_l13_three_owners(spark, sf_dir):
    """Factors of what the server sees, U unmasked, each owner's V recovered under its own cover: U S V' is each owner's columns."""
    u, s, v = factor.svd(_server_view(spark, sf_dir))
    bounds = masking.owned_columns(_WIDTH, _OWNERS)
    server_v = spark.createDataFrame([(0, 0, *v.shape, v.astype("<f8").tobytes())], blocks.BLOCK)
    asked = masking.covered_right(spark, bounds, _WIDTH, _WIDTH, _RIGHT, _COVER)
    own_v = masking.uncovered(masking.answered(server_v, asked), bounds, _WIDTH, _WIDTH, _COVER)
    right = blocks.from_cells(own_v.select("owner", F.col("k").alias("row"), "col", "value"), len(s), _WIDTH, len(s), _WIDTH, ["owner"])
    left = factor.times(masking.unmasked_left(u, _LEFT), np.diag(s))
    owners = spark.range(_OWNERS).select(F.col("id").cast("int").alias("owner"))
    whole = blocks.multiply(left.crossJoin(F.broadcast(owners)), right, ["owner"])  # three rows
    cells = blocks.to_cells(whole, 128, _WIDTH, ["owner"])
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in bounds])[F.col("owner")]
    return cells.where((F.col("col") >= ends["a"]) & (F.col("col") < ends["b"])).select("owner", "row", "col", F.round("value", 5).alias("value"))


@query()
def l5_server_sees_no_data(spark, sf_dir):
    """How the server's matrix is like the table (correlation near 0 after masking and noise) and yet has its singular values."""
    seen = _server_view(spark, sf_dir)
    cells, _ = _cells(spark, sf_dir)
    both = cells.join(blocks.to_cells(seen, 128, _WIDTH).withColumnRenamed("value", "seen"), ["row", "col"])
    tall, _ = _tall(spark, sf_dir)
    _, a, _ = factor.svd(tall)
    _, b, _ = factor.svd(seen)
    return both.agg((F.abs(F.corr("value", "seen")) < 0.1).alias("hidden"), F.lit(bool(np.allclose(a, b, rtol=1e-6))).alias("recovered"))
