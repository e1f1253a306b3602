"""Tensors and matrices as dense blocks, and what is done with them as Arrow kernels.

A block is a row (``name``..., block_row, block_col, rows, cols, data): the
little-endian doubles of a rectangle, row by row.  Blocks have one height and one
width but for the last ones; a cell that no row gave is 0.  Names are columns of
the caller's (a tensor, a layer, an owner) that keep matrices apart.

Shuffles carry blocks, not cells: a block of h x w numbers is one row.  A task
holds the blocks of one product cell and of one segment of the inner dimension.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "block_row long, block_col long, rows int, cols int, data binary"
PLACE = ["block_row", "block_col"]


def _named(df: DataFrame, names: list[str]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in names)


def matrix(rows: int, cols: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, cols)


def matrices(batch: pa.RecordBatch | pa.Table, prefix: str = "") -> list[np.ndarray]:
    return [matrix(*x) for x in zip(*(batch.column(prefix + c).to_pylist() for c in ("rows", "cols", "data")))]


def packed(made: list[np.ndarray]) -> dict[str, pa.Array]:
    """The shape and data columns of a list of matrices."""
    return {
        "rows": pa.array([m.shape[0] for m in made], pa.int32()), "cols": pa.array([m.shape[1] for m in made], pa.int32()),
        "data": pa.array([np.ascontiguousarray(m, "<f8").tobytes() for m in made], pa.binary()),
    }


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of some 4 MB, where the session doesn't say how many bytes: a count of rows bounds nothing when a row is a block."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, str(4 << 20))
    return df.mapInArrow(kernel, schema)


def mapped(blocks: DataFrame, work: Callable[[dict[str, list], list[np.ndarray]], list[np.ndarray]], names: list[str] | None = None) -> DataFrame:
    """Each block through ``work``, which gets the key columns of a batch and its matrices."""
    keys = [*(names or []), *PLACE]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = work({c: b.column(c).to_pylist() for c in keys}, matrices(b))
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in keys} | packed(made))

    return in_batches(blocks.select(*keys, "rows", "cols", "data"), kernel, _named(blocks, names or []) + BLOCK)


def from_cells(cells: DataFrame, height: int, width: int, n_rows: int, n_cols: int, names: list[str] | None = None) -> DataFrame:
    """Blocks of (names..., row, col, value).  Of a cell that is given twice the sum counts; cells outside the shape raise an error."""
    names = names or []
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    outside = (row < 0) | (row >= n_rows) | (col < 0) | (col >= n_cols)
    row = F.when(outside, F.raise_error(F.lit(f"a cell outside {n_rows} x {n_cols}")).cast("long")).otherwise(row)
    spot = F.struct(((row % height) * width + col % width).cast("int").alias("at"), F.col("value").cast("double").alias("x"))
    grouped = cells.groupBy(*names, F.floor(row / height).alias("block_row"), F.floor(col / width).alias("block_col")).agg(F.collect_list(spot).alias("_cells"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for r, c, own in zip(b.column("block_row").to_pylist(), b.column("block_col").to_pylist(), b.column("_cells")):
                whole = np.zeros(height * width)
                np.add.at(whole, own.values.field("at").to_numpy(), own.values.field("x").to_numpy(zero_copy_only=False))
                made.append(whole.reshape(height, width)[: n_rows - r * height, : n_cols - c * width])
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in [*names, *PLACE]} | packed(made))

    return in_batches(grouped, kernel, _named(cells, names) + BLOCK)


def from_rows(vectors: DataFrame, row: str, column: str, height: int, n_rows: int, n_cols: int) -> DataFrame:
    """Blocks of full width from dense rows; rows that are missing are 0, null vectors too."""
    at = F.col(row).cast("long")
    grouped = vectors.where(F.col(column).isNotNull()).groupBy(F.floor(at / height).alias("block_row")).agg(
        F.collect_list(F.struct((at % height).cast("int").alias("at"), F.col(column).cast("array<double>").alias("x"))).alias("_rows")
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for r, own in zip(b.column("block_row").to_pylist(), b.column("_rows")):
                whole = np.zeros((min(height, n_rows - r * height), n_cols))
                whole[own.values.field("at").to_numpy()] = own.values.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_cols)
                made.append(whole)
            yield pa.RecordBatch.from_pydict({"block_row": b.column("block_row"), "block_col": pa.array([0] * b.num_rows, pa.int64())} | packed(made))

    return in_batches(grouped, kernel, BLOCK)


def to_cells(blocks: DataFrame, height: int, width: int, names: list[str] | None = None) -> DataFrame:
    """(names..., row, col, value) of all cells, zeros too."""
    names = names or []

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in enumerate(matrices(b)):
                i, j = np.indices(m.shape).reshape(2, -1)
                first = [b.column(c)[k].as_py() for c in PLACE]
                keys = {c: pa.array([b.column(c)[k].as_py()] * m.size, b.schema.field(c).type) for c in names}
                yield pa.RecordBatch.from_pydict(keys | {"row": pa.array(i + first[0] * height), "col": pa.array(j + first[1] * width), "value": pa.array(m.ravel())})

    return in_batches(blocks.select(*names, *PLACE, "rows", "cols", "data"), kernel, _named(blocks, names) + "row long, col long, value double")


def transpose(blocks: DataFrame, names: list[str] | None = None) -> DataFrame:
    turned = mapped(blocks, lambda keys, m: [x.T for x in m], names)
    return turned.select(*(names or []), F.col("block_col").alias("block_row"), F.col("block_row").alias("block_col"), "rows", "cols", "data")


def total(blocks: DataFrame, keys: list[str], held: int = 64) -> DataFrame:
    """Sums of blocks of equal ``keys``: first within each task, ``held`` sums at a time, then of what tasks pass on."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            columns = {c: pa.array([k[n] for k in sums], schema.field(c).type) for n, c in enumerate(keys)}
            return pa.RecordBatch.from_pydict(columns | packed(list(sums.values())))

        for b in batches:
            schema = b.schema
            for key, m in zip(zip(*(b.column(c).to_pylist() for c in keys)), matrices(b)):
                if key in sums:
                    sums[key] += m
                elif len(sums) < held:
                    sums[key] = m.copy()
                else:
                    yield given()
                    sums.clear()
                    sums[key] = m.copy()
        if sums:
            yield given()

    kind = _named(blocks, keys) + "rows int, cols int, data binary"
    partly = in_batches(blocks.select(*keys, "rows", "cols", "data"), kernel, kind)

    def added(table: pa.Table) -> pa.Table:
        ms = matrices(table)
        out = ms[0].copy()
        for m in ms[1:]:
            out += m
        return pa.table({c: table.column(c).slice(0, 1) for c in keys} | packed([out]))

    return partly.groupBy(*keys).applyInArrow(added, kind)


def multiply(a: DataFrame, b: DataFrame, names: list[str] | None = None, segment: int = 16) -> DataFrame:
    """A B of blocks whose inner sizes agree (``names``: matrices of both that go together).

    Blocks go to the cells of the result's grid for one segment of the inner
    dimension, ``segment`` blocks of either side at most; the products of
    segments are then added.  So a block of A is copied once for each block
    column of B and the other way round, and no cell's product leaves its task.
    """
    names = names or []
    right = b.select(*names, F.col("block_row").alias("_k"), F.col("block_col").alias("_j"), F.struct("rows", "cols", "data").alias("_b"))
    left = a.select(*names, F.col("block_row").alias("_i"), F.col("block_col").alias("_k"), F.struct("rows", "cols", "data").alias("_a"))
    # Grids are small beside the blocks: places only, not data.
    rows, cols = left.groupBy(*names, "_k").agg(F.collect_set("_i").alias("_is")), right.groupBy(*names, "_k").agg(F.collect_set("_j").alias("_js"))
    left = left.join(cols, [*names, "_k"]).select(*names, "_i", "_k", F.explode("_js").alias("_j"), "_a")
    right = right.join(rows, [*names, "_k"]).select(*names, "_j", "_k", F.explode("_is").alias("_i"), "_b")
    cell = [*names, "_i", "_j", "_s"]
    left, right = (x.withColumn("_s", F.floor(F.col("_k") / segment)) for x in (left, right))

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        ms = {k: matrix(x["rows"], x["cols"], x["data"]) for k, x in zip(two.column("_k").to_pylist(), two.column("_b").to_pylist())}
        out = None
        for k, x in zip(one.column("_k").to_pylist(), one.column("_a").to_pylist()):
            part = matrix(x["rows"], x["cols"], x["data"]) @ ms[k]
            out = part if out is None else out + part
        keys = {c: one.column(c).slice(0, 1) for c in names} | {"block_row": one.column("_i").slice(0, 1), "block_col": one.column("_j").slice(0, 1)}
        return pa.table(keys | packed([out]))

    products = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(kernel, _named(a, names) + BLOCK)
    return total(products, [*names, *PLACE])


def gram(blocks: DataFrame) -> DataFrame:
    """A' A of blocks of full width, as one block: summed in each task before anything is shuffled."""
    return total(mapped(blocks, lambda keys, m: [x.T @ x for x in m]).withColumn("block_row", F.lit(0).cast("long")), PLACE)


# -- serialisation

_MAGIC = b"LKB1"


def encode(rows: int, cols: int, data: bytes) -> str:
    """A block as base64 text: a mark, the shape, the doubles."""
    return base64.b64encode(_MAGIC + struct.pack("<ii", rows, cols) + data).decode()


def decode(text: str) -> tuple[int, int, bytes]:
    raw = base64.b64decode(text, validate=True)
    rows, cols = struct.unpack("<ii", raw[4:12])
    if raw[:4] != _MAGIC or len(raw) != 12 + 8 * rows * cols:
        raise ValueError("not an encoded block")
    return rows, cols, raw[12:]


def serialised(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., body, sha256): each block as text that any transport carries, with a digest of the text."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = [encode(*x) for x in zip(*(b.column(c).to_pylist() for c in ("rows", "cols", "data")))]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in keys} | {"body": pa.array(body, pa.string())})

    made = in_batches(blocks.select(*keys, "rows", "cols", "data"), kernel, _named(blocks, keys) + "body string")
    return made.withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256))


def restored(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks again; a body that doesn't have its digest raises an error."""
    body = F.when(F.sha2(F.col("body").cast("binary"), 256) == F.col("sha256"), F.col("body")).otherwise(F.raise_error(F.lit("a block's digest is wrong")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(x) for x in b.column("body").to_pylist()]
            columns = {"rows": pa.array([x[0] for x in found], pa.int32()), "cols": pa.array([x[1] for x in found], pa.int32()), "data": pa.array([x[2] for x in found], pa.binary())}
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in keys} | columns)

    return in_batches(texts.select(*keys, body.alias("body")), kernel, _named(texts, keys) + "rows int, cols int, data binary")


# -- tensors and flat vectors


def flat_chunks(tensors: DataFrame, layers: DataFrame, chunk: int, names: list[str] | None = None) -> DataFrame:
    """Chunks of one flat vector for each of ``names`` from tensors (names..., layer, pos, value).

    ``layers`` has (layer, start), the offsets of ``datasets.flat_offsets``; a chunk is a block of one row.
    """
    flat = tensors.join(layers.select("layer", "start"), "layer").select(*(names or []), F.lit(0).alias("row"), (F.col("start") + F.col("pos")).alias("col"), "value")
    size = layers.agg(F.max(F.col("start") + F.col("size")).alias("n")).first()["n"] or 0
    return from_cells(flat, 1, chunk, 1, size, names)


def from_flat(chunks: DataFrame, layers: DataFrame, chunk: int, names: list[str] | None = None) -> DataFrame:
    """(names..., layer, pos, value) again: each flat place belongs to the layer whose range holds it."""
    cells = to_cells(chunks, 1, chunk, names)
    last: Column = F.col("start") + F.col("size")
    # One row for each layer of the model: as small as the list of its layers, and sent so only if Spark finds it small.
    return cells.join(layers, (F.col("col") >= F.col("start")) & (F.col("col") < last)).select(*(names or []), "layer", (F.col("col") - F.col("start")).alias("pos"), "value")
