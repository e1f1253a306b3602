"""Matrices of several owners under masks: masking, the server's sum and factors, unmasking.

Every owner holds a run of a matrix's columns, as blocks (owner, block_row,
block_col, ...) of the whole matrix's width that are 0 outside its columns.  Masks
are block-diagonal with orthogonal blocks that line up with the data's blocks, so
P X Q is a product within each block and nothing is shuffled: P's block of a
block row and Q's of a block column are made from a seed where they are used.
The server sees sums only: pairwise noise cancels in them.

V' isn't handed out either.  For the blocks of its columns an owner sends its rows
of Q under a random block R of its own; what the server returns is V' under R, and
only who has R's seed can invert it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import blocks
from larkspur.operators.partition import even_owner


def orthogonal(size: int, seed: int, block: int) -> np.ndarray:
    """The mask's block: the Q of a random square, with the signs that make it one of all orthogonal ones."""
    q, r = np.linalg.qr(np.random.default_rng([seed, block]).normal(size=(size, size)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def split_columns(cells: DataFrame, n_cols: int, owners: int) -> DataFrame:
    """Adds owner: an even run of columns for each."""
    return cells.withColumn("owner", even_owner(F.col("col"), n_cols, owners))


def owned_columns(n_cols: int, owners: int) -> list[tuple[int, int]]:
    """(first, end) of each owner's columns, as ``split_columns`` deals them out."""
    size, more = divmod(n_cols, owners)
    ends = [0]
    for k in range(owners):
        ends.append(ends[-1] + size + (k < more))
    return list(zip(ends, ends[1:]))


def masked(matrix: DataFrame, left_seed: int, right_seed: int, names: list[str]) -> DataFrame:
    """P X Q within each block."""
    def work(keys, found):
        return [orthogonal(len(m), left_seed, r) @ m @ orthogonal(m.shape[1], right_seed, c) for r, c, m in zip(keys["block_row"], keys["block_col"], found)]

    return blocks.mapped(matrix, work, names)


def _pair_seed(secret: str, a: int, b: int, r: int, c: int) -> int:
    """From what both owners of a pair know, the noise of one block that ``a`` adds and ``b`` takes away."""
    return int.from_bytes(hashlib.sha256(f"{secret}|{a}|{b}|{r}|{c}".encode()).digest()[:8], "little")


def with_noise(matrix: DataFrame, owners: int, secret: str, scale: float = 10.0, neighbours: int = 2) -> DataFrame:
    """Adds to each owner's blocks noise that cancels in the sum over all owners: with the next ``neighbours`` owners in a ring.

    An owner thus makes 2 * neighbours blocks of noise for each of its blocks, however many owners there are.
    Every owner must have the same blocks.
    """
    def work(keys, found):
        out = []
        for own, r, c, m in zip(keys["owner"], keys["block_row"], keys["block_col"], found):
            m = m.copy()
            for d in range(1, min(neighbours, (owners - 1)) + 1):
                for a, b, sign in ((own, (own + d) % owners, 1.0), ((own - d) % owners, own, -1.0)):
                    m += sign * np.random.default_rng(_pair_seed(f"{secret}|{d}", a, b, r, c)).normal(0, scale, m.shape)
            out.append(m)
        return out

    return blocks.mapped(matrix, work, ["owner"])


def server_sum(masked_blocks: DataFrame) -> DataFrame:
    """What the server sees: the sum of all owners' blocks."""
    return blocks.total(masked_blocks, blocks.PLACE)


def unmasked_left(u: DataFrame, left_seed: int) -> DataFrame:
    """P' U' of blocks of full width."""
    return blocks.mapped(u, lambda keys, found: [orthogonal(len(m), left_seed, r).T @ m for r, m in zip(keys["block_row"], found)])


def _cover(size: int, seed: int, owner: int, block: int) -> np.ndarray:
    """An owner's random block: far from singular, as a shifted orthogonal one is, but no rotation."""
    rng = np.random.default_rng([seed, owner, block])
    return np.linalg.qr(rng.normal(size=(size, size)))[0] * rng.uniform(0.5, 2.0, size)


def _slices(bounds: list[tuple[int, int]], n_cols: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """(owner, block, rows of the block, first and end of the owner's columns in it): no more than owners plus blocks."""
    out = []
    for owner, (first, end) in enumerate(bounds):
        for block in range(first // width, -(-end // width) if end > first else first // width):
            begin = block * width
            out.append((owner, block, min(width, n_cols - begin), max(first - begin, 0), min(end - begin, width)))
    return out


def covered_right(spark, bounds: list[tuple[int, int]], n_cols: int, width: int, right_seed: int, cover_seed: int) -> DataFrame:
    """What owners send for their columns: (owner, block, their rows of Q, transposed, times R)."""
    plan = spark.createDataFrame(_slices(bounds, n_cols, width), "owner int, block_row long, n int, first int, end int")

    def kernel(batches):
        for b in batches:
            made = []
            for own, r, n, first, end in zip(*(b.column(c).to_pylist() for c in ("owner", "block_row", "n", "first", "end"))):
                made.append(orthogonal(n, right_seed, r)[first:end].T @ _cover(end - first, cover_seed, own, r))
            keys = {"owner": b.column("owner"), "block_row": b.column("block_row"), "block_col": pa.array([0] * b.num_rows, pa.int64())}
            yield pa.RecordBatch.from_pydict(keys | blocks.packed(made))

    return blocks.in_batches(plan, kernel, f"owner int, {blocks.BLOCK}")


def answered(v: DataFrame, asked: DataFrame) -> DataFrame:
    """The server's part: V' of the block (k by width) times what the owner sent, for every owner at once."""
    both = asked.withColumnsRenamed({c: f"q_{c}" for c in ("rows", "cols", "data")}).join(v.select("block_row", "rows", "cols", "data"), "block_row")

    def kernel(batches):
        for b in batches:
            made = [x.T @ q for x, q in zip(blocks.matrices(b), blocks.matrices(b, "q_"))]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("owner", *blocks.PLACE)} | blocks.packed(made))

    return blocks.in_batches(both, kernel, f"owner int, {blocks.BLOCK}")


def uncovered(answers: DataFrame, bounds: list[tuple[int, int]], n_cols: int, width: int, cover_seed: int) -> DataFrame:
    """(owner, col, k, value): each owner's V, its covers inverted block by block."""
    firsts = {(own, block): (block * width + first, end - first) for own, block, _, first, end in _slices(bounds, n_cols, width)}

    def kernel(batches):
        for b in batches:
            for own, r, m in zip(b.column("owner").to_pylist(), b.column("block_row").to_pylist(), blocks.matrices(b)):
                begin, n = firsts[own, r]
                v = np.linalg.solve(_cover(n, cover_seed, own, r).T, m.T)  # (m R^-1)'
                i, k = np.indices(v.shape).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"owner": pa.array([own] * v.size, pa.int32()), "col": pa.array(i + begin), "k": pa.array(k), "value": pa.array(v.ravel())})

    return blocks.in_batches(answers, kernel, "owner int, col long, k long, value double")
