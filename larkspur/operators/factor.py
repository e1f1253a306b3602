"""Factors of matrices in blocks: QR as a tree, SVD of tall matrices, leading factors of any.

No Gram matrix is taken, so condition numbers aren't squared.  Each task turns
its blocks of rows into one triangle (a QR of what it holds and the next block,
again and again); triangles are merged level by level, ``FAN`` to a task.  What
reaches the driver is one triangle of features by features (or, for leading
factors, of k + extra by k + extra) numbers; U, V and all products stay blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.operators import blocks

FAN = 8
_TRIANGLE = "rows int, cols int, data binary"


def triangle(tall: DataFrame) -> np.ndarray:
    """R of the QR of blocks that are one block wide; rows are fewer where the matrix has fewer."""
    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for m in blocks.matrices(b):
                held.append(m)
                if sum(len(x) for x in held) >= 4 * m.shape[1]:
                    held = [np.linalg.qr(np.vstack(held), "r")]
        if held:
            yield pa.RecordBatch.from_pydict(blocks.packed([np.linalg.qr(np.vstack(held), "r")]))

    level = blocks.in_batches(tall.select("rows", "cols", "data"), reduced, _TRIANGLE)
    parts = tall.sparkSession.sparkContext.defaultParallelism
    while parts > FAN:
        parts = -(-parts // FAN)
        level = blocks.in_batches(level.repartition(parts), reduced, _TRIANGLE)
    rows = blocks.in_batches(level.repartition(1), reduced, _TRIANGLE).collect()  # one triangle, or none
    return blocks.matrix(*rows[0]) if rows else np.zeros((0, 0))


def times(tall: DataFrame, *small: np.ndarray) -> DataFrame:
    """Blocks of full width times matrices of the driver's (features by at most features), one after the other.

    Each kernel of a task is a Python worker of its own, so what can be multiplied in a row goes through one.
    """
    shared = tall.sparkSession.sparkContext.broadcast(small)
    return blocks.mapped(tall, lambda keys, m: [functools.reduce(np.matmul, shared.value, x) for x in m])


def _orthonormal(tall: DataFrame, eps: float) -> tuple[list[np.ndarray], np.ndarray]:
    """(what makes Q of the matrix by ``times``, B)."""
    _, s, vt = np.linalg.svd(triangle(tall), full_matrices=False)
    rank = int((s > eps * s.max(initial=0)).sum())
    first = vt[:rank].T / s[:rank]
    again = triangle(times(tall, first))
    return [first, np.linalg.inv(again)], again * s[:rank] @ vt[:rank]


def orthonormal(tall: DataFrame, eps: float = 1e-13) -> tuple[DataFrame, np.ndarray]:
    """(Q in blocks, B): the matrix is Q B, and Q has orthonormal columns, as many as the rank.

    Directions of less than ``eps`` of the largest are left out.  A first Q is
    orthonormal only to the condition number times the machine's precision; its own
    triangle, which is close to the identity, takes that off.
    """
    made, small = _orthonormal(tall, eps)
    return times(tall, *made), small


def svd(tall: DataFrame, k: int | None = None, eps: float = 1e-13) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(U in blocks, singular values, right vectors as columns) of blocks of full width, all of the rank or the first k."""
    made, small = _orthonormal(tall, eps)
    u, s, vt = np.linalg.svd(small, full_matrices=False)
    k = len(s) if k is None else min(k, len(s))
    return times(tall, *made, u[:, :k]), s[:k], vt[:k].T


def _probe(block_row: int, rows: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, block_row]).normal(size=(rows, width))


def leading(matrix: DataFrame, k: int, extra: int = 10, passes: int = 2, seed: int = 0) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(U in blocks, the first k singular values, V in blocks) of a matrix in blocks of any shape, by randomised range finding.

    The matrix meets k + extra random directions; each of ``passes`` goes through
    its transpose and itself once more, with an orthonormal basis taken in between,
    which sharpens slowly falling values.  All that is wide or long stays blocks.
    """
    turned = blocks.transpose(matrix)
    # A random block for each block of columns, made where it is used: the probe needs no table.
    sizes = turned.select("block_row", "rows").distinct()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms = [_probe(r, n, k + extra, seed) for r, n in zip(b.column("block_row").to_pylist(), b.column("rows").to_pylist())]
            yield pa.RecordBatch.from_pydict({"block_row": b.column("block_row"), "block_col": pa.array([0] * b.num_rows, pa.int64())} | blocks.packed(ms))

    probe = blocks.in_batches(sizes, made, blocks.BLOCK)
    q, _ = orthonormal(blocks.multiply(matrix, probe))
    for _ in range(passes):
        z, _ = orthonormal(blocks.multiply(turned, q))
        q, _ = orthonormal(blocks.multiply(matrix, z))
    v, s, right = svd(blocks.multiply(turned, q))  # (Q' A)' = V S W', so A is near Q W S V'
    k = min(k, len(s))
    return times(q, right[:, :k]), s[:k], times(v, np.eye(len(s))[:, :k])


def rebuilt(u: DataFrame, s: np.ndarray, v: DataFrame | np.ndarray) -> DataFrame:
    """U diag(s) V' in blocks; V as columns of the driver's or in blocks."""
    if isinstance(v, np.ndarray):
        return times(u, s[:, None] * v.T)
    return blocks.multiply(times(u, np.diag(s)), blocks.transpose(v))
