"""Matrices as cells (row, col, value); products are joins, so they scale with the cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.toDF("row", "k", "x"), b.toDF("k", "col", "y")
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def gram(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """(i, j, value), i <= j: X'X of dense rows, summed in blocks before the shuffle."""
    import pyarrow as pa

    def work(batches):
        total = np.zeros((size, size))
        for b in batches:
            x = np.array(b.column(column).to_pylist(), float).reshape(-1, size)
            total += x.T @ x
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(total[i, j])})

    return vectors.select(F.col(column).cast("array<double>").alias(column)).mapInArrow(work, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def dense(cells: DataFrame, size: int) -> np.ndarray:
    """A symmetric matrix of ``size`` features from its upper cells: bounded by the number of features."""
    f, out = cells.toPandas(), np.zeros((size, size))
    out[f["i"], f["j"]] = out[f["j"], f["i"]] = f["value"]
    return out


def svd(vectors: DataFrame, column: str, size: int, k: int | None = None, eps: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) through the Gram matrix; values near 0 are left out."""
    w, v = np.linalg.eigh(dense(gram(vectors, column, size), size))
    order = np.argsort(-w)[: k or size]
    order = order[w[order] > eps * max(w.max(), 1e-300)]
    return np.sqrt(w[order]), v[:, order]


def ridge(samples: DataFrame, features: list[str], label: str, penalty: float) -> np.ndarray:
    """Weights (the bias last) of the normal equations; one aggregate over the samples."""
    names = [*[F.col(c).cast("double") for c in features], F.lit(1.0), F.col(label).cast("double")]
    n = len(names)
    row = samples.agg(*[F.sum(names[i] * names[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    g = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    return np.linalg.solve(g[:-1, :-1] + penalty * np.eye(n - 1), g[:-1, -1])


def block_masks(spark, size: int, block: int, seed: int = 0) -> DataFrame:
    """Cells of a block-diagonal orthogonal matrix; the remainder joins the last block."""
    import pandas as pd

    count = max(1, size // block)
    starts = spark.range(count).select(F.col("id").alias("b"))

    def work(frames):
        for f in frames:
            for b in f["b"]:
                first, n = b * block, (size - b * block if b == count - 1 else block)
                q, _ = np.linalg.qr(np.random.default_rng(seed + b).normal(size=(n, n)))
                i, j = np.indices((n, n)).reshape(2, -1)
                yield pd.DataFrame({"row": i + first, "col": j + first, "value": q.ravel()})

    return starts.mapInPandas(work, "row long, col long, value double")


def rows_between(cells: DataFrame, first: int, end: int) -> DataFrame:
    """Cells of the rows from ``first`` up to, not with, ``end``."""
    return cells.where((F.col("row") >= first) & (F.col("row") < end))


def summed(client_cells: DataFrame) -> DataFrame:
    """(row, col, value): the clients' matrices added up, so that masks which cancel fall away."""
    return client_cells.groupBy("row", "col").agg(F.sum("value").alias("value"))


def errors(pairs: DataFrame, predicted: str, real: str) -> DataFrame:
    """(mae, mse, rmse, mape, r2) of a column against another; mape leaves out zeros."""
    d, y = F.col(predicted) - F.col(real), F.col(real)
    total = F.var_pop(y)
    return pairs.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d / F.nullif(y, F.lit(0.0)))).alias("mape"), (1 - F.avg(d * d) / F.nullif(total, F.lit(0.0))).alias("r2"))


def likeness(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(pearson, cosine, scaled_rmse): the last after both columns are scaled to 0 to 1."""
    x, y = F.col(a), F.col(b)
    edges = pairs.agg(*[f(c).alias(n) for f, c, n in ((F.min, a, "_al"), (F.max, a, "_ah"), (F.min, b, "_bl"), (F.max, b, "_bh"))])
    d = (x - F.col("_al")) / (F.col("_ah") - F.col("_al")) - (y - F.col("_bl")) / (F.col("_bh") - F.col("_bl"))
    both = pairs.crossJoin(F.broadcast(edges))  # one row
    return both.agg(F.corr(x, y).alias("pearson"), (F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"), F.sqrt(F.avg(d * d)).alias("scaled_rmse"))


def _square_sum(cells: DataFrame) -> DataFrame:
    return cells.agg(F.sum(F.col("value") * F.col("value")).alias("s"))


def projection_distance(u: DataFrame, v: DataFrame) -> DataFrame:
    """(distance): the Frobenius norm of UU' - VV', from the small products U'U, V'V and U'V alone."""
    tu, tv = transpose(u), transpose(v)
    parts = [_square_sum(multiply(tu, u)).withColumn("w", F.lit(1)), _square_sum(multiply(tv, v)).withColumn("w", F.lit(1)), _square_sum(multiply(tu, v)).withColumn("w", F.lit(-2))]
    whole = parts[0].union(parts[1]).union(parts[2]).agg(F.sum(F.col("s") * F.col("w")).alias("s"))
    return whole.select(F.sqrt(F.greatest("s", F.lit(0.0))).alias("distance"))


def reconstruction_errors(cells: DataFrame, left: DataFrame, values: DataFrame, right: DataFrame) -> DataFrame:
    """Errors of U diag(s) V' against the matrix: left (row, col, value), values (col, s), right (row, col, value)."""
    scaled = left.join(F.broadcast(values), "col").select("row", "col", (F.col("value") * F.col("s")).alias("value"))
    made = multiply(scaled, transpose(right)).withColumnRenamed("value", "made")
    return errors(cells.join(made, ["row", "col"], "left").fillna(0.0, ["made"]), "made", "value")


def _orthonormal(index, size: int, rank: int, seed: int) -> np.ndarray:
    """Rows ``index`` of a size x rank matrix with orthonormal columns: cosines with a sign drawn for each row."""
    index = np.asarray(index, np.int64)
    k = np.arange(rank)
    sign = np.where((index * 0x9E3779B1 + seed * 0x85EBCA6B >> 13) & 1, -1.0, 1.0)[:, None]
    return sign * np.sqrt(np.where(k, 2.0, 1.0) / size) * np.cos(np.pi * (index[:, None] + 0.5) * k / size)


def power_law_rows(spark, rows: int, features: int, alpha: float, seed: int = 0) -> DataFrame:
    """(row, x): singular values proportional to k ** -alpha, scaled to a largest row norm of 1.

    Each task makes its own rows; only the features' factor is held, which is as wide as a row is long.
    """
    import pandas as pd

    rank = min(rows, features)
    right = np.arange(1, rank + 1, dtype=float)[:, None] ** -alpha * _orthonormal(np.arange(features), features, rank, seed + 1).T

    def work(frames):
        for f in frames:
            yield pd.DataFrame({"row": f["id"], "x": list(_orthonormal(f["id"], rows, rank, seed) @ right)})

    made = spark.range(rows).mapInPandas(work, "row long, x array<double>")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    top = made.agg(F.max(norm).alias("top"))
    return made.crossJoin(F.broadcast(top)).select("row", F.expr("transform(x, v -> v / top)").alias("x"))
