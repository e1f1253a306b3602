"""Aggregation of client parameters (client_id, layer, pos, value) by coordinate.

Every rule is a grouping by (layer, pos), so partial aggregates combine before
the shuffle wherever the rule allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["layer", "pos"]


def layerwise(param: DataFrame, func) -> DataFrame:
    """Any aggregate of the values of each coordinate."""
    return param.groupBy(*KEYS).agg(func(F.col("value")).alias("value"))


def mean(param: DataFrame) -> DataFrame:
    return layerwise(param, F.avg)


def median(param: DataFrame) -> DataFrame:
    return layerwise(param, F.median)


def weighted_mean(param: DataFrame, sizes: DataFrame, weight: str = "n_train") -> DataFrame:
    """Per coordinate: sum of weight times value over sum of weights.

    ``sizes`` has one row for each client; Spark broadcasts it where it is small enough.
    """
    v, w = F.col("value"), F.col(weight)
    return param.join(sizes, "client_id").groupBy(*KEYS).agg((F.sum(v * w) / F.sum(w)).alias("value"))


def trim(param: DataFrame, ratio: float) -> DataFrame:
    """Without the int(n * ratio) least and greatest values of each coordinate (ties by client)."""
    if not 0 <= ratio < 0.5:
        raise ValueError("ratio must lie in [0, 0.5)")
    own = Window.partitionBy(*KEYS)
    k = F.floor(F.count("*").over(own) * ratio)
    ranked = param.withColumns({"_r": F.row_number().over(own.orderBy("value", "client_id")), "_n": F.count("*").over(own), "_k": k})
    return ranked.where("_r > _k and _r <= _n - _k").drop("_r", "_n", "_k")


def trimmed_mean(param: DataFrame, ratio: float = 0.05, compat: str = "mean") -> DataFrame:
    """compat='sum' gives the sum of what is left instead."""
    return layerwise(trim(param, ratio), F.sum if compat == "sum" else F.avg)


def trimmed_median(param: DataFrame, ratio: float = 0.05) -> DataFrame:
    return layerwise(trim(param, ratio), F.median)


def pair_distances(param: DataFrame) -> DataFrame:
    """(a, b, distance) for a < b: Euclidean by layer, summed over layers."""
    both = param.alias("x").join(param.alias("y"), KEYS).where("x.client_id < y.client_id")
    layers = both.groupBy(F.col("x.client_id").alias("a"), F.col("y.client_id").alias("b"), "layer").agg(F.sqrt(F.sum(F.pow(F.col("x.value") - F.col("y.value"), 2))).alias("d"))
    return layers.groupBy("a", "b").agg(F.sum("d").alias("distance"))


def krum_scores(param: DataFrame) -> DataFrame:
    """(client_id, score): the sum of distances to all others."""
    d = pair_distances(param)
    return d.select("a", "distance").union(d.select("b", "distance")).toDF("client_id", "d").groupBy("client_id").agg(F.sum("d").alias("score"))


def krum_select(param: DataFrame, select: int = 1) -> DataFrame:
    """Parameters of the ``select`` clients with the least scores (ties by client)."""
    if select < 1:
        raise ValueError("select must be positive")
    kept = krum_scores(param).orderBy("score", "client_id").limit(select).select("client_id")
    return param.join(F.broadcast(kept), "client_id", "left_semi")


def krum(param: DataFrame, select: int = 1) -> DataFrame:
    return mean(krum_select(param, select))


def bulyan(param: DataFrame, ratio: float = 0.05, select: int = 1) -> DataFrame:
    return trimmed_mean(krum_select(param, select), ratio)


def norm_clip(param: DataFrame, server: DataFrame, threshold: float | None = 0.5) -> DataFrame:
    """server + the sum over clients of each layer's delta, scaled down to an L2 norm of ``threshold``."""
    limit = 1.0 if threshold is None else threshold
    if limit <= 0:
        raise ValueError("threshold must be positive")
    delta = param.join(server.withColumnRenamed("value", "base"), KEYS).withColumn("d", F.col("value") - F.col("base"))
    norms = delta.groupBy("client_id", "layer").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("norm"))
    clipped = delta.join(norms, ["client_id", "layer"]).withColumn("d", F.col("d") / F.greatest(F.lit(1.0), F.col("norm") / limit))
    return clipped.groupBy(*KEYS).agg((F.first("base") + F.sum("d")).alias("value"))


def norm_clip_spectral(param: DataFrame, server: DataFrame, threshold: float = 0.5, width: int = 4) -> DataFrame:
    """As ``norm_clip`` with the spectral norm of each layer seen as a matrix of ``width`` columns, its last row filled up with zeros.

    The norm is the root of the greatest eigenvalue of a layer's Gram matrix, which is summed by
    Spark: however long a layer is, a task holds ``width ** 2`` numbers of it.
    """
    import numpy as np
    import pandas as pd

    if threshold <= 0 or width < 1:
        raise ValueError("threshold and width must be positive")
    layer = ["client_id", "layer"]
    delta = param.join(server.withColumnRenamed("value", "base"), KEYS).select("client_id", *KEYS, "base", (F.col("value") - F.col("base")).alias("d"))
    cell = F.struct((F.col("pos") % width).cast("int").alias("col"), "d")
    rows = delta.groupBy(*layer, F.floor(F.col("pos") / width).alias("row")).agg(F.collect_list(cell).alias("x"))
    products = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: F.struct(a["col"].alias("i"), b["col"].alias("j"), (a["d"] * b["d"]).alias("v")))))
    gram = rows.select(*layer, F.explode(products).alias("p")).groupBy(*layer, "p.i", "p.j").agg(F.sum("p.v").alias("v"))

    def norm(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((width, width))
        g[f["i"], f["j"]] = f["v"]
        return pd.DataFrame({"client_id": [key[0]], "layer": [key[1]], "norm": [max(0.0, np.linalg.eigvalsh(g)[-1]) ** 0.5]})

    kinds = [f"{c} {delta.schema[c].dataType.simpleString()}" for c in layer]
    norms = gram.groupBy(*layer).applyInPandas(norm, ", ".join([*kinds, "norm double"]))
    clipped = delta.join(norms, layer).withColumn("d", F.col("d") / F.greatest(F.lit(1.0), F.col("norm") / threshold))
    return clipped.groupBy(*KEYS).agg((F.first("base") + F.sum("d")).alias("value"))
