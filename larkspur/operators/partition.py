"""Samples to simulated clients.  All ranks are md5 ranks, so any engine gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: int = 0) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def ratio_split(samples: DataFrame, owner: str, key: str, ratio: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """Adds split: an owner's samples in md5 order; validation and test take at least one each."""
    total = sum(ratio)
    if len(ratio) != 3 or min(ratio) < 0 or total <= 1e-6:
        raise ValueError("three ratios, none negative, not all zero")
    own = Window.partitionBy(owner)
    n, r = F.count("*").over(own), F.row_number().over(own.orderBy(draw(key, seed), key))
    val, test = (F.greatest(F.lit(1), F.floor(n * (x / total))) for x in ratio[1:])
    return samples.withColumn("split", F.when(r <= n - val - test, "train").when(r <= n - test, "val").otherwise("test"))


def iid(samples: DataFrame, key: str, clients: int, seed: int = 0) -> DataFrame:
    """Adds client_id: equal slices in md5 order; the remainder is dropped."""
    total = samples.count()
    size = total // clients
    # A global rank without a single task: ranks within ranges of the hash, plus what lies before each range.
    ranged = samples.withColumn("_d", draw(key, seed)).withColumn("_b", F.substring("_d", 1, 3))
    before = ranged.groupBy("_b").count()
    before = before.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_before"))
    ranked = ranged.join(F.broadcast(before), "_b").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_d", key)) - 1)
    return ranked.withColumn("client_id", F.floor(F.col("_r") / size).cast("int")).where(F.col("client_id") < clients).drop("_d", "_b", "_before", "_r")


def even_owner(place: Column, total: int, parts: int) -> Column:
    """Which of ``parts`` even runs holds the place; the first total % parts runs are one longer."""
    size, more = divmod(total, parts)
    return F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(more + F.floor((place - more * (size + 1)) / max(size, 1))).cast("int")


def class_ranks(samples: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Adds rank: the md5 rank within the class, from ranks within ranges of the hash, so that no task holds a class."""
    ranged = samples.withColumn("_d", draw(key, seed)).withColumn("_b", F.substring("_d", 1, 3))
    before = ranged.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    before = before.select(label, "_b", (F.sum("_c").over(Window.partitionBy(label).orderBy("_b")) - F.col("_c")).alias("_o"))
    own = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_d", key)) - 1
    return ranged.join(before, [label, "_b"]).withColumn("rank", F.col("_o") + own).drop("_d", "_b", "_o")


def split_cells(cells: DataFrame, by: str, total: int, parts: int, non_iid: bool = False) -> DataFrame:
    """Adds client_id to the cells of a matrix: even runs of its columns (by='col': vertical) or rows."""
    if by == "col" and non_iid:
        raise ValueError("features can't be dealt out by class")
    return cells.withColumn("client_id", even_owner(F.col(by), total, parts))
