"""Writers: client datasets, weights by round, histories and finished trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clients(samples: DataFrame, path: str) -> None:
    """Samples with client_id and split, in a folder for each, so that a client's scan is pruned to its own."""
    samples.write.partitionBy("client_id", "split").mode("overwrite").parquet(path)


def read_client(spark: SparkSession, path: str, client_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("client_id") == client_id)


def keep_latest(weights: DataFrame, rounds: int, order: str = "round") -> DataFrame:
    """Weights of the last ``rounds`` rounds."""
    newest = weights.agg(F.max(order).alias("_newest"))
    return weights.crossJoin(F.broadcast(newest)).where(F.col(order) > F.col("_newest") - rounds).drop("_newest")


def best_weights(weights: DataFrame, losses: DataFrame) -> DataFrame:
    """Weights of the round with the least validation loss, the first of equals."""
    best = losses.agg(F.min_by("round", F.struct("loss", "round")).alias("round"))
    return weights.join(F.broadcast(best), "round", "left_semi")


def upserted(history: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """The history with rows of ``news`` in place of those with their keys."""
    return history.join(news.select(key).distinct(), key, "left_anti").unionByName(news)


def append_missing(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table at ``path`` doesn't have."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).parquet(path).select(keys).distinct()
    except Exception as missing:  # the first time
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        rows = rows.join(done, keys, "left_anti")
    rows.write.mode("append").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines, in place of the ones before."""
    results.write.mode("overwrite").json(path)


def write_averages(table: DataFrame, path: str) -> None:
    """Averaged results as delimited text with a header."""
    table.write.mode("overwrite").option("header", True).option("sep", ", ").csv(path)
