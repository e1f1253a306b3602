"""The engine's views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def client_params(spark: SparkSession, sf_dir: str, clients: int = 8, width: int = 16) -> tuple[DataFrame, DataFrame]:
    """(client_id, layer, pos, value) and (client_id, n_train): each client's mean embedding as its parameters."""
    vectors = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % clients).alias("client_id"), "embedding")
    cells = vectors.select("client_id", F.posexplode("embedding").alias("k", "value"))
    param = cells.groupBy("client_id", F.floor(F.col("k") / width).cast("int").alias("layer"), (F.col("k") % width).cast("int").alias("pos")).agg(
        F.avg(F.col("value").cast("double")).alias("value")
    )
    return param, vectors.groupBy("client_id").agg(F.count("*").alias("n_train"))
