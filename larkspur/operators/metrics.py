"""Round metrics, run analytics and data skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hms_minutes(text: Column) -> Column:
    """h:m:s as minutes."""
    part = F.split(text, ":")
    return 60 * part[0].cast("double") + part[1].cast("double") + part[2].cast("double") / 60


def improvements(rounds: DataFrame, run: str, order: str, loss: str, tolerance: int) -> DataFrame:
    """Adds best (the least loss so far), misses (rounds since it last fell) and stop (misses > tolerance)."""
    by = Window.partitionBy(run).orderBy(order)
    before = F.min(loss).over(by.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(loss) < before)
    marked = rounds.withColumns({"best": F.least(F.col(loss), before), "_i": F.sum(better.cast("int")).over(by)})
    misses = F.row_number().over(Window.partitionBy(run, "_i").orderBy(order)) - 1
    return marked.withColumn("misses", misses).withColumn("stop", F.col("misses") > tolerance).drop("_i")


def histogram(samples: DataFrame, owner: str, value: str, bins: int = 10) -> DataFrame:
    """(owner, bin, density) over the range of all owners; the last bin is closed."""
    edges = samples.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = samples.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    n = placed.groupBy(owner, "bin").agg(F.count("*").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return n.withColumn("density", F.col("c") / (F.sum("c").over(Window.partitionBy(owner)) * width)).select(owner, "bin", "density", width.alias("width"))


def emd(histograms: DataFrame, owner: str, bins: int = 10) -> DataFrame:
    """(i, j, emd) of owners i < j: the distance between their cumulated densities."""
    grid = histograms.select(owner, "width").distinct().select(owner, "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(histograms.select(owner, "bin", "density"), [owner, "bin"], "left").fillna(0.0, ["density"])
    cdf = full.withColumn("cdf", F.sum(F.col("density") * F.col("width")).over(Window.partitionBy(owner).orderBy("bin")))
    both = cdf.alias("x").join(cdf.alias("y"), "bin").where(F.col(f"x.{owner}") < F.col(f"y.{owner}"))
    return both.groupBy(F.col(f"x.{owner}").alias("i"), F.col(f"y.{owner}").alias("j")).agg(F.sum(F.abs(F.col("x.cdf") - F.col("y.cdf")) * F.col("x.width")).alias("emd"))


def flatten_config(config: dict, before: str = "") -> list[tuple[str, str | None]]:
    """(key chain joined with $$, value) of the leaves of nested settings."""
    out: list[tuple[str, str | None]] = []
    for key, value in config.items():
        chain = f"{before}$${key}" if before else str(key)
        out += flatten_config(value, chain) if isinstance(value, dict) else [(chain, None if value is None else str(value))]
    return out


def differing_keys(run_config: DataFrame) -> DataFrame:
    """Key chains whose values (null counted as one) differ between runs (run_id, key_chain, value)."""
    kinds = F.count_distinct(F.coalesce("value", F.lit("\0")))
    return run_config.groupBy("key_chain").agg(kinds.alias("kinds")).where("kinds > 1").select("key_chain")
