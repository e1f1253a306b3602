"""Readers of client datasets: user JSON, delimited files, ratings, generated matrices and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USER_JSON = "user_data map<string, struct<x: array<string>, y: array<string>>>"


def user_json(spark: SparkSession, path: str) -> DataFrame:
    """(owner, k, x, y): samples of JSON files that map users to parallel lists x and y."""
    users = spark.read.schema(USER_JSON).option("multiLine", True).json(path).select(F.explode("user_data").alias("owner", "d"))
    return users.select("owner", F.posexplode(F.arrays_zip("d.x", "d.y")).alias("k", "s")).select("owner", "k", "s.x", "s.y")


def delimited(spark: SparkSession, paths: str | list[str], schema: str, sep: str = ",", header: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """Rows of one or more delimited files, joined by union."""
    return spark.read.schema(schema).options(sep=sep, header=header, encoding=encoding).csv(paths)


#: The quoted fields of a line of posts, and the polarity that says neither.
POST_FIELDS, NEUTRAL = ("polarity", "id", "date", "query", "user", "tweet"), 2


def posts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(y, owner, text) of latin-1 files of quoted posts: polarity 0 or 4 as label 0 or 1, neutral ones left out.

    Quotes inside a field stay as they are: fields end at a quote, a comma and a quote.  A line of fewer fields, or with
    a polarity that is no number, is left out too.
    """
    # Whole lines: the text reader knows UTF-8 only, and a line has no such separator.
    lines = spark.read.schema("value string").options(encoding="ISO-8859-1", sep="\x01", quote="", escape="", lineSep="\n").csv(paths)
    part = F.split(F.regexp_replace(F.regexp_replace("value", "\r$", ""), '^"+|"+$', ""), '","', -1)
    field = dict(zip(POST_FIELDS, (F.get(part, F.lit(k)) for k in range(len(POST_FIELDS)))))
    polarity = F.try_to_number(field["polarity"], F.lit("9")).cast("int")
    rows = lines.select(polarity.alias("_p"), field["user"].alias("owner"), field["tweet"].alias("text"))
    return rows.where(F.col("text").isNotNull() & (F.col("_p") != NEUTRAL)).select(F.floor(F.col("_p") / 4).cast("int").alias("y"), "owner", "text")


def sampled_owners(samples: DataFrame, owner: str, n: int, seed: int = 0) -> DataFrame:
    """Samples of ``n`` owners, chosen in md5 order of their names."""
    rank = F.md5(F.concat(F.col(owner).cast("string"), F.lit(f"-{seed}")))
    chosen = samples.select(owner).distinct().orderBy(rank, owner).limit(n)
    return samples.join(chosen, owner, "left_semi")


def top_owners(samples: DataFrame, owner: str, n: int, more_than: int = 0) -> DataFrame:
    """Samples of the ``n`` owners that have most of them (ties by owner), if they have more than ``more_than``."""
    counts = samples.groupBy(owner).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than)
    return samples.join(counts.orderBy(F.desc("_n"), owner).limit(n).select(owner), owner, "left_semi")


def rating_cells(ratings: DataFrame, row: str, col: str, value: str, order: Column) -> DataFrame:
    """(row, col, value) cells; the last rating of a pair holds."""
    return ratings.groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.max_by(value, order).alias("value"))


def _uniform(*keys) -> Column:
    """A number in (0, 1) that only the keys decide."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(*keys) -> Column:
    """A standard normal that only the keys decide, so a task that runs again gives it again."""
    return F.sqrt(-2 * F.log(_uniform(*keys, F.lit("radius")))) * F.cos(2 * 3.141592653589793 * _uniform(*keys, F.lit("angle")))


def regression_weights(features: int, informative: float = 0.9) -> list[float]:
    """From 0 to 100 for the first share of features, 0 for the rest."""
    return [float((k * 37) % 100) if k < int(features * informative) else 0.0 for k in range(features)]


def regression_samples(ids: DataFrame, features: int, noise: float = 1.0, informative: float = 0.9, seed: int = 0) -> DataFrame:
    """(id, x, y) for each id: normal features, their weighted sum and normal noise; the ids alone decide them."""
    x = F.array(*[normal("id", F.lit(k), F.lit(seed)) for k in range(features)])
    weights = F.array(*map(F.lit, regression_weights(features, informative)))
    y = F.aggregate(F.zip_with("x", weights, lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
    return ids.select("id").withColumn("x", x).withColumn("y", y + noise * normal("id", F.lit(seed), F.lit("noise")))


def run_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files of runs with run (their folder) and started (its date prefix); other folders are left out."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/(?:Server/)?[^/]+$", 1)
    found = spark.read.schema(schema).option("recursiveFileLookup", True).json(path).select("*", name.alias("run"))
    started = F.try_to_timestamp(F.substring("run", 1, 16), F.lit("yyyy_MMdd_HHmmss"))
    return found.withColumn("started", started).where(F.col("started").isNotNull())


def flat_offsets(layers: DataFrame, order: str = "layer", size: str = "size") -> DataFrame:
    """Adds start: where each layer begins in the flat vector (one row for each layer)."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return layers.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
