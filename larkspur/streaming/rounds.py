"""The round barrier over a stream of update messages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.tables import read


def first_messages(messages: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key's first message; repeats within ``late`` are dropped, and state older than that is forgotten."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def round_counts(spark: SparkSession, sf_dir: str, expected: int) -> DataFrame:
    """(round, n, ready) from a stream of events: clients heard in each round, each once.

    A round is ready once ``expected`` clients have reported.  The stream runs
    until it has read what there is and appends first messages to a file sink in
    the shared folder; state is spread over tasks by round and client.
    """
    schema = read(spark, sf_dir, "events").schema
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        import tempfile

        folder = tempfile.mkdtemp(prefix="larkspur-")  # one machine: tests
    path = f"{folder}/rounds-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    messages = source.select(F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("round"), "user_id")
    heard = first_messages(messages, "ts", ["round", "user_id"]).select("round", "user_id")
    heard.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/heard").awaitTermination()
    found = spark.read.schema("round date, user_id long").parquet(f"{path}/heard")
    return found.groupBy("round").agg(F.count("*").alias("n")).select("round", "n", (F.col("n") >= expected).alias("ready"))
