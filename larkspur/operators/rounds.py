"""Evaluation, time and traffic of training rounds, as tables of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_metrics(evaluations: DataFrame, value: str = "value", size: str = "size") -> DataFrame:
    """(round, metric, mean, clients) from (round, cid, metric, value, size): means weighted by sample counts."""
    return evaluations.groupBy("round", "metric").agg(
        (F.sum(F.col(value) * F.col(size)) / F.nullif(F.sum(size), F.lit(0))).alias("mean"), F.count_distinct("cid").alias("clients"),
    )


def client_values(evaluations: DataFrame, value: str = "value") -> DataFrame:
    """(round, metric, cid, value): the clients' own values of test metrics, a row each."""
    return evaluations.where(F.startswith("metric", F.lit("test_"))).select("round", "metric", "cid", F.col(value).alias("value"))


def total_seconds(rounds: DataFrame, parts: list[str]) -> DataFrame:
    """(total): the sum over rounds of all parts; a missing part is 0."""
    return rounds.agg(F.sum(sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0.0)))).alias("total"))


def recent_times(rounds: DataFrame, parts: list[str], last: int, order: str = "round") -> DataFrame:
    """The last complete rounds (``last`` at most) and a row Average over all complete ones."""
    whole = rounds.where(" and ".join(f"{p} is not null" for p in parts))
    recent = whole.orderBy(F.desc(order)).limit(last).select(F.col(order).cast("string").alias("round"), *parts)
    return recent.unionByName(whole.agg(*[F.avg(p).alias(p) for p in parts]).withColumn("round", F.lit("Average")))


def elapsed(events: DataFrame, run: str, ts: str) -> DataFrame:
    """Adds elapsed: seconds since the run's first row."""
    first = F.min(ts).over(Window.partitionBy(run))
    return events.withColumn("elapsed", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6)


def traffic(messages: DataFrame, client: str, order: list[str], size: str) -> DataFrame:
    """Adds total_mb: what the client has sent so far."""
    return messages.withColumn("total_mb", to_mb(F.sum(size).over(Window.partitionBy(client).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))))


def before_best(rounds: DataFrame, run: str, order: str, loss: str) -> DataFrame:
    """Rounds before the run's least loss (the first of equals), that round itself left out."""
    best = rounds.groupBy(run).agg(F.min(F.struct(loss, order)).alias("_b")).select(run, F.col(f"_b.{order}").alias("_best"))
    return rounds.join(best, run).where(F.col(order) < F.col("_best")).drop("_best")


def current_only(messages: DataFrame, current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Messages of the round that is open at their time; late and early ones are dropped."""
    return messages.join(current, [*(keys or []), "round"], "left_semi")


def needs_download(turns: DataFrame, client: str, order: str) -> DataFrame:
    """Adds stale: the client's last round lies more than one back, or it never took part."""
    before = F.lag(order).over(Window.partitionBy(client).orderBy(order))
    return turns.withColumn("stale", before.isNull() | (F.col(order) - before > 1))


def summed_over_clients(usage: DataFrame, times: DataFrame, time: str, value: str) -> DataFrame:
    """(time, value): the clients' values at each time added up, 0 where there are none."""
    own = usage.groupBy(time).agg(F.sum(value).alias(value))
    return times.select(time).distinct().join(own, time, "left").select(time, F.coalesce(value, F.lit(0.0)).alias(value))


def to_mb(size: Column) -> Column:
    return size / float(1 << 20)


def to_gb(size: Column) -> Column:
    return size / float(1 << 30)


def seconds_to_hms(seconds: Column) -> Column:
    """h:m:s, each with two digits at least."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
