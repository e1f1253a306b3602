"""Queries of protocols over rounds: state in a stream, sums that survive dropouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import secret_sharing
from larkspur.plans.catalog import query
from larkspur.sources.tables import read
from larkspur.streaming import client_state

_CLIENTS, _UNIT, _SLICES = 20, 5000, 5
_MESSAGE = "client_id long, round long, ts timestamp, id long, value long"
_MESSAGES_SQL = """m as (select user_id % 20 as client_id, cast(epoch(date_trunc('day', ts)) // 86400 as bigint) - case when event_id % 7 = 0 then 2 else 0 end as round, ts, event_id as id,
  cast(round(value * 100) as bigint) as value from events),
late as (select *, epoch_us(ts) >= (round + 2) * 86400000000 as is_late from m),
edge as (select max(epoch_ms(ts)) - 86400000 as mark from m),
ranked as (select late.*, row_number() over (partition by client_id, round order by ts, id) as r from late, edge where not is_late and (round + 2) * 86400000 <= mark),
firsts as (select client_id, round, id, sum(value) over (partition by client_id order by round) as s, value from ranked where r = 1),
sent as (select *, cast(floor(s / 5000.0) * 5000 as bigint) as upto, cast(floor((s - value) / 5000.0) * 5000 as bigint) as before from firsts)"""


def _messages(spark, sf_dir):
    """Events as messages for their day's round; every seventh is for the round of two days before."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.floor(F.unix_timestamp("ts") / 86400) - F.when(F.col("event_id") % 7 == 0, 2).otherwise(0)
    return e.select((F.col("user_id") % _CLIENTS).alias("client_id"), day.cast("long").alias("round"), "ts", F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("value"))


@query(f"""with {_MESSAGES_SQL}
select 'sent' as kind, client_id, round, id, upto - before as sent, s - upto as residual from sent
union all select 'doubled', client_id, round, id, null, null from ranked where r > 1
union all select 'late', client_id, round, id, null, null from late where is_late""".replace("s - upto as residual", "cast(s - upto as bigint) as residual"))
def z4_z5_z10_client_state(spark, sf_dir):
    """Residuals, closed rounds, repeats and late messages out of a stream of five micro-batches."""
    folder = client_state.own_folder(spark, "messages")
    client_state.in_time_slices(_messages(spark, sf_dir), f"{folder}/in", _SLICES)
    return client_state.run(spark, f"{folder}/in", _MESSAGE, _UNIT, folder)


@query("""with m as (select time_bucket(interval 1 hour, cast(ts as timestamp)) as start, event_type, cast(ts as timestamp) as ts from events),
edge as (select max(ts) - interval 1 day as mark from m)
select start, event_type, count(*) as n from m, edge where start + interval 1 hour <= mark group by all""")
def z12_streamed_windows(spark, sf_dir):
    """Counts by hour of a stream in five micro-batches, each window given once the watermark has passed it."""
    folder = client_state.own_folder(spark, "windows")
    events = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    client_state.in_time_slices(events, f"{folder}/in", _SLICES)
    source = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    hourly = source.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = hourly.select(F.col("w.start").alias("start"), "event_type", "n").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    found = spark.read.schema("start timestamp, event_type string, n long").parquet(f"{folder}/out")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with p as (select vec_id % 24 as client_id, k - 1 as pos, avg(cast(embedding[k] as double)) as value from embeddings, (select unnest(range(1, 65)) as k) group by all)
select 0 as layer, pos, round(sum(round(value * 65536) / 65536), 6) as value from p where client_id % 3 <> 1 group by pos""")
def q11_sum_with_dropouts(spark, sf_dir):
    """24 clients share secrets, a third drops out after that; the sum over the others comes off its masks."""
    v = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 24).alias("client_id"), F.posexplode("embedding").alias("pos", "v"))
    params = v.groupBy("client_id", F.lit(0).alias("layer"), F.col("pos").cast("long").alias("pos")).agg(F.avg(F.col("v").cast("double")).alias("value"))
    clients = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 24).alias("client_id")).distinct()
    keys, near = secret_sharing.client_keys(clients, "entropy"), secret_sharing.ring(clients, 5)
    messages = secret_sharing.shared_out(keys, near, 4)
    sent = secret_sharing.masked(params, secret_sharing.pair_masks(keys, near)).where("client_id % 3 != 1")
    found = secret_sharing.unmasked_sum(sent, clients, near, keys.select("client_id", "public"), messages, 4)
    return found.select("layer", "pos", F.round("value", 6).alias("value"))
