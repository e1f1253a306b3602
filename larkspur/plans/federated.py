"""Queries over clients and rounds, with their SQL twins; registered beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.plans.catalog import query
from larkspur.sources import datasets, sinks
from larkspur.sources.tables import read


@query("""select o_orderkey as id, true as near_sum from orders""")
def s17_regression_samples(spark, sf_dir):
    """Made features and targets for each order: without noise a target is its features' weighted sum."""
    made = datasets.regression_samples(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 10, noise=0.0)
    weights = F.array(*map(F.lit, datasets.regression_weights(10)))
    total = F.aggregate(F.zip_with("x", weights, lambda a, w: a * w), F.lit(0.0), lambda s, v: s + v)
    return made.select("id", (F.abs(F.col("y") - total) < 1e-9).alias("near_sum"))


@query("""with c as (select distinct o_custkey from orders), s as (select o_custkey from c order by md5(o_custkey || '-0'), o_custkey limit 25)
select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from s)""")
def s5_t6_sampled_owners(spark, sf_dir):
    return datasets.sampled_owners(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 25)


@query("""with c as (select o_custkey, count(*) as n from orders group by all having count(*) > 5), s as (select o_custkey from c order by n desc, o_custkey limit 25)
select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from s)""")
def s7_top_owners(spark, sf_dir):
    return datasets.top_owners(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 25, 5)


@query("select user_id as row, length(event_type) as col, arg_max(value, (ts, event_id)) as value from events group by all")
def s15_rating_cells(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("kind", F.length("event_type"))
    return datasets.rating_cells(events, "user_id", "kind", "value", F.struct("ts", "event_id")).withColumn("col", F.col("col").cast("long"))


_DAYS = "d as (select cast(ts as date) as round, user_id % 20 as cid, sum(value) as value, avg(value) as loss from events group by all)"


def _days(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.groupBy(F.to_date("ts").alias("round"), (F.col("user_id") % 20).alias("cid")).agg(F.sum("value").alias("value"), F.avg("value").alias("loss"))


@query(f"with {_DAYS} select round, cid, round(value, 4) as value from d where round > (select max(round) from d) - 3")
def k5_latest_rounds(spark, sf_dir):
    return sinks.keep_latest(_days(spark, sf_dir).select("round", "cid", F.round("value", 4).alias("value")), 3)


@query(f"with {_DAYS}, l as (select round, round(avg(loss), 9) as loss from d group by round) select round, cid, round(value, 4) as value from d where round = (select arg_min(round, (loss, round)) from l)")
def k6_best_weights(spark, sf_dir):
    days = _days(spark, sf_dir)
    losses = days.groupBy("round").agg(F.round(F.avg("loss"), 9).alias("loss"))
    return sinks.best_weights(days.select("round", "cid", F.round("value", 4).alias("value")), losses)


@query("select c_custkey, case when c_custkey % 3 = 0 then 'new' else c_mktsegment end as state from customer")
def k7_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"))
    return sinks.upserted(old, old.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("state")), "c_custkey")


@query("select x.n_nationkey as u, y.n_nationkey as v, cast(case when x.n_nationkey < y.n_nationkey then -1 else 1 end as int) as sign from nation x join nation y on x.n_nationkey <> y.n_nationkey")
def j12_peer_signs(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_nationkey").alias("u")).join(n.select(F.col("n_nationkey").alias("v")), F.col("u") != F.col("v"))
    return pairs.withColumn("sign", F.when(F.col("u") < F.col("v"), -1).otherwise(1))


@query("""with c as (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as step, cast(embedding[1] as double) as acc from embeddings),
steps as (select unnest(range(cast((select max(step) + 1 from c) as bigint))) as step), g as (select label, step from (select distinct label from c), steps),
f as (select g.label, g.step, last_value(acc ignore nulls) over (partition by g.label order by g.step) as acc from g left join c using (label, step))
select step, round(avg(acc), 6) as acc from f group by step""")
def a30_w12_padded_curves(spark, sf_dir):
    own = Window.partitionBy("label").orderBy("vec_id")
    c = read(spark, sf_dir, "embeddings").select("label", F.row_number().over(own).alias("step"), F.col("embedding")[0].cast("double").alias("acc")).withColumn("step", F.col("step").cast("long") - 1)
    longest = c.agg(F.max("step").alias("top"))
    grid = c.select("label").distinct().crossJoin(F.broadcast(longest)).select("label", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("step"))
    filled = grid.join(c, ["label", "step"], "left").withColumn("acc", F.last("acc", True).over(Window.partitionBy("label").orderBy("step")))
    return filled.groupBy("step").agg(F.round(F.avg("acc"), 6).alias("acc"))


@query("""with c as (select vec_id, k, cast(embedding[k] as double) as x, cast(embedding[1 + k % 64] as double) as y from embeddings, (select unnest(range(1, 65)) as k))
select vec_id, round(sqrt(least(avg((x - y) ** 2), avg((x + y) ** 2))), 6) as rmse from c group by vec_id""")
def a34_signed_rmse(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    turned = F.concat(F.slice(v, 2, 63), F.slice(v, 1, 1))

    def mean(how):
        return F.aggregate(F.zip_with(v, turned, how), F.lit(0.0), lambda s, x: s + x) / 64

    worst = F.least(mean(lambda a, b: (a - b) * (a - b)), mean(lambda a, b: (a + b) * (a + b)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(worst), 6).alias("rmse"))


@query("select window_start as start, event_type, cast(sum(n) as bigint) as n from (select time_bucket(interval 1 hour, cast(ts as timestamp)) as window_start, event_type, 1 as n from events) group by all")
def z12_hourly_windows(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return hourly.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select user_id, arg_max(event_type, (ts, event_id)) as state, count(*) as heard from events group by all")
def z8_client_state(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("heard"))
