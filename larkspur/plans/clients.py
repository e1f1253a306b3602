"""Queries over client datasets, round messages, settings and factors, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import samples, stem, text
from larkspur.operators import linalg, metrics, partition, rounds, settings
from larkspur.plans.catalog import _ROUNDS, _SPLIT, _rounds, query
from larkspur.sources import datasets
from larkspur.sources.tables import client_params, read


def _evaluations(spark, sf_dir):
    ev = _rounds(spark, sf_dir)
    metric = F.explode(F.array(F.struct(F.lit("val_loss").alias("metric"), F.col("loss").alias("value"), F.col("n").alias("size")), F.struct(F.lit("test_loss").alias("metric"), (2 * F.col("loss")).alias("value"), (F.col("n") + 1).alias("size"))))
    return ev.select("round", "cid", metric.alias("m")).select("round", "cid", "m.*")


@query(f"""with {_ROUNDS}, m as (select round, cid, 'val_loss' as metric, loss as value, n as size from ev union all select round, cid, 'test_loss', 2 * loss, n + 1 from ev)
select round, metric, round(sum(value * size) / nullif(sum(size), 0), 6) as mean, count(distinct cid) as clients, case when metric = 'test_loss' then count(*) end as n_each from m group by round, metric""")
def a13_weighted_metrics(spark, sf_dir):
    told = _evaluations(spark, sf_dir)
    own = rounds.client_values(told).groupBy("round", "metric").agg(F.count("*").alias("n_each"))
    return rounds.weighted_metrics(told).join(own, ["round", "metric"], "left").select("round", "metric", F.round("mean", 6).alias("mean"), "clients", "n_each")


_PARTS = """t as (select cast(ts as date) as round, max(value) filter (where event_type = 'view' and user_id % 10 = 0) as max_train, max(value) filter (where event_type = 'click' and user_id % 10 = 1) as train_agg,
max(value) filter (where event_type = 'purchase' and user_id % 10 = 2) as max_eval, max(value) filter (where event_type = 'error' and user_id % 10 = 3) as eval_agg from events group by 1)"""
_NAMES = ["max_train", "train_agg", "max_eval", "eval_agg"]


def _times(spark, sf_dir):
    kinds = zip(_NAMES, ("view", "click", "purchase", "error"))
    parts = [F.max(F.when((F.col("event_type") == kind) & (F.col("user_id") % 10 == k), F.col("value"))).alias(name) for k, (name, kind) in enumerate(kinds)]
    return read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("round")).agg(*parts)


@query(f"with {_PARTS} select round(sum(coalesce(max_train, 0) + coalesce(train_agg, 0) + coalesce(max_eval, 0) + coalesce(eval_agg, 0)), 4) as total from t")
def a15_total_time(spark, sf_dir):
    return rounds.total_seconds(_times(spark, sf_dir), _NAMES).select(F.round("total", 4).alias("total"))


@query(f"""with {_PARTS}, w as (select * from t where max_train is not null and train_agg is not null and max_eval is not null and eval_agg is not null),
u as ((select cast(round as varchar) as round, max_train, train_agg, max_eval, eval_agg from w order by w.round desc limit 5)
union all select 'Average', avg(max_train), avg(train_agg), avg(max_eval), avg(eval_agg) from w)
select round, round(max_train, 6) as max_train, round(train_agg, 6) as train_agg, round(max_eval, 6) as max_eval, round(eval_agg, 6) as eval_agg from u""")
def a16_recent_times(spark, sf_dir):
    return rounds.recent_times(_times(spark, sf_dir), _NAMES, 5).select("round", *[F.round(c, 6).alias(c) for c in _NAMES])


@query("select event_id, round((epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6, 3) as elapsed from events")
def w6_elapsed(spark, sf_dir):
    return rounds.elapsed(read(spark, sf_dir, "events"), "user_id", "ts").select("event_id", F.round("elapsed", 3).alias("elapsed"))


@query("select event_id, round(sum(1000 * cast(json_extract_string(props, '$.k') as bigint)) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) / 1048576.0, 6) as total_mb from events")
def w7_traffic(spark, sf_dir):
    sent = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (1000 * F.get_json_object("props", "$.k").cast("long")).alias("sent"))
    return rounds.traffic(sent, "user_id", ["ts", "event_id"], "sent").select("event_id", F.round("total_mb", 6).alias("total_mb"))


@query("""with d as (select user_id as run, cast(ts as date) as round, min(value) as loss from events group by all), b as (select run, min(round) as best from (select *, min(loss) over (partition by run) as low from d) where loss = low group by run)
select run, round, round(loss, 6) as loss from d join b using (run) where round < best""")
def w8_before_best(spark, sf_dir):
    daily = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.to_date("ts").alias("round")).agg(F.min("value").alias("loss"))
    return rounds.before_best(daily, "run", "round", "loss").select("run", "round", F.round("loss", 6).alias("loss"))


@query("select event_id from events where cast(json_extract_string(props, '$.k') as bigint) % 5 = day(ts) % 5")
def p8_z5_current_round(spark, sf_dir):
    """Messages name a round; the one that is open at their hour is the day's."""
    told = read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("at"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("round"))
    current = told.select("at").distinct().select("at", (F.dayofmonth("at") % 5).cast("long").alias("round"))
    return rounds.current_only(told, current, ["at"]).select("event_id")


@query("""with d as (select distinct user_id, date_diff('day', date '2024-01-01', cast(ts as date)) as round from events), l as (select *, lag(round) over (partition by user_id order by round) as before from d)
select user_id, round, before is null or round - before > 1 as stale from l""")
def z7_freshness(spark, sf_dir):
    turns = read(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("round")).distinct()
    return rounds.needs_download(turns, "user_id", "round")


@query("with t as (select distinct date_trunc('hour', ts) as h from events), u as (select date_trunc('hour', ts) as h, sum(value) as v from events where user_id % 7 = 0 group by 1) select h, round(coalesce(v, 0), 6) as value from t left join u using (h)")
def j16_usage_by_time(spark, sf_dir):
    ev = read(spark, sf_dir, "events").withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rounds.summed_over_clients(ev.where("user_id % 7 = 0").select("h", "value"), ev, "h", "value").select("h", F.round("value", 6).alias("value"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * 1000 / 1048576.0, 6) as mb, round(l_extendedprice * 1000000 / 1073741824.0, 6) as gb, printf('%02d:%02d:%02d', cast(floor(l_extendedprice) as bigint) // 3600, cast(floor(l_extendedprice) as bigint) % 3600 // 60, cast(floor(l_extendedprice) as bigint) % 60) as hms from lineitem")
def p16_p17_units(spark, sf_dir):
    x = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(rounds.to_mb(x * 1000), 6).alias("mb"), F.round(rounds.to_gb(x * 1e6), 6).alias("gb"), rounds.seconds_to_hms(x).alias("hms"))


@query("""with h as (select o_orderkey, printf('%02d:%02d:%02d', cast(floor(o_totalprice) as bigint) // 3600, cast(floor(o_totalprice) as bigint) % 3600 // 60, cast(floor(o_totalprice) as bigint) % 60) as t from orders)
select o_orderkey, round(60 * cast(split_part(t, ':', 1) as double) + cast(split_part(t, ':', 2) as double) + cast(split_part(t, ':', 3) as double) / 60, 6) as minutes from h""")
def p16_minutes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(metrics.hms_minutes(rounds.seconds_to_hms(F.col("o_totalprice"))), 6).alias("minutes"))


_CFG = """cfg as (select cast(c_custkey as varchar) as run_id, unnest(['data$$set', 'data$$clients', 'strategy', 'seed']) as key_chain, unnest([c_mktsegment, cast(c_nationkey as varchar), 'S' || c_custkey % 3, cast(c_custkey % 7 as varchar)]) as value from customer)"""


def _settings(spark, sf_dir):
    key = F.col("c_custkey")
    pairs = {"data$$set": F.col("c_mktsegment"), "data$$clients": F.col("c_nationkey").cast("string"), "strategy": F.concat(F.lit("S"), (key % 3).cast("string")), "seed": (key % 7).cast("string")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("key_chain"), v.alias("value")) for k, v in pairs.items()]))
    return read(spark, sf_dir, "customer").select(key.cast("string").alias("run_id"), rows.alias("r")).select("run_id", "r.*")


@query(f"with {_CFG} select run_id, value from cfg where key_chain = 'seed'")
def p9_path_value(spark, sf_dir):
    return settings.at_path(_settings(spark, sf_dir), "seed$$value")


@query(f"with {_CFG} select run_id, key_chain, case key_chain when 'seed' then '99' else value end as value from cfg union all select distinct run_id, 'data$$new', 'x' from cfg")
def p11_updated(spark, sf_dir):
    return settings.updated(_settings(spark, sf_dir), spark.createDataFrame([("seed", "99"), ("data$$new", "x")], "key_chain string, value string"))


@query(f"with {_CFG}, s as (select run_id, value as s from cfg where key_chain = 'strategy') select run_id, key_chain, value from cfg join s using (run_id) where not (key_chain = 'data$$clients' and s <> 'S1')")
def p12_strategy_settings(spark, sf_dir):
    return settings.for_strategy(_settings(spark, sf_dir), "strategy", {"data$$clients": "S1"})


@query("select vec_id, list_position(embedding, list_max(embedding)) - 1 as place, len(embedding) as n from embeddings")
def p2_p4_flat_arg_max(spark, sf_dir):
    """A sample of four rows of 16, made flat, and the place of its greatest value."""
    image = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("embedding", r * 16 + 1, F.lit(16)))
    return read(spark, sf_dir, "embeddings").select("vec_id", samples.flat(image).alias("x")).select("vec_id", samples.arg_max(F.col("x")).alias("place"), F.size("x").cast("long").alias("n"))


@query("with i as (select doc_id, source as identity from documents), l as (select doc_id, quality from labels) select identity, count(*) as n, sum(quality) as good from i join l using (doc_id) group by identity")
def j4_identity_labels(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("identity")), read(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").groupBy("identity").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


def _tokens(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 700).alias("token"))
    vectors = read(spark, sf_dir, "embeddings").where("vec_id < 500").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    return samples.token_vectors(ev.repartition("user_id"), vectors, "token", "vector", 64)  # so a task sums some users and not parts of all


@query("""with t as (select user_id, event_id % 700 as token from events)
select user_id, k - 1 as dim, round(avg(coalesce(cast(embedding[k] as double), 0)), 6) as value from t left join (select * from embeddings where vec_id < 500) e on e.vec_id = token, (select unnest(range(1, 65)) as k) group by all""")
def j5_x15_mean_vectors(spark, sf_dir):
    return samples.mean_pool(_tokens(spark, sf_dir), "user_id", "vector", 64).select("user_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("""with w as (select conv_id, turn, role, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')), ' '), lambda x: true) as w from conversations)
select conv_id, turn, role, list_concat(list_resize([]::varchar[], greatest(25 - len(w), 0), ''), case when len(w) > 25 then w[len(w) - 24:] else w end) as words from w""")
def x14_last_words(spark, sf_dir):
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")), " ")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.last_tokens(words, 25).alias("words"))


@query("with n as (select l_partkey as item, count(*) as n from lineitem group by all order by n desc, item limit 500) select item, n, row_number() over (order by item) - 1 as place from n")
def a23_t2_popular_items(spark, sf_dir):
    ratings = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"))
    return samples.popular_items(ratings, "item", 500).select("item", "n", F.col("place").cast("long").alias("place"))


@query("""with r as (select o_custkey as user, l_partkey as item, cast(l_quantity as double) as v from lineitem join orders on l_orderkey = o_orderkey),
n as (select item, count(*) as n from r group by all order by n desc, item limit 20), p as (select item, row_number() over (order by item) - 1 as place from n),
o as (select user, place, max(v) as v from r join p using (item) group by all), u as (select distinct user from o)
select u.user, list(coalesce(o.v, 0.0) order by g.k) as x from u cross join (select unnest(range(20)) as k) g left join o on o.user = u.user and o.place = g.k group by u.user""")
def s16_rating_rows(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return samples.rating_rows(lines.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("double").alias("v")), "user", "item", "v", 20)


@query("select vec_id, label, row_number() over (order by label, vec_id) - 1 as place from embeddings")
def t3_by_label(spark, sf_dir):
    return samples.by_label(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id").select("vec_id", "label", F.col("place").cast("long").alias("place"))


@query(f"select * from (with {_SPLIT}) where split in ('val', 'test')")
def s20_validation_and_test(spark, sf_dir):
    return partition.ratio_split(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").where("split in ('val', 'test')")


@query("select cast(count(*) // count(distinct o_custkey) as bigint) as size from orders")
def a37_client_size(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.floor(F.count("*") / F.count_distinct("o_custkey")).alias("size"))


@query("select distinct p_brand, p_type from part")
def u6_distinct(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("select p_brand, count(distinct p_size) as sizes from part group by p_brand")
def a31_count_distinct(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_size").alias("sizes"))


@query("select o_custkey, list(o_orderkey order by o_orderkey) as shares from orders group by o_custkey")
def u2_shares(spark, sf_dir):
    """Lists of shares by client, put together from two halves."""
    orders = read(spark, sf_dir, "orders")
    halves = [orders.where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("own")) for k in (0, 1)]
    return halves[0].union(halves[1]).groupBy("o_custkey").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("shares"))


@query("select count(*) = 0 as disjoint from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P')")
def u4_disjoint(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    one, two = (orders.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FP")
    return one.intersect(two).agg((F.count("*") == 0).alias("disjoint"))


@query("select r_name, s, lr from region, (select unnest([1, 2, 3]) as s), (select unnest([cast(0.1 as double), cast(0.01 as double)]) as lr)")
def u7_parameter_grid(spark, sf_dir):
    """All combinations of parameter lists; the lists are a call's arguments."""
    grid = spark.createDataFrame([(s, lr) for s in (1, 2, 3) for lr in (0.1, 0.01)], "s int, lr double")
    return read(spark, sf_dir, "region").select("r_name").crossJoin(F.broadcast(grid))


_CELLS = "c as (select o_custkey % 30 as row, o_orderkey % 12 as col, o_custkey % 4 as client, sum(o_totalprice) / 1e5 as value from orders group by all)"


def _cells(spark, sf_dir):
    keys = [(F.col("o_custkey") % 30).alias("row"), (F.col("o_orderkey") % 12).alias("col"), (F.col("o_custkey") % 4).alias("client")]
    return read(spark, sf_dir, "orders").groupBy(*keys).agg((F.sum("o_totalprice") / 1e5).alias("value"))


@query(f"with {_CELLS} select row, col, round(sum(value), 4) as value from c where row >= 5 and row < 20 group by row, col")
def a18_l2_l6_sum_of_slices(spark, sf_dir):
    return linalg.summed(linalg.rows_between(_cells(spark, sf_dir), 5, 20)).select("row", "col", F.round("value", 4).alias("value"))


@query("""with e as (select cast(l_quantity as double) * 1500 as p, cast(l_extendedprice as double) as y from lineitem)
select round(avg(abs(p - y)), 2) as mae, round(avg((p - y) * (p - y)) / 1e6, 4) as mse, round(sqrt(avg((p - y) * (p - y))), 2) as rmse, round(avg(abs((p - y) / nullif(y, 0))), 6) as mape, round(1 - avg((p - y) * (p - y)) / nullif(var_pop(y), 0), 6) as r2 from e""")
def a33_errors(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("double") * 1500).alias("p"), F.col("l_extendedprice").cast("double").alias("y"))
    return linalg.errors(pairs, "p", "y").select(F.round("mae", 2).alias("mae"), F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("rmse", 2).alias("rmse"), F.round("mape", 6).alias("mape"), F.round("r2", 6).alias("r2"))


@query("""with e as (select cast(l_quantity as double) as a, cast(l_extendedprice as double) as b from lineitem), g as (select min(a) as al, max(a) as ah, min(b) as bl, max(b) as bh from e)
select round(corr(a, b), 6) as pearson, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) as cosine, round(sqrt(avg(((a - al) / (ah - al) - (b - bl) / (bh - bl)) ** 2)), 6) as scaled_rmse from e, g""")
def a36_likeness(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"))
    return linalg.likeness(pairs, "a", "b").select(*[F.round(c, 6).alias(c) for c in ("pearson", "cosine", "scaled_rmse")])


@query("""with c as (select vec_id as row, k, cast(embedding[k] as double) as v from embeddings, (select unnest(range(1, 7)) as k) where vec_id < 60),
w as (select x.row as i, y.row as j, sum(case when x.k <= 3 then x.v * y.v else 0 end) as u, sum(case when x.k > 3 then x.v * y.v else 0 end) as v from c x join c y on x.k = y.k group by all)
select round(sqrt(sum((u - v) * (u - v))), 4) as distance from w""")
def a35_projection_distance(spark, sf_dir):
    """The first 60 vectors' dimensions 1 to 3 against 4 to 6: two bases of 60 rows."""
    cells = read(spark, sf_dir, "embeddings").where("vec_id < 60").select(F.col("vec_id").alias("row"), F.posexplode(F.slice("embedding", 1, 6)).alias("k", "v")).withColumn("value", F.col("v").cast("double"))
    u, v = cells.where("k < 3").select("row", F.col("k").alias("col"), "value"), cells.where("k >= 3").select("row", (F.col("k") - 3).alias("col"), "value")
    return linalg.projection_distance(u, v).select(F.round("distance", 4).alias("distance"))


@query("""with c as (select vec_id as row, k - 1 as col, cast(embedding[k] as double) as value from embeddings, (select unnest(range(1, 65)) as k))
select row, col, round(value, 6) as value, cast(case when col < 44 then col // 11 else 4 + (col - 44) // 10 end as int) as client_id from c""")
def r6_r7_split_cells(spark, sf_dir):
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return partition.split_cells(cells.select("row", F.col("col").cast("long").alias("col"), F.round(F.col("value").cast("double"), 6).alias("value")), "col", 64, 6)


_RANKED = "select vec_id, label, row_number() over (partition by label order by md5(vec_id || '-0'), vec_id) - 1 as rank from embeddings"


@query(_RANKED)
def w1_class_ranks(spark, sf_dir):
    return partition.class_ranks(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id").select("vec_id", "label", F.col("rank").cast("long").alias("rank"))


@query("with p as (select vec_id % 8 as client_id, k - 1 as k, avg(cast(embedding[k] as double)) as v from embeddings, (select unnest(range(1, 65)) as k) group by all), h as (select k, avg(v) as v from p group by k) select client_id, k, round((h.v - p.v) / 0.1, 5) as grad from p join h using (k)")
def p14_gradient(spark, sf_dir):
    param, _ = client_params(spark, sf_dir)
    cells = param.select("client_id", (F.col("layer") * 16 + F.col("pos")).cast("long").alias("k"), F.col("value").alias("cur"))
    host = cells.groupBy("k").agg(F.avg("cur").alias("pre"))
    return cells.join(host, "k").select("client_id", "k", F.round((F.col("pre") - F.col("cur")) / 0.1, 5).alias("grad"))


@query("with s as (select r_regionkey as layer, count(*) as size from region join nation on r_regionkey = n_regionkey group by 1) select layer, size, coalesce(sum(size) over (order by layer rows between unbounded preceding and 1 preceding), 0)::bigint as start from s")
def w11_p15_layer_offsets(spark, sf_dir):
    sizes = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("layer")).agg(F.count("*").alias("size"))
    return datasets.flat_offsets(sizes)


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def j9_u3_silent_clients(spark, sf_dir):
    """Selected clients that sent nothing in this round."""
    heard = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(heard, "c_custkey", "left_anti")


@query()
def x13_stems(spark, sf_dir):
    """Stems of the lower-case letter words of all documents, in order."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", stem.stems(words).alias("stems"))
