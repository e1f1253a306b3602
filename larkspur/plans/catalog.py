"""Every query of the engine with its SQL twin, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import aggregate, linalg, metrics, partition, strategies
from larkspur.sources.tables import client_params, read
from larkspur.streaming import rounds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_PARAM = """param as (
  select client_id, layer, pos, avg(v) as value from (
    select vec_id % 8 as client_id, cast((k - 1) // 16 as int) as layer, cast((k - 1) % 16 as int) as pos, cast(embedding[k] as double) as v
    from embeddings, (select unnest(range(1, 65)) as k)) group by all),
size as (select vec_id % 8 as client_id, count(*) as n from embeddings group by all),
host as (select layer, pos, avg(value) as value from param group by all)"""
_TRIM = """ranked as (select *, row_number() over (partition by layer, pos order by value, client_id) as r, count(*) over (partition by layer, pos) as c from param),
kept as (select * from ranked where r > floor(c * 0.2) and r <= c - floor(c * 0.2))"""


def _value(df: DataFrame) -> DataFrame:
    return df.select("layer", "pos", F.round("value", 6).alias("value"))


def _host(param: DataFrame) -> DataFrame:
    return aggregate.mean(param)


@query(f"with {_PARAM} select layer, pos, round(avg(value), 6) as value from param group by all")
def a2_mean(spark, sf_dir):
    return _value(aggregate.mean(client_params(spark, sf_dir)[0]))


@query(f"with {_PARAM} select layer, pos, round(sum(value * n) / sum(n), 6) as value from param join size using (client_id) group by all")
def a3_weighted_mean(spark, sf_dir):
    return _value(aggregate.weighted_mean(*client_params(spark, sf_dir)))


@query(f"with {_PARAM} select layer, pos, round(median(value), 6) as value from param group by all")
def a4_median(spark, sf_dir):
    return _value(aggregate.median(client_params(spark, sf_dir)[0]))


@query(f"with {_PARAM}, {_TRIM} select client_id, layer, pos, round(value, 6) as value from kept")
def a5_trim(spark, sf_dir):
    return aggregate.trim(client_params(spark, sf_dir)[0], 0.2).select("client_id", "layer", "pos", F.round("value", 6).alias("value"))


@query(f"with {_PARAM}, {_TRIM} select layer, pos, round(avg(value), 6) as value from kept group by all")
def a6_trimmed_mean(spark, sf_dir):
    return _value(aggregate.trimmed_mean(client_params(spark, sf_dir)[0], 0.2))


@query(f"with {_PARAM}, {_TRIM} select layer, pos, round(sum(value), 6) as value from kept group by all")
def a6_trimmed_sum(spark, sf_dir):
    return _value(aggregate.trimmed_mean(client_params(spark, sf_dir)[0], 0.2, "sum"))


@query(f"with {_PARAM}, {_TRIM} select layer, pos, round(median(value), 6) as value from kept group by all")
def a7_trimmed_median(spark, sf_dir):
    return _value(aggregate.trimmed_median(client_params(spark, sf_dir)[0], 0.2))


_KRUM = """d as (select x.client_id as a, y.client_id as b, x.layer, sqrt(sum((x.value - y.value) ** 2)) as d
  from param x join param y on x.layer = y.layer and x.pos = y.pos and x.client_id <> y.client_id group by all),
score as (select a as client_id, sum(d) as score from d group by a),
best as (select client_id from score order by score, client_id limit 3)"""


@query(f"with {_PARAM}, {_KRUM} select client_id, round(score, 6) as score from score")
def a8_krum_scores(spark, sf_dir):
    return aggregate.krum_scores(client_params(spark, sf_dir)[0]).select("client_id", F.round("score", 6).alias("score"))


@query(f"with {_PARAM}, {_KRUM} select layer, pos, round(avg(value), 6) as value from param where client_id in (select client_id from best) group by all")
def a8_multi_krum(spark, sf_dir):
    return _value(aggregate.krum(client_params(spark, sf_dir)[0], 3))


@query(f"""with {_PARAM}, {_KRUM}, r as (select *, row_number() over (partition by layer, pos order by value, client_id) as r from param where client_id in (select client_id from best))
select layer, pos, round(avg(value), 6) as value from r where r = 2 group by all""")
def a10_bulyan(spark, sf_dir):
    return _value(aggregate.bulyan(client_params(spark, sf_dir)[0], 0.4, 3))


@query(f"""with {_PARAM}, d as (select p.client_id, p.layer, p.pos, p.value - h.value as d, h.value as base from param p join host h using (layer, pos)),
n as (select client_id, layer, sqrt(sum(d * d)) as norm from d group by all)
select layer, pos, round(any_value(base) + sum(d / greatest(1, norm / 0.05)), 6) as value from d join n using (client_id, layer) group by layer, pos""")
def a11_norm_clip(spark, sf_dir):
    param, _ = client_params(spark, sf_dir)
    return _value(aggregate.norm_clip(param, _host(param), 0.05))


@query()
def a11_norm_clip_spectral(spark, sf_dir):
    param, _ = client_params(spark, sf_dir)
    return _value(aggregate.norm_clip_spectral(param, _host(param), 0.05))


_ROUNDS = """ev as (select cast(ts as date) as round, user_id as cid, value as loss, cast(json_extract_string(props, '$.k') as bigint) as n from events)"""


def _rounds(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.to_date("ts").alias("round"), F.col("user_id").alias("cid"), F.col("value").alias("loss"), F.get_json_object("props", "$.k").cast("long").alias("n"))


@query(f"with {_ROUNDS} select round, round(sum(loss * n) / nullif(sum(n), 0), 6) as loss from ev group by round")
def a12_train_loss(spark, sf_dir):
    return _rounds(spark, sf_dir).groupBy("round").agg(F.round(F.sum(F.col("loss") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), 6).alias("loss"))


@query(f"with {_ROUNDS} select round, round(avg(loss), 6) as mean, round(max(loss), 6) as most, round(min(loss), 6) as least, count(*) as n from ev group by round")
def a14_round_stats(spark, sf_dir):
    return _rounds(spark, sf_dir).groupBy("round").agg(F.round(F.avg("loss"), 6).alias("mean"), F.round(F.max("loss"), 6).alias("most"), F.round(F.min("loss"), 6).alias("least"), F.count("*").alias("n"))


@query(f"with {_ROUNDS} select cid, round(stddev_pop(loss), 6) as std, round(avg(loss), 6) as mean, count(*) as n from ev group by cid")
def a28_repeat_mean_std(spark, sf_dir):
    return _rounds(spark, sf_dir).groupBy("cid").agg(F.round(F.stddev_pop("loss"), 6).alias("std"), F.round(F.avg("loss"), 6).alias("mean"), F.count("*").alias("n"))


@query(f"with {_ROUNDS}, d as (select round, avg(loss) as loss from ev group by round) select arg_min(round, (loss, round)) as round, round(min(loss), 6) as loss from d")
def a32_best_round(spark, sf_dir):
    daily = _rounds(spark, sf_dir).groupBy("round").agg(F.avg("loss").alias("loss"))
    return daily.agg(F.min_by("round", F.struct("loss", "round")).alias("round"), F.round(F.min("loss"), 6).alias("loss"))


@query("""with c as (select o_custkey as owner, o_orderdate as step, cast(o_totalprice as double) as loss, o_orderkey as k from orders),
b as (select *, min(loss) over (partition by owner order by step, k rows between unbounded preceding and 1 preceding) as before from c),
i as (select *, sum(case when before is null or loss < before then 1 else 0 end) over (partition by owner order by step, k) as island from b)
select k, round(case when before is null then loss else least(loss, before) end, 6) as best, row_number() over (partition by owner, island order by step, k) - 1 as misses from i""")
def w9_patience(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.struct("o_orderdate", "o_orderkey").alias("step"), F.col("o_totalprice").cast("double").alias("loss"), F.col("o_orderkey").alias("k"))
    return metrics.improvements(orders, "owner", "step", "loss", 5).select("k", F.round("best", 6).alias("best"), F.col("misses").cast("long").alias("misses"))


@query(f"with {_ROUNDS}, d as (select cid, round, sum(loss) as s from ev group by all) select cid, round, round(sum(s) over (partition by cid order by round), 4) as total from d")
def w5_running_total(spark, sf_dir):
    daily = _rounds(spark, sf_dir).groupBy("cid", "round").agg(F.sum("loss").alias("s"))
    return daily.select("cid", "round", F.round(F.sum("s").over(Window.partitionBy("cid").orderBy("round")), 4).alias("total"))


_HIST = """s as (select o_custkey % 5 as owner, cast(o_totalprice as double) as v from orders), e as (select min(v) as lo, max(v) as hi from s),
h as (select owner, cast(least(floor((v - lo) / ((hi - lo) / 10)), 9) as int) as bin, count(*) as c, any_value((hi - lo) / 10) as width from s, e group by 1, 2),
dens as (select owner, bin, c / (sum(c) over (partition by owner) * width) as density, width from h)"""


def _hist(spark, sf_dir):
    return metrics.histogram(read(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("owner"), F.col("o_totalprice").cast("double").alias("v")), "owner", "v")


@query(f"with {_HIST} select owner, bin, round(density * 1000000, 4) as density from dens")
def a25_histogram(spark, sf_dir):
    return _hist(spark, sf_dir).select("owner", "bin", F.round(F.col("density") * 1e6, 4).alias("density"))


_EMD = """g as (select distinct owner, width, b.bin from dens, (select unnest(range(10)) as bin) b),
f as (select g.owner, g.bin, g.width, coalesce(density, 0) as density from g left join dens d on g.owner = d.owner and g.bin = d.bin),
cdf as (select *, sum(density * width) over (partition by owner order by bin) as cdf from f),
emd as (select x.owner as i, y.owner as j, sum(abs(x.cdf - y.cdf) * x.width) as emd from cdf x join cdf y on x.bin = y.bin and x.owner < y.owner group by all)"""


@query(f"with {_HIST}, {_EMD} select i, j, round(emd, 3) as emd from emd")
def a26_emd(spark, sf_dir):
    return metrics.emd(_hist(spark, sf_dir), "owner").select("i", "j", F.round("emd", 3).alias("emd"))


@query(f"with {_HIST}, {_EMD} select round(2 * sum(emd) / 25, 3) as skew from emd")
def a27_skew(spark, sf_dir):
    return metrics.emd(_hist(spark, sf_dir), "owner").agg(F.round(2 * F.sum("emd") / 25, 3).alias("skew"))


@query("select round(corr(l_quantity, l_extendedprice), 6) as corr, round(sqrt(avg((l_quantity * 1500 - l_extendedprice) ** 2)), 2) as rmse, round(avg(abs(l_quantity * 1500 - l_extendedprice)), 2) as mae from (select cast(l_quantity as double) as l_quantity, cast(l_extendedprice as double) as l_extendedprice from lineitem)")
def a33_a36_errors(spark, sf_dir):
    x, y = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    d = x * 1500 - y
    return read(spark, sf_dir, "lineitem").agg(F.round(F.corr(x, y), 6).alias("corr"), F.round(F.sqrt(F.avg(d * d)), 2).alias("rmse"), F.round(F.avg(F.abs(d)), 2).alias("mae"))


_SPLIT = """r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by md5(o_orderkey || '-0'), o_orderkey) as r, count(*) over (partition by o_custkey) as n from orders)
select o_orderkey, o_custkey, case when r <= n - greatest(1, floor(n * 0.1)) - greatest(1, floor(n * 0.1)) then 'train' when r <= n - greatest(1, floor(n * 0.1)) then 'val' else 'test' end as split from r"""


@query(f"with {_SPLIT}")
def r1_r2_natural_split(spark, sf_dir):
    return partition.ratio_split(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("""with r as (select o_orderkey, row_number() over (order by md5(o_orderkey || '-0'), o_orderkey) - 1 as r, count(*) over () // 7 as size from orders)
select o_orderkey, cast(r // size as int) as client_id from r where r // size < 7""")
def r5_iid(spark, sf_dir):
    return partition.iid(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("select o_custkey, count(*) as n from orders group by all order by n desc, o_custkey limit 20")
def t1_top_owners(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)


@query("select c_custkey from customer order by md5(c_custkey || '-1-0'), c_custkey limit 10")
def t4_random_clients(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").orderBy(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("-1-0"))), "c_custkey").limit(10)


_STC = """d as (select p.client_id, p.layer, p.pos, p.value - h.value as value from param p join host h using (layer, pos)),
k as (select *, row_number() over (partition by client_id order by abs(value) desc, layer, pos) as r from d),
t as (select client_id, layer, pos, sign(value) * avg(abs(value)) over (partition by client_id) as value from k where r <= greatest(1, floor(64 * 0.1)))"""


def _delta(param):
    return param.join(_host(param).withColumnRenamed("value", "base"), ["layer", "pos"]).select("client_id", "layer", "pos", (F.col("value") - F.col("base")).alias("value"))


@query(f"with {_PARAM}, {_STC} select client_id, layer, pos, round(value, 6) as value from t")
def q8_t8_ternary(spark, sf_dir):
    return strategies.ternary(_delta(client_params(spark, sf_dir)[0]), 0.1).select("client_id", "layer", "pos", F.round("value", 6).alias("value"))


@query(f"with {_PARAM}, {_STC} select layer, pos, round(sum(value * n) / (select sum(n) from size), 6) as value from t join size using (client_id) group by layer, pos")
def a19_sparse_mean(spark, sf_dir):
    param, sizes = client_params(spark, sf_dir)
    return _value(strategies.sparse_mean(strategies.ternary(_delta(param), 0.1), sizes))


@query(f"""with {_PARAM}, {_STC}, w as (select d.client_id, d.layer, d.pos, 2 * d.value - coalesce(t.value, 0) as value from d left join t using (client_id, layer, pos)),
k2 as (select *, row_number() over (partition by client_id order by abs(value) desc, layer, pos) as r from w),
t2 as (select client_id, layer, pos, sign(value) * avg(abs(value)) over (partition by client_id) as value from k2 where r <= greatest(1, floor(64 * 0.1)))
select w.client_id, w.layer, w.pos, round(coalesce(t2.value, 0), 6) as sent, round(w.value - coalesce(t2.value, 0), 6) as residual from w left join t2 using (client_id, layer, pos)""")
def q8_residuals(spark, sf_dir):
    """The second of two rounds with the same update: what the first didn't send comes on top."""
    delta = _delta(client_params(spark, sf_dir)[0])
    _, left = strategies.ternary_step(delta, 0.1)
    sent, left = strategies.ternary_step(delta, 0.1, left)
    keys = ["client_id", "layer", "pos"]
    both = left.withColumnRenamed("value", "residual").join(sent.withColumnRenamed("value", "sent"), keys, "left")
    return both.select(*keys, F.round(F.coalesce("sent", F.lit(0.0)), 6).alias("sent"), F.round("residual", 6).alias("residual"))


@query(f"""with {_PARAM}, {_STC}, l as (select distinct client_id, client_id % 3 as last_round from param)
select l.client_id, t.layer, t.pos, round(sum(t.value), 6) as value from l join t on t.client_id > l.last_round group by l.client_id, t.layer, t.pos""")
def q8_missed_updates(spark, sf_dir):
    """Client k's sparse update stands for the server's of round k; client k was last there in round k mod 3."""
    param, sizes = client_params(spark, sf_dir)
    updates = strategies.ternary(_delta(param), 0.1).withColumnRenamed("client_id", "round")
    missed = strategies.missed_updates(updates, sizes.select("client_id", (F.col("client_id") % 3).alias("last_round")))
    return missed.select("client_id", "layer", "pos", F.round("value", 6).alias("value"))


@query(f"""with {_PARAM}, d as (select p.layer, p.pos, avg(p.value - h.value) as d from param p join host h using (layer, pos) where p.client_id < 4 group by p.layer, p.pos)
select layer, pos, round(h.value + 0.5 * d, 6) as value, round(h.value / 10 - 0.5 * 2 * d, 6) as control from host h join d using (layer, pos)""")
def q7_control_variates(spark, sf_dir):
    """Half of the clients send updates and control updates of minus twice as much."""
    param, _ = client_params(spark, sf_dir)
    host, sent = _host(param), _delta(param).where("client_id < 4")
    control = host.withColumn("value", F.col("value") / 10)
    x, c = strategies.scaffold_step(host, control, sent, sent.withColumn("value", F.col("value") * -2), 0.5, 0.5)
    return x.join(c.withColumnRenamed("value", "control"), ["layer", "pos"]).select("layer", "pos", F.round("value", 6).alias("value"), F.round("control", 6).alias("control"))


@query(f"with {_PARAM} select p.layer, p.pos, round(2 * p.value + 0.1 * (p.value - h.value), 6) as value from param p join host h using (layer, pos) where p.client_id = 1")
def q5_proximal_gradient(spark, sf_dir):
    param, _ = client_params(spark, sf_dir)
    own = param.where("client_id = 1").select("layer", "pos", "value")
    return _value(strategies.proximal_gradient(own.withColumn("value", 2 * F.col("value")), own, _host(param), 0.1))


_STEP = "h.value as value, g.value - h.value as delta"
_OPT = {"adam": "0.99 * 1e-6 + 0.01 * m * m", "yogi": "1e-6 - 0.01 * m * m * sign(1e-6 - m * m)", "adagrad": "1e-6 + m * m", "none": "1e-6"}


def _opt(variant: str) -> None:
    sql = f"""with {_PARAM}, avgd as (select layer, pos, sum(value * n) / sum(n) as value from param join size using (client_id) group by all),
s as (select g.layer, g.pos, h.value, 0.1 * (g.value - h.value) as m from avgd g join host h using (layer, pos))
select layer, pos, round(value + 0.1 * m / (sqrt({_OPT[variant]}) + 1e-3), 6) as value from s"""

    def run(spark, sf_dir):
        param, sizes = client_params(spark, sf_dir)
        host = _host(param)
        delta = aggregate.weighted_mean(param, sizes).join(host.withColumnRenamed("value", "base"), ["layer", "pos"]).select("layer", "pos", (F.col("value") - F.col("base")).alias("value"))
        return _value(strategies.server_opt_step(host, delta, variant=variant))

    run.__name__ = f"q6_server_{variant}"
    query(sql)(run)


for _name in _OPT:
    _opt(_name)


@query(f"""with {_PARAM}, g as (select layer, pos, sum(value * n) / sum(n) as value from param join size using (client_id) group by all)
select layer, pos, round(h.value - 0.1 * (h.value - g.value), 6) as value from host h join g using (layer, pos)""")
def q4_momentum(spark, sf_dir):
    param, sizes = client_params(spark, sf_dir)
    return _value(strategies.momentum_step(_host(param), aggregate.weighted_mean(param, sizes)))


@query(f"with {_PARAM} select layer, pos, round(sum(round(value * 65536)) / 65536, 4) as value from param group by all")
def q11_secure_sum(spark, sf_dir):
    param, _ = client_params(spark, sf_dir)
    return strategies.unmasked_sum(strategies.masked(param, strategies.pair_seeds(param, "agreed"))).select("layer", "pos", F.round("value", 4).alias("value"))


@query()
def q9_sketch_top(spark, sf_dir):
    vector = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))
    return strategies.unsketch(strategies.sketch(vector, 5, 4096), vector.select("key"), 20, 5, 4096)


@query("""with c as (select vec_id, k - 1 as k, cast(embedding[k] as double) as v from embeddings, (select unnest(range(1, 65)) as k))
select cast(x.k as int) as i, cast(y.k as int) as j, round(sum(x.v * y.v), 4) as value from c x join c y on x.vec_id = y.vec_id and x.k <= y.k group by all""")
def l8_gram(spark, sf_dir):
    return linalg.gram(read(spark, sf_dir, "embeddings"), "embedding", 64).select("i", "j", F.round("value", 4).alias("value"))


@query()
def l9_singular_values(spark, sf_dir):
    values, _ = linalg.svd(read(spark, sf_dir, "embeddings"), "embedding", 64, 8)
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(values)], "k int, value double")


def _ridge_sql(columns: list[str], label: str, table: str, penalty: float) -> str:
    """The normal equations of a few columns and a bias by Cramer's rule, as sums over permutations."""
    names = [*[f"cast({c} as double)" for c in columns], "1.0::double", f"cast({label} as double)"]
    n = len(names) - 1
    sums = ", ".join(f"sum({names[a]} * {names[b]}){f' + {penalty}' if a == b else ''} as g{a}_{b}" for a in range(n) for b in range(n + 1))

    def det(column: int | None) -> str:
        terms = []
        for order in permutations(range(n)):
            sign = "-" if sum(order[a] > order[b] for a in range(n) for b in range(a + 1, n)) % 2 else "+"
            terms.append(f"{sign} " + " * ".join(f"g{a}_{n if b == column else b}" for a, b in enumerate(order)))
        return f"(0 {' '.join(terms)})"

    rows = " union all ".join(f"select cast({k} as int) as k, round({det(k)} / {det(None)}, 4) as value from g" for k in range(n))
    return f"with g as (select {sums} from {table}) {rows}"


@query(_ridge_sql(["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "lineitem", 0.1))
def l14_ridge(spark, sf_dir):
    w = linalg.ridge(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 0.1)
    return spark.createDataFrame([(k, round(float(x), 4)) for k, x in enumerate(w)], "k int, value double")


@query("""with a as (select o_custkey % 20 as r, o_orderkey % 15 as k, sum(cast(o_totalprice as double)) as x from orders group by all)
select a.r as row, b.r as col, round(sum(a.x * b.x) / 1e9, 4) as value from a join a b on a.k = b.k group by all""")
def j17_product(spark, sf_dir):
    a = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("row"), (F.col("o_orderkey") % 15).alias("col")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("value"))
    return linalg.multiply(a, linalg.transpose(a)).select("row", "col", F.round(F.col("value") / 1e9, 4).alias("value"))


@query("select doc_id, trim(regexp_replace(lower(text), '[^A-Za-z<>]+', ' ', 'g')) as words from documents")
def x12_alpha_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(F.lower("text"), "[^A-Za-z<>]+", " ")).alias("words"))


@query(r"select doc_id, regexp_replace(text, '[-+]?[.\d]*[\d]+[:,.\d]*', ' <number> ', 'g') as tagged from documents")
def x3_number_tags(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.tag_numbers(F.col("text")).alias("tagged"))


@query("""select vec_id, [cast(x = label as int) for x in range(10)] as one_hot from embeddings""")
def p3_one_hot(spark, sf_dir):
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: (x == F.col("label")).cast("int"))
    return read(spark, sf_dir, "embeddings").select("vec_id", hot.alias("one_hot"))


@query("select l_orderkey, l_linenumber, round(cast(l_quantity as double) / max(cast(l_quantity as double)) over (), 6) as scaled from lineitem")
def p1_max_scale(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    top = lines.agg(F.max("q").alias("top"))
    return lines.crossJoin(F.broadcast(top)).select("l_orderkey", "l_linenumber", F.round(F.col("q") / F.col("top"), 6).alias("scaled"))


@query("with d as (select cast(ts as date) as round, count(distinct user_id) as n from events group by all) select round, n, n >= 100 as ready from d")
def z4_round_barrier(spark, sf_dir):
    return rounds.round_counts(spark, sf_dir, 100)


@query("select user_id % 50 as cid, cast(ts as date) as round, arg_max(value, (ts, event_id)) as value from events group by all")
def s15_last_rating(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("cid"), F.to_date("ts").alias("round")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
