"""Rounds of least squares over clients' lines, by several strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import linear_rounds
from larkspur.operators.extensions import STRATEGIES, run_rounds
from larkspur.operators.sketches import settled
from larkspur.plans.catalog import query
from larkspur.sources.tables import read

_CLIENTS, _WIDTH, _LR = 6, 4, 0.5
_SUMS = f"""l as (select l_suppkey % {_CLIENTS} as c, [1.0::double, l_quantity::double / 50, l_discount::double * 10, l_tax::double * 10] as x, l_extendedprice::double / 1e5 as y from lineitem),
g as (select c, i, j, sum(x[i + 1] * x[j + 1]) as g from l, (select unnest(range({_WIDTH})) as i), (select unnest(range({_WIDTH})) as j) group by all),
b as (select c, i, sum(x[i + 1] * y) as b from l, (select unnest(range({_WIDTH})) as i) group by all),
n as (select c, count(*) as n, sum(y * y) as s from l group by c),
h0 as (select unnest(range({_WIDTH})) as i, 0.0::double as v)"""


def _steps_sql(round_: int, steps: int, mu: float = 0.0, gap: str | None = None, only: str = "true") -> str:
    """Local steps of a round from h{round_} on, as w{round_}_{steps}."""
    out = [f"w{round_}_0 as (select c, i, v from n, h{round_} where {only})"]
    for k in range(steps):
        w = f"w{round_}_{k}"
        out.append(f"""w{round_}_{k + 1} as (select w.c, w.i, any_value(w.v) - {_LR} * ((sum(g.g * u.v) - any_value(b.b)) / any_value(n.n) + {mu} * (any_value(w.v) - any_value(h.v)){' + any_value(gap.v)' if gap else ''}) as v
  from {w} w join {w} u on u.c = w.c join g on g.c = w.c and g.i = w.i and g.j = u.i join b on b.c = w.c and b.i = w.i join n on n.c = w.c join h{round_} h on h.i = w.i{f' join {gap} gap on gap.c = w.c and gap.i = w.i' if gap else ''} group by w.c, w.i)""")
    return ",\n".join(out)


def _rounds_sql(rounds: int, steps: int, mu: float = 0.0) -> str:
    out = [_SUMS]
    for r in range(rounds):
        out += [_steps_sql(r, steps, mu), f"h{r + 1} as (select i, sum(v * n) / sum(n) as v from w{r}_{steps} join n using (c) group by i)"]
    return ",\n".join(out)


def _statistics(spark, sf_dir):
    """Suppliers' lines at clients; the price is told from quantity, discount and tax."""
    line = read(spark, sf_dir, "lineitem")
    x = F.array(F.lit(1.0), F.col("l_quantity").cast("double") / 50, F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 10)
    samples = line.select((F.col("l_suppkey") % _CLIENTS).alias("client_id"), x.alias("x"), (F.col("l_extendedprice").cast("double") / 1e5).alias("y"))
    return settled(linear_rounds.statistics(samples, _WIDTH))


def _trained(spark, sf_dir, rounds, **options):
    stats = _statistics(spark, sf_dir)
    host = run_rounds(stats, linear_rounds.zeros(stats), STRATEGIES.get("least_squares")(_LR, **options), rounds, settle=settled)
    return host.select("layer", "pos", F.round("value", 6).alias("value"))


@query(f"with {_rounds_sql(3, 2)} select 0 as layer, cast(i as int) as pos, round(v, 6) as value from h3")
def q2_average_rounds(spark, sf_dir):
    """Three rounds of two local steps, clients weighted by their lines."""
    return _trained(spark, sf_dir, 3, steps=2)


@query(f"with {_rounds_sql(2, 3, 0.25)} select 0 as layer, cast(i as int) as pos, round(v, 6) as value from h2")
def q5_proximal_rounds(spark, sf_dir):
    """Two rounds of three local steps that are held near the host's parameters."""
    return _trained(spark, sf_dir, 2, steps=3, mu=0.25)


_CENTRAL = ["ga as (select i, j, sum(g) as g from g group by all)", "ba as (select i, sum(b) as b from b group by all)", "na as (select sum(n) as n from n)", "z0 as (select * from h0)"] + [
    f"z{r + 1} as (select w.i, any_value(w.v) - {_LR} * (sum(ga.g * u.v) - any_value(ba.b)) / any_value(na.n) as v from z{r} w join ga on ga.i = w.i join z{r} u on u.i = ga.j join ba on ba.i = w.i, na group by w.i)" for r in range(4)
]


@query(f"with {_rounds_sql(4, 1)}, {', '.join(_CENTRAL)} select 0 as layer, cast(i as int) as pos, round(h4.v, 6) as value, round(z4.v, 6) as central from h4 join z4 using (i)")
def q3_l17_gradient_rounds(spark, sf_dir):
    """Four rounds of averaged gradients beside descent over all lines in one place."""
    stats = _statistics(spark, sf_dir)
    start, step = linear_rounds.zeros(stats), STRATEGIES.get("least_squares")(_LR)
    ours = run_rounds(stats, start, step, 4, settle=settled)
    whole = run_rounds(settled(linear_rounds.pooled(stats)), start, step, 4, settle=settled)
    return ours.join(whole.withColumnRenamed("value", "central"), ["layer", "pos"]).select("layer", "pos", F.round("value", 6).alias("value"), F.round("central", 6).alias("central"))


@query(f"""with {_rounds_sql(3, 2)}, t as (select c, avg((list_dot_product(x, w) - y) ** 2) as mse, count(*) as n from l, (select list(v order by i) as w from h3) group by c)
select cast(c as bigint) as client_id, n as n_train, round(mse, 6) as mse from t""")
def l17_a13_client_errors(spark, sf_dir):
    """Each client's mean squared error under the averaged parameters, from its sums."""
    stats = _statistics(spark, sf_dir)
    host = run_rounds(stats, linear_rounds.zeros(stats), STRATEGIES.get("least_squares")(_LR, steps=2), 3, settle=settled)
    return linear_rounds.squared_errors(stats, host).select("client_id", "n_train", F.round("mse", 6).alias("mse"))


def _controls_sql(rounds: int, steps: int, server_lr: float, share: float) -> str:
    """Clients of the round's parity take part; o are the clients' controls and s the server's."""
    out = [_SUMS, "s0 as (select i, 0.0::double as v from h0)", "o0 as (select c, i, 0.0::double as v from n, h0)"]
    for r in range(rounds):
        out += [
            f"gap{r} as (select o.c, i, s.v - o.v as v from o{r} o join s{r} s using (i) where o.c % 2 = {r % 2})",
            _steps_sql(r, steps, gap=f"gap{r}", only=f"c % 2 = {r % 2}"),
            f"d{r} as (select w.c, i, w.v - h.v as d, (h.v - w.v) / ({steps} * {_LR}) - gap.v - o.v as k from w{r}_{steps} w join h{r} h using (i) join gap{r} gap using (c, i) join o{r} o using (c, i))",
            f"m{r} as (select i, sum(d * n) / sum(n) as d, sum(k * n) / sum(n) as k from d{r} join n using (c) group by i)",
            f"h{r + 1} as (select i, h.v + {server_lr} * d as v from h{r} h join m{r} using (i))", f"s{r + 1} as (select i, s.v + {share} * k as v from s{r} s join m{r} using (i))",
            f"o{r + 1} as (select c, i, o.v + coalesce(k, 0) as v from o{r} o left join d{r} using (c, i))",
        ]
    return ",\n".join(out)


@query(f"with {_controls_sql(4, 2, 0.5, 0.5)} select cast(c as bigint) as client_id, cast(i as int) as pos, round(h4.v, 6) as value, round(s4.v, 6) as control, round(o4.v, 6) as own_control from o4 join h4 using (i) join s4 using (i)")
def q7_control_rounds(spark, sf_dir):
    """Four rounds of half the clients with control variates on both sides."""
    stats = _statistics(spark, sf_dir)
    host = control = linear_rounds.zeros(stats)
    own = stats.select("client_id").crossJoin(control).where("false")
    for r in range(4):
        host, control, own = (settled(x) for x in linear_rounds.control_round(stats.where(F.col("client_id") % 2 == r % 2), host, control, own, _LR, 2, 0.5, 0.5))
    both = own.withColumnRenamed("value", "own").join(host, ["layer", "pos"]).join(control.withColumnRenamed("value", "control"), ["layer", "pos"])
    return both.select("client_id", "pos", F.round("value", 6).alias("value"), F.round("control", 6).alias("control"), F.round("own", 6).alias("own_control"))
