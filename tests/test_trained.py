import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import linear_rounds, strategies
from larkspur.operators.extensions import STRATEGIES, run_rounds
from larkspur.operators.sketches import settled


@pytest.mark.parametrize("name", ["q2_average_rounds", "q3_l17_gradient_rounds", "q5_proximal_rounds", "q7_control_rounds", "l17_a13_client_errors"])
def test_twins(twins, name):
    twins(name)


def _samples(spark, seed=5, hot=200):
    """Client 0 has most of the samples, client 3 a single one."""
    rng, rows = np.random.default_rng(seed), []
    for c, n in {0: hot, 1: 12, 2: 7, 3: 1}.items():
        for _ in range(n):
            x = rng.normal(size=3)
            rows.append((c, x.tolist(), float(x @ [1.0, -2.0, 0.5] + c + rng.normal() / 10)))
    return rows, spark.createDataFrame(rows, "client_id long, x array<double>, y double").repartition(7)


def _plain(rows, rounds, lr, steps, mu=0.0):
    host = np.zeros(3)
    for _ in range(rounds):
        made, sizes = [], []
        for c in sorted({r[0] for r in rows}):
            x, y = np.array([r[1] for r in rows if r[0] == c]), np.array([r[2] for r in rows if r[0] == c])
            w = host.copy()
            for _ in range(steps):
                w = w - lr * (x.T @ (x @ w - y) / len(y) + mu * (w - host))
            made.append(w)
            sizes.append(len(y))
        host = np.average(made, axis=0, weights=sizes)
    return host


def _array(host):
    return np.array([r["value"] for r in host.orderBy("pos").collect()])


def test_statistics_are_the_sums_of_products(spark):
    rows, samples = _samples(spark)
    got = {r["client_id"]: r for r in linear_rounds.statistics(samples, 3).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for c, r in got.items():
        x, y = np.array([s[1] for s in rows if s[0] == c]), np.array([s[2] for s in rows if s[0] == c])
        assert r["n_train"] == len(y) and np.allclose(r["gram"], x.T @ x) and np.allclose(r["moment"], x.T @ y) and np.isclose(r["square"], y @ y)


@pytest.mark.parametrize("rounds, steps, mu", [(1, 1, 0.0), (3, 1, 0.0), (2, 4, 0.0), (2, 3, 0.7)])
def test_rounds_equal_a_plain_loop(spark, rounds, steps, mu):
    rows, samples = _samples(spark)
    stats = linear_rounds.statistics(samples, 3)
    host = run_rounds(stats, linear_rounds.zeros(stats), STRATEGIES.get("least_squares")(0.2, steps, mu), rounds)
    assert np.allclose(_array(host), _plain(rows, rounds, 0.2, steps, mu))


def test_one_step_is_descent_over_all_samples(spark):
    rows, samples = _samples(spark)
    stats = linear_rounds.statistics(samples, 3)
    whole = run_rounds(linear_rounds.pooled(stats), linear_rounds.zeros(stats), STRATEGIES.get("least_squares")(0.2), 3)
    assert np.allclose(_array(whole), _plain([(0, *r[1:]) for r in rows], 3, 0.2, 1))
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    error = linear_rounds.squared_errors(linear_rounds.pooled(stats), whole).first()
    assert error["n_train"] == len(y) and np.isclose(error["mse"], np.mean((x @ _array(whole) - y) ** 2))


def test_control_rounds_equal_a_plain_loop(spark):
    rows, samples = _samples(spark, hot=30)
    stats = settled(linear_rounds.statistics(samples, 3))
    data = {c: (np.array([r[1] for r in rows if r[0] == c]), np.array([r[2] for r in rows if r[0] == c])) for c in range(4)}
    host, control, own = np.zeros(3), np.zeros(3), {c: np.zeros(3) for c in data}
    h = s = linear_rounds.zeros(stats)
    o = stats.select("client_id").crossJoin(s).where("false")
    for parts in [(0, 1, 3), (1, 2), (0, 1)]:
        moved, changed, sizes = [], [], []
        for c in parts:
            x, y = data[c]
            w = host.copy()
            for _ in range(2):
                w = w - 0.1 * (x.T @ (x @ w - y) / len(y) + control - own[c])
            new = own[c] - control + (host - w) / (2 * 0.1)
            moved.append(w - host)
            changed.append(new - own[c])
            sizes.append(len(y))
            own[c] = new
        host, control = host + 0.8 * np.average(moved, axis=0, weights=sizes), control + 0.3 * np.average(changed, axis=0, weights=sizes)
        h, s, o = (settled(d) for d in linear_rounds.control_round(stats.where(F.col("client_id").isin(*parts)), h, s, o, 0.1, 2, 0.8, 0.3))
    assert np.allclose(_array(h), host) and np.allclose(_array(s), control)
    got = {}
    for r in o.orderBy("client_id", "pos").collect():
        got.setdefault(r["client_id"], []).append(r["value"])
    assert sorted(got) == [0, 1, 2, 3] and all(np.allclose(v, own[c]) for c, v in got.items())


def test_odd_samples_are_left_out(spark):
    rows = [(1, [1.0, 2.0], 3.0, "a"), (1, [1.0, 2.0], 3.0, "a"), (None, [1.0, 2.0], 3.0, "b"), (1, None, 3.0, None), (1, [1.0, None], 1.0, ""), (1, [1.0], 1.0, ""), (1, [1.0, 1.0, 1.0], 1.0, ""), (2, [0.0, 0.0], None, "")]
    samples = spark.createDataFrame(rows, "client_id long, x array<double>, y double, n_train string")
    got = linear_rounds.statistics(samples, 2).collect()
    assert [(r["client_id"], r["n_train"], r["square"]) for r in got] == [(1, 2, 18.0)]
    empty = linear_rounds.statistics(samples.where("false"), 2)
    assert empty.count() == 0 and linear_rounds.zeros(empty).count() == 0 and linear_rounds.pooled(empty).count() == 0


def test_steps_of_a_client(spark):
    rows = spark.createDataFrame([(100, 32, 1), (96, 32, 1), (10, 32, 2)], "n long, b int, e int")
    assert [r[0] for r in rows.where("b = 32").select(strategies.local_steps(F.col("n"), 32, 1)).collect()] == [4, 3, 1]
    assert spark.range(1).select(strategies.local_steps(F.lit(10), 4, 2)).first()[0] == 5
