"""Extension points used from outside the package."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import extensions
from larkspur.operators.extensions import DATASETS, HOOKS, MODELS, STRATEGIES, GradientStep, Hooks, run_rounds


def test_query(twins):
    twins("q2_registered_round")


def test_parts_of_ones_own(spark):
    rng = np.random.default_rng(1)
    x, y, c = rng.normal(size=(40, 3)), rng.normal(size=40), np.arange(40) % 4

    @DATASETS.register("mine")
    def mine(spark):
        return spark.createDataFrame([(int(k), v.tolist(), float(t)) for k, v, t in zip(c, x, y)], "client_id int, x array<double>, y double").repartition(3)

    @MODELS.register("shifted")
    def shifted(samples, host):
        return MODELS.get("linear")(samples, host).withColumn("prediction", F.col("prediction") + 0.5)

    @STRATEGIES.register("few")
    class Few(GradientStep):
        def selected(self, clients, round_):
            return clients.where(F.col("client_id") % 2 == round_ % 2)

    calls = []

    @HOOKS.register("all_six")
    class AllSix(Hooks):
        def host_to_local(self, host, round_):
            calls.append(("host_to_local", round_))
            return host.withColumn("value", F.col("value") * 0.5)

        def train_begin(self, samples, host, round_):
            calls.append(("train_begin", round_))
            return samples.withColumn("y", F.col("y") + 1), host

        def upload_begin(self, params, round_):
            calls.append(("upload_begin", round_))
            return params.withColumn("value", F.col("value") + 0.25)

        def aggregate_begin(self, params, round_):
            calls.append(("aggregate_begin", round_))
            return params.withColumn("value", F.col("value") * 2)

        def client_exit(self):
            calls.append("client_exit")

        def host_exit(self):
            calls.append("host_exit")

    host = spark.createDataFrame([(0, k, 0.1 * k) for k in range(3)], "layer int, pos int, value double")
    got = run_rounds(DATASETS.get("mine")(spark), host, STRATEGIES.get("few")(0.3, "shifted"), 2, [HOOKS.get("all_six")()])
    w = 0.1 * np.arange(3)
    for k in range(2):
        sent, total, n = w * 0.5, 0, 0
        for client in (k, k + 2):
            a, b = x[c == client], y[c == client] + 1
            total, n = total + 2 * (sent - 0.3 * ((a @ sent + 0.5 - b)[:, None] * a).mean(0) + 0.25) * len(a), n + len(a)
        w = total / n
    assert np.allclose([r["value"] for r in got.orderBy("pos").collect()], w)
    assert calls == [(name, k) for k in range(2) for name in ("host_to_local", "train_begin", "upload_begin", "aggregate_begin")] + ["client_exit", "host_exit"]


def test_names_are_taken_once_and_known():
    own = extensions.Registry("thing")
    own.register("a")(1)
    with pytest.raises(ValueError):
        own.register("a")(2)
    with pytest.raises(KeyError, match="there are: a"):
        own.get("b")
    assert own.names() == ["a"]


def test_ranks_of_a_frequent_label(spark):
    from larkspur.functions import samples

    rows = [(k, None if k % 50 == 0 else 7 if k % 3 else k % 5, None if k == 9 else (k * 37) % 101) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, label int, key int").repartition(4)
    got = {r["id"]: r["place"] for r in samples.by_label(df, "label", "key", 8).collect()}
    assert sorted(got.values()) == list(range(500))
    first = lambda v: (v is not None, v)
    order = sorted(rows, key=lambda r: got[r[0]])
    assert all((first(a[1]), first(a[2])) <= (first(b[1]), first(b[2])) for a, b in zip(order, order[1:]))
