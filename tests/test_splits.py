"""Allocation of classes to clients, runs by name and by settings, against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.operators import allocation, settings
from larkspur.plans import catalog, splits

NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == splits.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_query(twins, name):
    twins(name)


def test_running_totals_over_stretches(spark):
    rows = [(k % 3, k, (k * 7) % 5) for k in range(400)]
    got = allocation.running(spark.createDataFrame(rows, "c int, k long, n long").repartition(5), ["c"], "k", "n", 16)
    upto = defaultdict(int)
    for c, k, n in rows:
        upto[c] += n
    want, upto = {}, defaultdict(int)
    for c, k, n in rows:
        want[c, k] = (upto[c], upto[c] + n)
        upto[c] += n
    assert {(r["c"], r["k"]): (r["first"], r["end"]) for r in got.collect()} == want


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps_once_each(spark, width):
    rng = random.Random(width)
    one = [(k, a, a + rng.randrange(30)) for k, a in enumerate(rng.randrange(200) for _ in range(40))]
    two = [(k, a, a + rng.randrange(90)) for k, a in enumerate(rng.randrange(200) for _ in range(40))]
    got = allocation.overlaps(spark.createDataFrame(one, "i int, a_first long, a_end long"), spark.createDataFrame(two, "j int, b_first long, b_end long"), width)
    assert Counter((r["i"], r["j"]) for r in got.collect()) == Counter((i, j) for i, a, b in one for j, c, d in two if max(a, c) < min(b, d))


def test_normal_offsets():
    for n, scale in ((0, 1.0), (1, 0.5), (1000, 2.0), (7, 0.0)):
        made = allocation.normal_offsets(n, scale)
        assert sum(c for _, c in made) == n and all(c > 0 for _, c in made) or n == 0
    wide = dict(allocation.normal_offsets(10_000, 1.0))
    assert abs(wide[0] - 3829) < 2 and abs(wide[1] - wide[-1]) <= 1


@pytest.mark.parametrize("scale", [None, 1.5])
def test_everyone_gets_as_much(spark, scale):
    rng = random.Random(1)
    # A class with two thirds of all rows, a null class, and classes that run out.
    rows = [(k, rng.choice([0] * 20 + [1, 2, 3, 4, 5, 6, 7, 8, 9, None])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, label int").withColumn("place", F.lit("clash"))
    made = allocation.skewed_splits(df, "label", "id", 12, 3, scale).collect()
    assert len({r["id"] for r in made}) == len(made) and all(r["place"] == "clash" for r in made)
    assert Counter((r["client_id"], r["split"]) for r in made) == {(c, s): n for c in range(12) for s, n in (("train", 60), ("val", 7), ("test", 7))}
    label = dict(rows)
    assert all(label[r["id"]] == r["label"] for r in made)
    with pytest.raises(ValueError):
        allocation.skewed_splits(df, "label", "id", 500, 2)


def test_many_clients_without_a_loop(spark):
    supply = spark.createDataFrame([(c, c, 300_000) for c in range(10)], "label int, place long, size long")
    wants = allocation.wanted(supply, 100_000, 2, 15)
    grants = allocation.granted(supply, wants, 100_000, 30).cache()
    per = grants.groupBy("client_id").agg(F.sum(F.col("end") - F.col("first")).alias("n"))
    assert per.count() == 100_000 and per.where("n != 30").count() == 0
    per = grants.groupBy("place").agg(F.sum(F.col("end") - F.col("first")).alias("n"), F.min("first").alias("a"), F.max("end").alias("b"))
    assert all((r["n"], r["a"], r["b"]) == (300_000, 0, 300_000) for r in per.collect())


def test_names_that_begin_with_each_other(spark):
    names = ["a", "abc", "abc-1", "b", "2024_01_01_000000_run", "2024_01_01_000000_run_x", "2024_01_01_000000", "zz", None, "", "abc"]
    runs = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "run string, k int")
    history = spark.createDataFrame([(n, k) for k, n in enumerate(["abc", "ab", "abc-1-2", "2024_01_01_000000_run", None, "q", ""])], "run string, h int")
    got = Counter((r["k"], r["h"]) for r in settings.with_history(runs, history).collect())
    want = Counter((r["k"], h["h"]) for r in runs.collect() for h in history.collect() if r["run"] is not None and h["run"] is not None and (r["run"].startswith(h["run"]) or h["run"].startswith(r["run"])))
    assert got == want and settings.with_history(runs.limit(0), history).count() == 0


def test_repeats_by_differing_settings(spark):
    rows = [("r1", "lr", "1"), ("r2", "lr", "1"), ("r3", "lr", "2"), ("r4", "lr", "2"), *[(f"r{k}", "same", "x") for k in range(1, 5)], *[(f"r{k}", "random_seed", str(k)) for k in range(1, 5)], ("r4", "only", "y"), ("r1", "none", None)]
    results = [("r1", "acc", 0.5), ("r2", "acc", 0.7), ("r3", "acc", None), ("r4", "acc", 1.0), ("r1", "time", None)]
    got = settings.by_differing_settings(spark.createDataFrame(rows, "run_id string, key_chain string, value string"), spark.createDataFrame(results, "run_id string, metric string, value double"), ("seed",))
    assert sorted(map(tuple, got.collect())) == [
        ("lr=1", "acc", 2, "0.60000", "0.10000"), ("lr=1", "time", 1, "NA", "NA"), ("lr=2", "acc", 1, "NA", "NA"), ("lr=2,only=y", "acc", 1, "1.00000", "0.00000"),
    ]
