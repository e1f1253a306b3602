import hashlib
import random

import pytest

from larkspur.operators import settings

RUNS, PAST = "run string, lr double", "run string, at int, path string"


@pytest.mark.parametrize("name", ["s24_history_of_runs", "j8_unfinished_runs", "s24_forgotten_runs"])
def test_twins(twins, name):
    twins(name)


def _names(rng, n):
    return ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(n)] + [None]


def _plain(name, past):
    fits = [h for h in past if None not in (name, h[0]) and (h[0].startswith(name) or name.startswith(h[0]))]
    return min(fits, key=lambda h: (h[1], h[0])) if fits else None


@pytest.mark.parametrize("seed", range(3))
def test_the_first_related_row(spark, seed):
    rng = random.Random(seed)
    runs = [(n, k / 10) for k, n in enumerate(_names(rng, 12))]
    past = [(n, rng.randint(0, 5), f"logs/{k}") for k, n in enumerate([x for x in _names(rng, 8) if x is None or len(x) > 2])]
    past = list({(n, at): (n, at, p) for n, at, p in past}.values())
    r, h = spark.createDataFrame(runs, RUNS), spark.createDataFrame(past, PAST)
    key = lambda rows: sorted(rows, key=str)
    got = [(x["run"], x["lr"], x["found"] and (x["found"]["run"], x["found"]["at"], x["found"]["path"])) for x in settings.looked_up(r, h, "at").collect()]
    assert key(got) == key([(n, lr, _plain(n, past)) for n, lr in runs])
    left = [tuple(x) for x in settings.unfinished(r, h, "at").collect()]
    assert key(left) == key([x for x in runs if _plain(x[0], past) is None])
    gone = ["aab", "b" * 3, None]
    kept = [tuple(x) for x in settings.forgotten(h, spark.createDataFrame([(g,) for g in gone], "run string")).collect()]
    assert key(kept) == key([x for x in past if x[0] is None or not any(g and x[0].startswith(g) for g in gone)])


def test_recording(spark):
    past = spark.createDataFrame([("abc-1", 1, "a"), ("x", 2, "b")], PAST)
    news = spark.createDataFrame([("abc", 3, "c"), ("xyz", 3, "d"), ("new", 5, "late"), ("new", 4, "first"), (None, 6, "e"), ("abc-2", 7, "f")], PAST)
    got = {tuple(r) for r in settings.recorded(past, news, "at").collect()}
    assert got == {("abc-1", 1, "a"), ("x", 2, "b"), ("new", 4, "first"), ("abc-2", 7, "f")}


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], PAST), spark.createDataFrame([("a", 0.1)], RUNS)
    assert [tuple(r) for r in settings.unfinished(one, none, "at").collect()] == [("a", 0.1)]
    assert settings.looked_up(one.where("false"), none, "at").count() == 0 and settings.forgotten(none, one).count() == 0 and settings.recorded(none, none, "at").count() == 0


def test_no_names_through_the_driver(spark):
    runs, past = spark.createDataFrame([("a", 0.1)], RUNS), spark.createDataFrame([("ab", 1, "x")], PAST)
    made = [settings.looked_up(runs, past, "at"), settings.unfinished(runs, past, "at"), settings.with_history(runs, past), settings.forgotten(past, runs)]
    for df in made:
        assert df.collect() is not None and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_prefix_pairs(twins):
    twins("j19_runs_by_prefix")


def test_short_names_keep_their_pairs(spark, tmp_path):
    from __spark_entry__ import queries

    spark.createDataFrame([(k,) for k in range(32, 67)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, 32 + k % 35) for k in range(320)] + [(999, None)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    of = lambda owner, k: hashlib.md5(f"{owner}run".encode()).hexdigest()[: 1 + k % 32]
    runs, past = [(c, of(c, c)) for c in range(32, 67)], [(o, of(32 + o % 35, o)) for o in range(320)]
    want = sorted((c, o, r, h) for c, r in runs for o, h in past if r.startswith(h) or h.startswith(r))
    assert any(len(r) <= 3 and len(h) <= 30 for _, _, r, h in want)
    assert sorted(tuple(r) for r in queries()["j19_runs_by_prefix"](spark, str(tmp_path)).select("c_custkey", "o_orderkey", "run", "history_run").collect()) == want


def test_prefixes_are_made_after_dealing(spark, monkeypatch):
    monkeypatch.setattr(settings, "_LEAST_ROWS", 4)
    rng = random.Random(5)
    runs = [(n, k / 10) for k, n in enumerate(_names(rng, 60) + ["ab\U0001f600", "\u00e9", "\u00e9a", "z"])]
    past = [(n, k, "x") for k, n in enumerate(_names(rng, 150) + ["ab\U0001f600\uffff", "\u00e9", "abababab" * 4, "z"])]
    made = settings.with_history(spark.createDataFrame(runs, RUNS), spark.createDataFrame(past, PAST))
    want = sorted((n, lr, h, at) for n, lr in runs for h, at, _ in past if None not in (n, h) and (n.startswith(h) or h.startswith(n)))
    assert sorted(tuple(r) for r in made.select("run", "lr", "history_run", "at").collect()) == want
    cells = {r["c"] for r in made.select(settings._cell("run", ["a", "ab", "b", "bb"]).alias("c")).distinct().collect()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("Initial Plan")[-1].split("\n") if "Exchange" in x]
    assert cells == set(range(5)) and len(dealt) == 4 and not any("_p#" in x.split("REPARTITION")[0] for x in dealt) and "Sort" not in plan
