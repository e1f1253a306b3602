import pytest
from pyspark.sql import functions as F

from larkspur.operators import sketches
from larkspur.operators.sketches import Shape

SHAPE = Shape(rows=5, buckets=512, bits=20, step=4)


@pytest.mark.parametrize("name", ["q9_t9_heaviest_keys", "q9_sketched_rounds"])
def test_twins(twins, name):
    twins(name)


def _vector(spark, n=3000):
    """Heavy keys of both signs far apart, two of them neighbours that cancel, over light ones."""
    heavy = {5: 900.0, 777_777: -800.0, 1_048_575: 700.0, 40_000: 600.0, 40_001: -600.0}
    light = spark.range(n).select((F.col("id") * 331 % (1 << 20)).alias("key"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("value"))
    return light.where(~F.col("key").isin(*heavy)).union(spark.createDataFrame(list(heavy.items()), "key long, value double")), heavy


def test_heavy_keys_without_a_list(spark):
    vector, heavy = _vector(spark)
    table = sketches.settled(sketches.hierarchy(vector, SHAPE))
    got = {r["key"]: r["value"] for r in sketches.heaviest(table, 5, SHAPE, 32).collect()}
    assert got.keys() == heavy.keys() and all(abs(got[k] - v) < 20 for k, v in heavy.items())
    assert table.count() <= SHAPE.levels * SHAPE.rows * SHAPE.buckets


def test_no_scan_of_the_vector_behind_a_settled_sketch(spark, tmp_path):
    vector, _ = _vector(spark)
    vector.write.parquet(str(tmp_path / "v"))
    table = sketches.settled(sketches.hierarchy(spark.read.parquet(str(tmp_path / "v")), SHAPE))
    plan = sketches.heaviest(table, 5, SHAPE, 32)._jdf.queryExecution().toString()
    assert "parquet" not in plan.lower()


def test_linear(spark):
    vector, _ = _vector(spark, 200)
    cells = lambda t: {(r["level"], r["row"], r["bucket"]): r["value"] for r in t.collect() if abs(r["value"]) > 1e-9}
    parts = vector.withColumn("client_id", F.pmod("key", F.lit(3)))
    sizes = spark.createDataFrame([(0, 1), (1, 2), (2, 5)], "client_id long, n_train long")
    mean = sketches.weighted(sketches.hierarchy(parts, SHAPE, ["client_id"]), sizes)
    plain = parts.join(sizes, "client_id").select("key", (F.col("value") * F.col("n_train") / 8).alias("value"))
    got, want = cells(mean), cells(sketches.hierarchy(plain, SHAPE))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    one = sketches.hierarchy(vector, SHAPE)
    assert not cells(sketches.combined((one, 2.0), (one, -2.0)))


def test_error_keeps_what_was_not_sent(spark):
    rows = [(r, c, key, v) for r in (0, 1, 2) for c in (0, 1) for key, v in ((3, 50.0), (900, -30.0), (70_000, 20.0)) if r < 2]
    updates = spark.createDataFrame(rows, "round long, client_id long, key long, value double")
    sizes = spark.createDataFrame([(0, 1), (1, 3)], "client_id long, n_train long")
    got = [(r["round"], r["key"], round(r["value"], 6)) for r in sketches.run_rounds(updates, sizes, [0, 1, 2], 1, SHAPE, 16, rho=0.5).orderBy("round").collect()]
    momentum, error, want = {}, {}, []
    for r in range(3):
        mean = {3: 50.0, 900: -30.0, 70_000: 20.0} if r < 2 else {}
        momentum = {k: 0.5 * momentum.get(k, 0.0) + mean.get(k, 0.0) for k in (3, 900, 70_000)}
        error = {k: error.get(k, 0.0) + v for k, v in momentum.items()}
        best = min(error, key=lambda k: (-abs(error[k]), k))
        want.append((r, best, round(error[best], 6)))
        error[best] = 0.0
    assert got == want


def test_odd_input(spark):
    none = spark.createDataFrame([], "key long, value double")
    assert sketches.heaviest(sketches.hierarchy(none, SHAPE), 3, SHAPE).count() == 0
    nulls = spark.createDataFrame([(None, 1.0), (4, None), (9, 2.0), (9, 3.0)], "key long, value double")
    assert [tuple(r) for r in sketches.heaviest(sketches.hierarchy(nulls, SHAPE), 3, SHAPE).collect()] == [(9, 5.0)]
    with pytest.raises(Exception, match="doesn't fit"):
        sketches.hierarchy(spark.createDataFrame([(1 << 20, 1.0)], "key long, value double"), SHAPE).collect()
    with pytest.raises(ValueError):
        Shape(bits=63)


def test_exact_where_no_key_stands_out(spark):
    """Far more keys than buckets, none of them heavy: estimates alone are wrong here."""
    shape, k = Shape(rows=3, buckets=64, bits=20, step=4), 5
    flat = spark.range(5000).select((F.col("id") % 2).alias("round"), (F.col("id") % 3).alias("client_id"), (F.col("id") % 2500).alias("key"), (((F.col("id") * 7919) % 5003) / 4 - 600).alias("value"))
    sums: dict[int, dict[int, float]] = {0: {}, 1: {}}
    sizes = {0: 1, 1: 2, 2: 5}
    rows = [tuple(r) for r in flat.collect()]
    for r, c, key, v in rows:
        sums[r][key] = sums[r].get(key, 0.0) + v * sizes[c] / 8
    order = lambda d: sorted(d, key=lambda x: (-round(abs(d[x]), 6), x))[:k]
    plain: dict[int, float] = {}
    for _, _, key, v in rows:
        plain[key] = plain.get(key, 0.0) + v
    found = sketches.heaviest(sketches.hierarchy(flat, shape), k, shape, 8)
    got = [(r["key"], round(r["value"], 6)) for r in sketches.checked(flat, found, k).collect()]
    assert got == [(x, round(plain[x], 6)) for x in order(plain)]
    assert [tuple(r) for r in sketches.checked(flat, found.limit(0), 1).select("key").collect()] == [(order(plain)[0],)]

    momentum, error, want = {}, {}, []
    for r in (0, 1):
        momentum = {x: 0.9 * momentum.get(x, 0.0) + sums[r].get(x, 0.0) for x in momentum | sums[r]}
        error = {x: error.get(x, 0.0) + v for x, v in momentum.items()}
        want += [(r, x, round(error[x], 6)) for x in order(error)]
        error |= dict.fromkeys(order(error), 0.0)
    table = spark.createDataFrame(list(sizes.items()), "client_id long, n_train long")
    made = sketches.run_rounds(flat, table, [0, 1], k, shape, 8, exact=True).collect()
    assert sorted((r["round"], r["key"], round(r["value"], 6)) for r in made) == sorted(want)
