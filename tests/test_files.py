"""Array files, attribute files and row-range matrices."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.sources import arrays


def test_query(twins):
    twins("k2_s18_r7_matrix_files")


@pytest.fixture()
def files(tmp_path):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (50, 4, 3), np.uint8), rng.integers(0, 10, (50, 1))
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "y.npy", y.ravel())
    return {"image": f"{tmp_path}/x.npy", "label": f"file://{tmp_path}/y.npy"}, x, y.ravel()


def test_arrays_by_ranges_of_rows(spark, files):
    paths, x, y = files
    df = arrays.array_files(spark, paths, 8)
    assert df.rdd.getNumPartitions() == 7 and dict(df.dtypes) == {"row": "bigint", "image": "array<smallint>", "label": "bigint"}
    got = df.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(50)) and [r["label"] for r in got] == y.tolist() and [r["image"] for r in got] == x.reshape(50, -1).tolist()
    made = arrays.image_samples(df, "image", "label", classes=10).orderBy("row").collect()
    assert np.allclose([r["x"] for r in made], x.reshape(50, -1) / 255) and [list(r["y"]).index(1) for r in made] == y.tolist()


def test_only_named_files_are_opened(spark, files):
    paths, _, y = files
    os.remove(paths["image"])
    assert [r["label"] for r in arrays.array_files(spark, {"label": paths["label"]}, 20).orderBy("row").collect()] == y.tolist()


def test_row_filters_prune_partitions(spark, files):
    paths, _, y = files
    df = arrays.array_files(spark, {"label": paths["label"]}, 5).where("row >= 20 and row < 31")
    assert [r["label"] for r in df.orderBy("row").collect()] == y[20:31].tolist() and df.rdd.getNumPartitions() == 3
    assert arrays.array_files(spark, {"label": paths["label"]}, 5).where("row = 70").count() == 0


def test_array_files_that_dont_fit(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros(3))
    np.save(tmp_path / "b.npy", np.zeros(4))
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "e.npy", np.zeros((0, 2), np.float32))
    (tmp_path / "t.npy").write_text("no array")
    for bad in ({"a": "a.npy", "b": "b.npy"}, {"f": "f.npy"}, {"t": "t.npy"}):
        with pytest.raises(Exception, match="different numbers|columns first|no array"):
            arrays.array_files(spark, {c: f"{tmp_path}/{p}" for c, p in bad.items()}).count()
    assert arrays.array_files(spark, {"e": f"{tmp_path}/e.npy"}).count() == 0


def test_attributes_and_identities(spark, tmp_path):
    (tmp_path / "attr.txt").write_text("3\nSmiling Young\n001.jpg  1 -1\n002.jpg -1 -1\n003.jpg  1  1\n")
    (tmp_path / "id.txt").write_text("001.jpg 7\n002.jpg 9\n004.jpg 9\n")
    images = spark.createDataFrame([(f"{k:03}.jpg", [k]) for k in range(1, 5)], "name string, x array<int>")
    got = arrays.labelled_images(images, arrays.attributes(spark, f"{tmp_path}/attr.txt"), arrays.identities(spark, f"{tmp_path}/id.txt"), "Smiling")
    assert sorted((r["name"], r["y"], r["owner"]) for r in got.collect()) == [("001.jpg", 1, 7), ("002.jpg", 0, 9)]


def rows_of(spark, n=40, clients=3):
    return spark.range(n * clients).select((F.col("id") % clients).alias("client_id"), F.floor(F.col("id") / clients).alias("row"), F.array(F.col("id") * 1.0, F.col("id") * 0.5).alias("x"))


def test_matrix_round_trip_and_pruning(spark, tmp_path):
    path = f"{tmp_path}/m"
    arrays.save_matrix(rows_of(spark), path, rows_per_file=16)
    assert sorted(map(str, arrays.load_matrix(spark, path, rows_per_partition=7).collect())) == sorted(map(str, rows_of(spark).collect()))
    # A client's read opens only its files: the others can be gone.
    for p in arrays._parts(path):
        if p.client != 1 or p.first >= 32:
            os.remove(f"{path}/{p.file}")
    part = arrays.load_matrix(spark, path, client=1, first=5, end=20)
    assert [(r["row"], r["x"][0]) for r in part.orderBy("row").collect()] == [(k, 3.0 * k + 1) for k in range(5, 20)]
    assert arrays.load_matrix(spark, path).where("client_id = 1 and row <= 3").count() == 4


def test_matrix_writes_add_and_replace(spark, tmp_path):
    path = f"{tmp_path}/m"
    arrays.save_matrix(rows_of(spark, 5), path)
    arrays.save_matrix(rows_of(spark, 4), path, "append")
    assert arrays.load_matrix(spark, path).count() == 27
    arrays.save_matrix(rows_of(spark, 2), path)
    assert arrays.load_matrix(spark, path).count() == 6 and len(glob.glob(f"{path}/data-*")) == 1
    arrays.save_matrix(rows_of(spark, 2).limit(0), path)
    assert arrays.load_matrix(spark, path).count() == 0


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = f"{tmp_path}/m"
    arrays.save_matrix(rows_of(spark, 5), path)
    before = sorted(glob.glob(f"{path}/**", recursive=True))
    uneven = rows_of(spark, 30).withColumn("x", F.when(F.col("row") == 29, F.array(F.lit(1.0))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="different lengths"):
        arrays.save_matrix(uneven, path)
    assert sorted(glob.glob(f"{path}/**", recursive=True)) == before and arrays.load_matrix(spark, path).count() == 15
