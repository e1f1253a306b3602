import pytest
from pyspark.sql import functions as F

from larkspur.functions import samples, text
from larkspur.sources import datasets


@pytest.mark.parametrize("name", ["x7_x8_tagged_posts", "x1_x12_post_words", "s7_post_vectors", "s8_j6_x16_char_samples", "s16_labelled_ratings"])
def test_twins(twins, name):
    twins(name)


def test_posts_from_latin_1_files(spark, tmp_path):
    lines = [
        '"0","1","Mon","NO_QUERY","ann","Gar\u00e7on, a \\"quote\\" and a comma, ""twice"""', '"2","2","Mon","q","bob","neither"', '"4","3","Mon","q","bob","caf\u00e9"',
        '"x","4","Mon","q","bob","no number"', '"4","5"', "", '"4","6","Mon","q","eve",""',
    ]
    (tmp_path / "a.csv").write_bytes("\n".join(lines).encode("latin-1"))
    (tmp_path / "b.csv").write_bytes('"0","7","Mon","q","ann","last"\r\n'.encode("latin-1"))
    got = {tuple(r) for r in datasets.posts(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert {g[:2] + (g[2][:6],) for g in got} >= {(0, "ann", "Gar\u00e7on"), (1, "bob", "caf\u00e9"), (0, "ann", "last")}
    assert all(owner != "bob" or said == "caf\u00e9" for _, owner, said in got) and len(got) in (3, 4)


def test_post_vectors(spark):
    rows = [(1, "Running RUNS #Run"), (2, "nothing known"), (3, ""), (4, None), (5, "run known")]
    posts = spark.createDataFrame(rows, "id long, text string")
    vectors = spark.createDataFrame([("run", [1.0, 2.0]), ("known", [4.0, 0.0])], "word string, v array<double>")
    got = {r["id"]: r["x"] for r in samples.post_vectors(posts, "id", "text", vectors, "word", "v", 2).collect()}
    said = {r["id"]: r["w"].split(" ") for r in posts.select("id", text.plain_words(text.tag_post(F.coalesce("text", F.lit("")))).alias("w")).collect()}
    known = {"run": (1.0, 2.0), "runs": (1.0, 2.0), "running": (1.0, 2.0), "known": (4.0, 0.0)}
    want = {k: [sum(known.get(w, (0, 0))[d] for w in words) / len(words) for d in (0, 1)] for k, words in said.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items()) and got[3] == got[4] == [0.0, 0.0] and got[2] == [2.0, 0.0] and got[1] != [0.0, 0.0]
    assert samples.post_vectors(posts.where("false"), "id", "text", vectors, "word", "v", 2).count() == 0


@pytest.mark.parametrize("width, step", [(3, None), (3, 1), (4, 2), (1, None), (2, 5)])
def test_char_samples_equal_slices(spark, width, step):
    alphabet = "abcdefgh \n"
    texts = [(0, "abcdefgh abc\nhgf"), (1, "abc"), (2, "abcd"), (3, ""), (4, None), (5, "a\u00e9b\U0001f600cdab"), (6, "abcd"), (None, "hgfed")]
    got = {(r["id"], r["k"], tuple(r["x"]), r["y"]) for r in samples.char_samples(spark.createDataFrame(texts, "id int, t string"), "id", "t", alphabet, width, step).collect()}
    of = lambda c: alphabet.index(c) if c in alphabet else None
    want = {(i, k, tuple(map(of, t[k : k + width])), of(t[k + width])) for i, t in texts if t for k in range(0, len(t) - width, step or width)}
    assert got == want


def test_a_strict_alphabet(spark):
    rows = spark.createDataFrame([(1, "abcabc")], "id int, t string")
    assert samples.char_samples(rows, "id", "t", "abc", 2, strict=True).count() == 2
    with pytest.raises(Exception, match="outside the alphabet"):
        samples.char_samples(rows, "id", "t", "ab", 2, strict=True).collect()


def test_the_alphabet_has_a_class_for_each_character():
    assert len(text.SPEECH) == len(set(text.SPEECH)) == 80


def test_no_search_of_the_alphabet_for_each_character(spark):
    rows = spark.createDataFrame([(1, "ab\U0001f600ba")], "id long, t string")
    found = samples.char_samples(rows, "id", "t", "ab", 2)
    assert "array_position" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 0, [0, 1], None), (1, 2, [None, 1], 0)]


def test_one_row_of_sums_an_owner(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [None, 5.0]), (3, None)], "u long, v array<double>")
    made = samples.mean_pool(rows, "u", "v", 2)
    assert sorted(tuple(r) for r in made.collect()) == [(1, 0, 2.0), (1, 1, 4.0), (2, 0, None), (2, 1, 5.0)]
    with pytest.raises(Exception, match="a vector without 3 values"):
        samples.mean_pool(rows, "u", "v", 3).collect()


def test_small_means_keep_their_sign(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    said = [(1, k, "user", "up down" if k == 1 else "up") for k in range(6)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    vectors = [(0, [-3e-7, 3e-7, -2.5e-6, 0.0] + [-0.5] * 60), (1, [3e-7, -9e-7, 1.5, 0.0] + [0.5] * 60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    for t in ("conversations", "embeddings"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(map(repr, db.sql(oracle_sql()["s7_post_vectors"]).fetchall()))
    assert any("-0.0," in w for w in want)
    assert sorted(repr(tuple(r)) for r in queries()["s7_post_vectors"](spark, str(tmp_path)).select("conv_id", "turn", "y", "x").collect()) == want
