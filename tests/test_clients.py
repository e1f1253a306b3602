"""What SQL can't say of the client, settings and matrix operators, against plain versions."""

import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import stem, text
from larkspur.operators import linalg, partition, rounds, settings
from larkspur.plans import clients
from larkspur.sources import sinks

DATA = "/root/testdata/sf0.001"


def test_features_are_not_dealt_out_by_class(spark):
    with pytest.raises(ValueError):
        partition.split_cells(spark.range(1).selectExpr("id as row", "id as col", "1.0 as value"), "col", 1, 1, non_iid=True)


@pytest.mark.parametrize(("rows", "features", "alpha"), [(40, 12, 1.0), (7, 30, 0.1)])
def test_power_law_singular_values(spark, rows, features, alpha):
    x = np.array([r["x"] for r in linalg.power_law_rows(spark, rows, features, alpha).orderBy("row").collect()])
    s = np.linalg.svd(x, compute_uv=False)[: min(rows, features)]
    assert np.allclose(s / s[0], np.arange(1, len(s) + 1) ** -alpha) and np.isclose(np.linalg.norm(x, axis=1).max(), 1)


def test_reconstruction_errors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, 5))
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    cells = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "row long, col long, value double")
    values = spark.createDataFrame([(k, float(v)) for k, v in enumerate(s[:3])], "col long, s double")
    got = linalg.reconstruction_errors(cells(x), cells(u[:, :3]), values, cells(vt[:3].T)).first()
    d = u[:, :3] * s[:3] @ vt[:3] - x
    assert np.isclose(got["mae"], np.abs(d).mean()) and np.isclose(got["rmse"], np.sqrt((d * d).mean()))


def test_settings_files(spark, tmp_path):
    for run, c in (("a", {"data": {"set": "x", "n": 3}, "seed": None}), ("b", {"data": {"set": "y"}})):
        (tmp_path / run).mkdir()
        (tmp_path / run / "settings.json").write_text(json.dumps(c))
    got = {tuple(r) for r in settings.read_settings(spark, f"{tmp_path}/*/settings.json").collect()}
    assert got == {("a", "data$$set", "x"), ("a", "data$$n", "3"), ("a", "seed", None), ("b", "data$$set", "y")}


def test_results_and_averages(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "run string, acc double")
    for _ in range(2):
        sinks.write_results(df, f"{tmp_path}/r")
        sinks.write_averages(df, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
    assert {tuple(r) for r in spark.read.option("header", True).option("sep", ", ").csv(f"{tmp_path}/c").collect()} == {("a", "1.5"), ("b", "2.0")}


def test_post_tags_in_order(spark):
    def plain(t):
        t = re.sub(r"(http://www\.|https://www\.|http://|https://|www\.)[A-Za-z0-9./\]+\[]*", " <url> ", t)
        t = re.sub(r"@[^\s]+", " <user> ", re.sub(r"\[\[User(.*)\|", " <user> ", t))
        t = re.sub(r"[-+]?[.\d]*[\d]+[:,.\d]*", " <number> ", t).replace("<3", " <heart> ").replace("/", " / ")
        t = re.sub("[.?!:;,()*]+", " ", t)
        def tag(m):
            body = m[1]
            return f" <hashtag> {body.lower()} <allcaps> " if body.upper() == body else " <hashtag> " + " ".join(re.findall("[A-Z]+[^A-Z]*|[^A-Z]+", body)).lower()
        t = re.sub(r"#(\S+)", tag, t)
        t = re.sub(r"[^a-z0-9()<>' `\-]{2,}", lambda m: m[0].lower() + " <allcaps> ", t)
        return re.sub(r"(.)\1{2,}", r"\1 <elong> ", t)

    posts = ["see www.a.b/c now", "[[User x| hi @bob", "so LOUD!!! heyyyy #BigNews #WOW", "can't won't 12:30 a/b", ""]
    df = spark.createDataFrame([(p,) for p in posts], "t string")
    got = df.select(text.tag_post(F.col("t")), text.plain_words(F.lower("t"))).collect()
    assert [r[0] for r in got] == [plain(p) for p in posts]
    assert got[3][1] == "can not will not a b"


def test_rounds_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "round date, cid long, metric string, value double, size long")
    assert rounds.weighted_metrics(empty).count() == 0


def test_stems(spark):
    """Examples of the published rules."""
    pairs = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
    sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky enjoy enjoy by by relational relat conditional condit rational ration
    valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
    feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
    electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
    irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect
    bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll dying die Running run spied spi died die""".split()
    words, want = pairs[::2], pairs[1::2]
    df = spark.createDataFrame([(0, words), (1, None), (2, []), (3, [None, "", "as"])], "id long, words array<string>")
    got = {r["id"]: r["s"] for r in df.select("id", stem.stems(F.col("words")).alias("s")).collect()}
    assert list(zip(words, got[0])) == list(zip(words, want)) and got[1] is None and got[2] == [] and got[3] == [None, "", "as"]


def test_stems_of_documents(spark):
    made = {r["doc_id"]: r["stems"] for r in clients.x13_stems(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        want = None if r["text"] is None else [stem.stem_word(w) for w in re.findall("[a-z]+", r["text"].lower())]
        assert made[r["doc_id"]] == want
