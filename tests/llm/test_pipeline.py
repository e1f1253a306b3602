"""The pipeline as a whole and its stages on odd and empty tables."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_run_is_its_stages_and_gives_the_librarys_ids(spark, docs):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    step, sizes = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, DATA).collect(), docs.select(corpus_pipeline.COLUMNS).schema)
        sizes.append(step.count())
        assert step.columns == corpus_pipeline.COLUMNS
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = step.collect()
    assert len(rows) == len(got)
    for r in rows:
        ids = coder.encode(r["text"] or "", add_special_tokens=False).ids
        mine = got[r["doc_id"]]
        assert mine["ids"] == ids and mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_on_odd_rows(spark, docs):
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").where("text is not null").first()["text"]
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "12 34 !!", None, "s", 8), (3, passage, "en", "s", 1), (3, passage, "en", "s", 1), (4, "before it " + passage, None, None, None)]
    mixed = docs.select(corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(odd, docs.select(corpus_pipeline.COLUMNS).schema)).withColumn("kept", F.lit("clash")).withColumn("hit", F.lit(1))
    found = corpus_pipeline.find_language(spark, mixed, DATA)
    assert found.where("text is null or text = '' or text = '12 34 !!'").count() == 0 and found.where("lang is null").count() == 0
    cut = corpus_pipeline.decontaminated(spark, mixed, DATA)
    assert cut.where("doc_id is null and text = ''").count() == 1
    left = [r["text"] for r in cut.where("doc_id = 4").collect()]
    assert any(t.startswith("before it") and passage not in t for t in left)
    assert all(passage != r["text"] for r in cut.where("doc_id = 3").collect())
    tokens = corpus_pipeline.to_tokens(spark, mixed, DATA)
    assert tokens.count() == mixed.count() and tokens.where("doc_id is null").first()["ids"] == []


def test_stages_on_empty_tables(spark, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
