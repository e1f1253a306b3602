"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's documents.  All but the
last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import ship
from larkspur.llm import decontaminate, jaccard_join, language_id, lexicon_bpe, line_dedup, queries
from larkspur.llm._spark import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document needs this score in the language found.
LEAST_SCORE = 0.5
#: Documents are near copies from this percentage of shingles of so many words on.
SHINGLE_WORDS, LEAST_SIMILAR = 5, 80


def _columns(docs: DataFrame, text: str = "text") -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast(kind).alias("n_chars"))


def find_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letters (null texts too) or no clear language; fills in missing languages.

    Rows are judged one by one, so repeated rows stay or go together; an empty table stays empty.
    """
    ship(spark)
    docs = docs.select(COLUMNS)
    judged = language_id.identify(docs, queries.language_model(docs), LEAST_SCORE)
    judged = judged.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous"))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each class of equal or near lines, and drops documents that were nothing else.

    Of repeated rows the first keeps its lines; a null text has no lines and stays.
    """
    ship(spark)
    judged = line_dedup.dedup_lines(docs.select(COLUMNS))
    return _columns(judged.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^ \t\n\x0B\f\r]")), "kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of similar documents: that of least id (null last), then of least hash."""
    ship(spark)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*COLUMNS).alias("h"))
    ranked = docs.select(COLUMNS).withColumn("_rank", rank)
    found = jaccard_join.similar_components(ranked.select("_rank", "text"), SHINGLE_WORDS, LEAST_SIMILAR, id_col="_rank")
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_rank")).distinct()
    return ranked.dropDuplicates(["_rank"]).join(kept, "_rank", "left_semi").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out, and drops documents that were nothing else.

    Null and empty texts hold no passage and stay, as empty ones; repeated rows are cut alike.
    """
    rest = [c for c in COLUMNS if c != "text"]
    packed = docs.select(F.struct(*rest).alias("doc_id"), "text")
    found = decontaminate.remove(packed, table(spark, sf_dir, "benchmark"))
    found = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return _columns(found.select("doc_id.*", "text"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row; a null text has no ids, repeated rows have equal ones."""
    ship(spark)
    made = lexicon_bpe.encode(docs.select("doc_id", "text"), queries.tokenizer(), keep=["ids"])
    return made.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", find_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", to_tokens),
]

#: SQL can't express the classifier or the tokenizer; the operators behind the stages have plain versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
