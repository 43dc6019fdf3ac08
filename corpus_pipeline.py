"""Corpus pipeline: toxicity, exact dedup, near-dedup, secrets, packing. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, minhash
from helixframe.llm.common import fresh_path, table
from helixframe.llm.packing import pack_documents
from helixframe.llm.secrets import mask_secrets
from helixframe.llm.toxicity import fit_toxicity, score_toxicity

TOXIC = 0.3  # documents that score so high go
_SCORE = "helixframe_toxicity"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose score is below TOXIC. Null and empty texts have the score of a document without features; repeated rows are scored one by one."""
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), score_col=_SCORE)
    return scored.filter(F.col(_SCORE) < TOXIC).drop(_SCORE)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: the longest original text, then the smallest id (null last), then any of rows that are equal in both.

    Null, empty and blank texts are equal. Rows are told apart even where they share an id or have none.
    """
    return exact_dedup.keep_one_each(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row of the smallest id (null last). Texts without words stay."""
    return minhash.keep_one_each(docs, words=5, percent=80)


def with_secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked in text and n_chars counted anew where something was masked; null texts stay null."""
    return mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document; a null or empty text is one piece of one token. Rows that share an id are packed one by one."""
    import public_tokenizers

    found = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("secrets", with_secrets_masked),
    ("packing", packed),
]

#: Models, similarity and tokenization are no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
