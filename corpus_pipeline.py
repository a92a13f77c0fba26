"""A corpus pipeline of five stages over ``documents``; each stage is one operator of idweft.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idweft.llm import byte_bpe, ngram_join, secret_scan, source_mix, toxicity_cnn
from idweft.llm.storage import written

#: Texts that a Python worker gets at once. A stage's result is written by whoever calls it, in batches of
#: the session's size, so the stages that end in Python write theirs first.
BATCH_ROWS = 256
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    model = toxicity_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    flag = toxicity_cnn.toxic_flag(spark, model)
    return written(docs.select(*COLUMNS).filter(~flag(F.col("text"), F.col("lang"))), "clean", BATCH_ROWS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group of linked ones; rows without an id stay.

    Rows that share an id are one document and stay together.
    """
    groups = ngram_join.link_documents(docs)
    gone = written(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret that the scan finds."""
    found = secret_scan.scan(docs, keep=("lang", "source", "n_chars"))
    clean = secret_scan.redacted(F.col("text"), F.col("found"))
    n_chars = F.when(F.size("found") > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", clean.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes the block that holds its first word."""
    mixed = source_mix.with_copies(docs.select(*COLUMNS)).filter("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn")).drop("turn")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256`` of every document of the mix."""
    ids = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return written(ids.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256")), "encoded", BATCH_ROWS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]
#: A trained classifier and a tokenizer have no SQL; tests/llm holds the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
