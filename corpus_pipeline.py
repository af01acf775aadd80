"""The corpus pipeline: language identification, exact and near deduplication, secret removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``; the last returns one row for each piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.catalog import tokenizer_path
from storyloom.llm.exact_dedup import drop_exact_copies
from storyloom.llm.language_id import fit, identified
from storyloom.llm.near_dedup import drop_near_copies
from storyloom.llm.packing import pack_documents
from storyloom.llm.secret_scan import redact
from storyloom.scratch import store

# Texts whose best language scores less are rejected, as are those without letters and those with fewer n-grams known of that
# language than the fit derives from its texts.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the rest goes."""
    return identified(docs, fit(docs), LEAST_SCORE, placed=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (A-Z lower-cased) the one with the largest identifier."""
    return drop_exact_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest identifier."""
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; no document goes."""
    clean = redact(docs)
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their token ids and their place in the packed sequences."""
    return pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# A tokenizer, a learned classifier and components cannot be written as SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
