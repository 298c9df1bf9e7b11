"""A corpus pipeline from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusseek.llm.common import free_name, own, table, write_shared
from corpusseek.llm.exact_dedup import drop_copies
from corpusseek.llm.minhash import drop_near_copies
from corpusseek.llm.packing import pack
from corpusseek.llm.queries import tokenizer_path
from corpusseek.llm.secret_scan import ranked_words, redact_secrets
from corpusseek.llm.toxicity import score_toxicity, train

#: Documents with this score or more are rejected.
TOXIC = 0.5
#: Shingle similarity, in per cent, from which documents are near-duplicates.
NEAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return score_toxicity(docs, model, keep=True, score_col=score).where(F.col(score) < TOXIC).select(own(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return drop_near_copies(docs, percent=NEAR)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked, and ``n_chars`` follows the text."""
    out = redact_secrets(docs, words=ranked_words(docs, tokenizer_path()))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(own(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can't express the learned model, the guess costs or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
