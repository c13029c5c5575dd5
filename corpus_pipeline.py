"""The corpus pipeline: documents through five of the operators in order.

``STAGES`` lists (name, function) pairs; a function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet below the
shared checkpoint folder and rereads as the next stage's ``docs``.  All stages
but the last return the columns of ``documents``; the last returns the packed
pieces.  Every stage works on all rows that its predecessor kept.

Cases: a null doc_id stays with its row; null and empty texts leave in the
first stage, since no language is found in them; repeated rows and ties are
treated as each operator says; an empty table goes through all stages empty;
further columns are carried to the last stage but one, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from textlab.llm.common import aside, on_workers, shared_folder, table
from textlab.llm.queries import PIECES, WORD_BPE, tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the rest goes."""
    on_workers(spark)
    df, back = aside(docs, "lang_pred", "score")
    return back(language_id.accepted(language_id.identify(df, tokenizer_path(PIECES))))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id."""
    on_workers(spark)
    df, back = aside(docs, *exact_dedup.OUTPUT)
    return back(exact_dedup.one_per_text(exact_dedup.with_digest(df)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    on_workers(spark)
    return ngram_join.one_per_component(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as packed sequences."""
    on_workers(spark)
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_exact_copies),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: tokens and language models are not expressible in SQL; tests/llm holds the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "corpus-pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
