"""A training corpus from raw documents: language, quality, near duplicates, repeated passages, packed sequences.

``STAGES`` are functions (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of ``documents``;
each reads what the one before wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm.byte_cnn import UNKNOWN, identify_language
from spendscope.llm.common import shared_dir, table
from spendscope.llm.near_dedup import near_duplicates
from spendscope.llm.nbsvm import score_quality
from spendscope.llm.packing import pack
from spendscope.llm.suffix_dedup import remove_repeated_strings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]
PASSAGE_BYTES, PASSAGE_GRAM = 200, 64  # repeated strings of that length go: 51 words of four letters have more
LEAST_SHARE = 0.4  # a language must have at least this mean chance over a text's windows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts of which no language reaches the least score, go."""
    told = identify_language(docs, keep=REST)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts predicted to be of quality 0 go."""
    return score_quality(docs, table(spark, sf_dir, "labels"), keep=REST).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays. Rows of one id stay or go together."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE_BYTES`` and more that stand twice leave the texts; documents stay, if need be without text."""
    kept = remove_repeated_strings(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM, keep=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts in sequences of power-of-two lengths."""
    return pack(docs)


STAGES = [
    ("language", language), ("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing),
]
ORACLE_SQL = None  # trained models decide, which SQL cannot express; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written below the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
