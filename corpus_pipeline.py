"""Documents to tokens in five stages, each an operator of millrace.llm on all its predecessor kept.

Each stage takes the columns of documents, whatever else docs has, and all but the last return them.
Defined cases, for each stage: rows with a null doc_id, text, lang, source or n_chars are rows like any
others (a null text counts as empty where it is scored or encoded, and stays null where it is passed on);
repeated rows stay or go together; of documents with equal texts the smallest doc_id stays (near
duplicates; null comes last); texts of any length are processed whole; an empty table stays empty."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, jaccard, lines, quality
from millrace.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject as junk or toxic."""
    return quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that stand elsewhere before; n_chars follows, null
    for a null text."""
    return lines.dedup_lines(docs.select(*COLUMNS)).select(*COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return jaccard.kept(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian 32 bits) with digests of them and of what they decode to."""
    both = bpe.encode(docs.select("doc_id", "text", "lang", "source"), RANKS, public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("tokenize", tokenize),
]

#: The stages are models, similarity joins and searches that SQL can't express; tests/llm compares
#: them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each keeps is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
