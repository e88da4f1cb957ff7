"""The corpus pipeline: stages that each call one training-data operator.

Decisions go by id and text, so that rows with a null id or one id for several texts are
decided each by itself; repeated rows are decided alike, and near-dedup keeps one of them.
Null texts are empty ones to every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.llm import decontaminate, packing, quality, secrets, simhash
from probelake.llm.common import remove, stage_at, table, text_hash
from probelake.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keep(docs: DataFrame, kept: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` that are (or are not) among ``kept``: doc_id, text_hash."""
    rows = docs.withColumn(HASH, text_hash("text"))
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows[HASH] == kept["text_hash"]), how)


#: Name of the working column, which documents are not expected to have.
HASH = "__text_hash"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    kept = quality.resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "text_hash").distinct()
    return _keep(docs, kept).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the one with the smallest id."""
    kept = simhash.survivors(simhash.near_copies(docs))
    return _keep(docs, kept).dropDuplicates(["doc_id", HASH]).select(docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = decontaminate.find_leaks(docs.withColumn(HASH, text_hash("text")), table(spark, sf_dir, "benchmark"), more=[HASH]).select("doc_id", F.col(HASH).alias("text_hash")).distinct()
    return _keep(docs, leaks, "left_anti").select(docs.columns)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; the documents stay, with their new lengths."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", no_benchmark),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: SQL cannot train the quality model, compute XXH64 or run the tokenizer; a brute-force version tests each stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written before the next reads it, and goes when that is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs, path = stage_at(step(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
