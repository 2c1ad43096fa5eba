"""The corpus pipeline: stages over the documents table, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescore.llm import language, lines, packing, secrets, simhash
from tidescore.llm.common import documents, folder, store


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the model rejects; the others stay as they are."""
    model = language.fit_language(language.training_rows(docs))
    return language.keep_identified(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike, all but the first go. Every document stays, with the text that is left."""
    return lines.deduplicate_lines(docs).withColumn("n_chars", _characters())


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the one with the smallest id stays."""
    return simhash.keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark. Every document stays."""
    return secrets.redact_secrets(docs).withColumn("n_chars", _characters())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.packed(docs)


def _characters():
    return F.char_length(F.coalesce("text", F.lit(""))).cast("bigint")


STAGES = [
    ("language ID", identified),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

# The models and the tokenizer have no counterpart in SQL; a test compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), folder(spark, f"stage_{k}"))
    return docs
