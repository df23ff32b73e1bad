"""A text corpus made ready for training, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glycospan.llm import byte_bpe, decontamination, jaccard_join, quality_rules, substring_dedup
from glycospan.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; thresholds follow the documents given."""
    return quality_rules.drop_rejected(docs).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates (five-word shingles, 0.8)."""
    return jaccard_join.keep_one(docs, width=5, similar=80).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of passages that an earlier document has; texts of which nothing is left go.

    A text that loses nothing stays as it is, others are their kept words joined by spaces.
    """
    removed = substring_dedup.remove_repeats(docs, keep=("lang", "source"), tidy=False).where("n_removed = 0 OR n_removed < n_words")
    return removed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit numbers) and the SHA-256 of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, keep=("lang", "source"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

#: SQL can't state the token ids; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each on what the one before kept.

    Between stages the documents are written to the shared folder and read again, so that
    no stage is computed twice; a stage's table goes once the next one is written. The
    last table stays for the returned rows.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)
