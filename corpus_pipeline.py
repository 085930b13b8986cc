"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tablewash.llm import decontaminate, resampling, simhash_trie, suffix_dedup, viterbi_pieces
from tablewash.llm.common import stored

PIECES = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/piece_bpe_32k.model")

#: Passages of more than 50 words are to be found: 51 words of three letters and a space are longer.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    return resampling.keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose four-word fingerprints link at 4 bits or fewer one stays."""
    return simhash_trie.keep_one_of_each_group(docs, errors=4)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE_BYTES that occur elsewhere too are cut out of the texts."""
    return suffix_dedup.drop_repeated_bytes(docs, PASSAGE_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it."""
    return viterbi_pieces.encode_texts(docs, PIECES)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: No SQL expresses the trained and iterative stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
