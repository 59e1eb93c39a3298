"""The training-data pipeline: language ID, line dedup, near-duplicates, mixing, BPE encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termbridge.llm import byte_bpe, language, line_dedup, minhash, mixing
from termbridge.llm.queries import RANKS
from termbridge.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents; texts of no known language go."""
    found = language.identify(docs.select(*COLUMNS), language.learn(docs))
    return found.where("accepted").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of earlier documents; n_chars follows."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates, and rows without doc_id."""
    return minhash.without_near_duplicates(docs.select(*COLUMNS))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit) and their number, a row per copy."""
    encoded = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("byte_bpe", encode),
]
ORACLE_SQL = None  # the stages learn, hash, draw and merge; tests hold each against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
