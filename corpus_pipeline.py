"""A corpus pipeline over documents: quality rules, exact dedup, near dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, minhash_dedup, mixing, quality_rules, sentencepiece_codec
from gridloom.llm._common import stored

#: Words of a shingle and least similarity in percent of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts are rejected, repeated rows are judged each
    for itself, an empty table stays empty."""
    return quality_rules.drop_rejected(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one stays: the longest text, then the smallest doc_id; null counts as empty,
    of wholly equal rows one stays, null ids come after all others."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays: null and empty texts are near nothing and stay, rows that
    share an id or have none are documents of their own."""
    return minhash_dedup.drop_near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them, cut where it takes a part; null and empty texts
    have no words and go, null is a source of its own, repeated rows are interchangeable."""
    return mixing.mixed_texts(mixing.mix_sources(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the digests that a decoding must meet; null counts as empty, every row stays."""
    wanted = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return sentencepiece_codec.piece_codec(docs.select("doc_id", "source", "text"), outputs=wanted).withColumn("round_trip", F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can't express byte-pair encoding; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
