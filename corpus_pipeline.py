"""The corpus pipeline: each stage reads what the one before it wrote.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. run() writes each result as Parquet into a fresh folder beside the checkpoints and
reads it again, so that no stage is ever computed twice and a lost executor costs one stage's tasks at most; what the
next stage has read is removed.

Defined results: empty tables pass through all stages; null texts fail the quality rules; columns that documents
have besides their own are kept, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from cairnlore.llm import bpe, mixing, pii, quality, shingles
from cairnlore.llm.common import checkpoint_folder, remove, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by 0.8 or more of their five-word shingles stays: the one with the
    smallest doc_id. SimHash, compared by bits, proposes the close links, MinHash bands those beyond its radius."""
    return shingles.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is masked."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of every document taken."""
    out = bpe.round_trip(docs.select("doc_id", "source", "text"), ["doc_id", "source"])
    return out.select("doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the robust estimates, the hashes of the mix and BPE; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
