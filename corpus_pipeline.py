"""From raw documents to token ids: toxic documents, near copies, repeated passages and benchmark leaks go.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last keep the columns of documents; the last gives doc_id, lang, source,
n_tokens, token_ids, ids_sha256 and decoded_sha256.

Near duplicates: the row with the smallest doc_id of each component stays. Repeated passages: words of later copies are
cut out of the text and n_chars follows; a document that loses all its words stays with an empty text.
Rows without doc_id are never dropped as copies. Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carlake.llm import bpe, decontaminate, simhash, substrings, toxicity
from carlake.llm.common import written
from carlake.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    made = bpe.round_trip(F.col("text"), ranks, public_tokenizers.PATTERN).alias("t")
    coded = docs.select("doc_id", "lang", "source", made).select("doc_id", "lang", "source", "t.*")
    return coded.select(
        "doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", to_tokens),
]

ORACLE_SQL = None  # compression distances and trained weights are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
