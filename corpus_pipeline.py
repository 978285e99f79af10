"""The corpus pipeline: each stage takes the documents its predecessor kept.

Every stage but the last returns the columns of ``documents``; the last returns
the id and the tokens of what is left.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketlake.llm import bpe, exact_dedup, mixing, quality, simhash
from bucketlake.llm.common import read_table, remove_folder, shared_dir
from bucketlake.llm.training import remainder

#: Classifiers, and draws by hash, have no SQL form.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    name = "__quality_score"
    return quality.score(docs, model, out_col=name).where(F.col(name) >= 0.5).select(*(f"`{c}`" for c in docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: sets of five-word shingles,
    linked by a similarity of 0.8."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target mix."""
    return mixing.sample(docs, **mixing.DEFAULT_MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and whether decoding the ids
    gives back the bytes of the text."""
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    rows = bpe.encode(rows, vocabulary, decoded_col="decoded")
    return rows.select("doc_id", "lang", "source", bpe.n_ids("ids").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("restored"))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", apart), ("mixing", mixed), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read
    again, so that a lost executor costs one stage at most. What a stage wrote is
    removed once its successor has been written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
