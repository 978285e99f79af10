"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact_dedup, html_extract, mixing, quality, simhash, toxicity, warc
from .common import checkpointed, read_table
from .training import remainder


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the conversations is held out: their roles are not counted."""
    held_out = remainder("conv_id", 3) == 1
    return chat.format_chats(read_table(spark, sf_dir, "conversations"), learnt=~held_out).withColumn("held_out", held_out)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), hash_all=True)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    rows = quality.score(docs, model)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.encode(docs, vocabulary, decoded_col="decoded")
    return rows.select(
        "doc_id", bpe.n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_slots", "by_template")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mixture(docs, carry=["doc_id", "source", "lang"], **mixing.DEFAULT_MIX)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archive(read_table(spark, sf_dir, "pages"), warc.new_folder(spark))
    rows = warc.read_archive(spark, manifest, with_payload=False)
    found = checkpointed(rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    warc.remove_archive(spark, manifest)
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_mil": op1_quality_mil,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_extract": op3_html_extract,
    "op4_simhash": op4_simhash,
    "op5_chat_format": op5_chat_format,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_ann": op8_ann,
    "op9_toxicity_nnpu": op9_toxicity_nnpu,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               text_sha256
        FROM t
        WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op10_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (
          SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
        FROM q""",
}
