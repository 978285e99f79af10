"""Exact deduplication by progressive refinement.

Rows are narrowed in three steps: by the length of the normalised text, by a hash of
its first bytes, by a hash of all of it. Each step is a scan of the documents where
they lie and a grouping of rows of a few dozen bytes; only rows whose key is shared
enter the next step. So the prefix is hashed of rows that share their length, and
the whole text of rows that share length and prefix. Texts never move between
machines; the ids to drop do.

Which keys are shared is told to the next scan by a bitmap of ``KEY_BITS`` bits for
each shared key, ``FILTER_BITS`` at most: a Bloom filter with one hash. It has no false
negatives; a false positive costs one needless hash and is dropped by the last
grouping. Beyond what the largest bitmap can tell apart, steps let more rows through;
results stay the same.

Defined results
  null text             counts as the empty text
  empty texts           are all equal to each other
  very long texts       whole; a batch of texts is held, with normalised copies
  ties                  most code points first, then the smallest id (null last)
  repeated rows         one of them stays, even where id and text both repeat
  empty table           empty result
  extra columns         are ignored, whatever their names; dropping keeps them
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bitmap_of, bits_for, bounded_batches, checkpointed, ids_repeat, is_set, keep_tagged, text_or_empty, without_ids

#: Fixed by the definition of equal texts: space and tab to carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
PREFIX_BYTES = 256
KEY_BITS = 16
#: The step that told a row from all others, or the last one.
BY_LENGTH, BY_PREFIX, BY_CONTENT = 1, 2, 3


def _normalised(text: pa.Scalar) -> bytes:
    held = text.as_buffer()
    return held.to_pybytes().translate(None, BLANKS) if held is not None else b""


def _code_points(text: pa.Scalar) -> int:
    held = text.as_buffer()
    return len(held) - int(np.count_nonzero((np.frombuffer(held, np.uint8) & 0xC0) == 0x80)) if held is not None and len(held) else 0


def _prefix_hash(norm: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(norm[:PREFIX_BYTES], digest_size=8).digest(), "little", signed=True)


def _slots(bits: int, *keys: list[int]) -> np.ndarray:
    """Where Spark's xxhash64 of the keys puts them: hashes chained by their seeds."""
    out = []
    for row in zip(*keys, strict=True):
        h = 42
        for k in row:
            h = xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), h)
        out.append(h & (bits - 1))
    return np.array(out, np.int64)


def _shared(keys: DataFrame, most: int) -> bytes:
    """Bitmap of the keys (all columns of ``keys``) that at least two rows share."""
    shared = checkpointed(keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    bits = bits_for(shared.count(), KEY_BITS, most)
    slot: Column = F.xxhash64(*keys.columns).bitwiseAND(F.lit(bits - 1))
    return bitmap_of(shared.select(slot.alias("slot")), bits)


def lengths(docs: DataFrame, text_col: str) -> DataFrame:
    """(norm_len): the first step's key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(_normalised(t)) for t in batch.column(0)], pa.int64())], ["norm_len"])

    return bounded_batches(docs).select(text_or_empty(text_col).alias("text")).mapInArrow(run, "norm_len long")


def prefixes(docs: DataFrame, text_col: str, by_length: bytes) -> DataFrame:
    """(norm_len, prefix_hash): the second step's key of rows that share their length."""
    held = docs.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = len(held.value) * 8
        for batch in batches:
            norms = [_normalised(t) for t in batch.column(0)]
            sizes = [len(n) for n in norms]
            hit = is_set(held.value, _slots(bits, sizes))
            rows = [(s, _prefix_hash(n)) for s, n, h in zip(sizes, norms, hit, strict=True) if h]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["norm_len", "prefix_hash"])

    return bounded_batches(docs).select(text_or_empty(text_col).alias("text")).mapInArrow(run, "norm_len long, prefix_hash long")


def contents(docs: DataFrame, id_col: str, text_col: str, by_length: bytes, by_prefix: bytes, hash_all: bool) -> DataFrame:
    """(id, n_points, step, digest): the third step's key of rows that share length and
    prefix; with ``hash_all`` the digest of the others too, for callers that report it."""
    held = docs.sparkSession.sparkContext.broadcast((by_length, by_prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = held.value
        for batch in batches:
            norms = [_normalised(t) for t in batch.column(1)]
            sizes, hashes = [len(n) for n in norms], [_prefix_hash(n) for n in norms]
            same_length, same_prefix = is_set(first, _slots(len(first) * 8, sizes)), is_set(second, _slots(len(second) * 8, sizes, hashes))
            steps = np.where(same_length, np.where(same_prefix, BY_CONTENT, BY_PREFIX), BY_LENGTH).tolist()
            points = [_code_points(t) for t in batch.column(1)]
            digests = [hashlib.sha256(n).digest() if k == BY_CONTENT or hash_all else None for n, k in zip(norms, steps, strict=True)]
            arrays = [batch.column(0), pa.array(points, pa.int64()), pa.array(steps, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_points", "step", "digest"])

    id_type = docs.schema[id_col].dataType.simpleString()
    source = bounded_batches(docs).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"id {id_type}, n_points long, step int, digest binary")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hash_all: bool = False, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest, step.

    ``step`` is the one that told the row unique, or ``BY_CONTENT``. ``digest`` is the
    SHA-256 of the normalised text, null for rows that were told unique by a shorter
    key unless ``hash_all``.
    """
    by_length = _shared(lengths(docs, text_col), filter_bits)
    by_prefix = _shared(prefixes(docs, text_col, by_length), filter_bits)
    rows = checkpointed(contents(docs, id_col, text_col, by_length, by_prefix, hash_all).withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "row")
    groups = checkpointed(
        rows.where(F.col("step") == BY_CONTENT)
        .groupBy("digest")
        .agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.col("digest").alias("group_digest"), F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row"), "group_size")
    )
    # The groups come from a checkpoint so that both sides of this join are plain
    # exchanges, which lets Spark split a group that holds a large share of rows.
    return rows.join(groups, rows.digest == groups.group_digest, "left").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("best_row").isNull() | (F.col("row") == F.col("best_row"))).alias("kept"),
        "digest",
        "step",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    if not ids_repeat(docs, id_col):
        found = exact_duplicates(docs, id_col, text_col)
        return without_ids(docs, id_col, found.where(~F.col("kept")))
    found = checkpointed(exact_duplicates(docs, id_col, text_col, hash_all=True))
    decisions = found.select("id", F.col("digest").alias("tag"), "kept")
    return keep_tagged(docs, decisions, id_col, text_col, lambda t: hashlib.sha256((t or "").encode("utf-8", "surrogatepass").translate(None, BLANKS)).digest())
