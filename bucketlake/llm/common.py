"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of what ``without_ids`` broadcasts: ids, their bytes, and bits of a filter.
BROADCAST_IDS = 1_000_000
BROADCAST_BYTES = 64 << 20
FILTER_BITS = 1 << 28


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset, as in
    tests on one machine, is a temporary folder made and set. On a cluster it must
    be set. The path is qualified, so that it names the same store everywhere.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not configured and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="bucketlake-"))
    return qualified(spark, configured or context.getCheckpointDir())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of its store; local ones as file:///."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/+", "file:///", full)


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage, survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffles and checkpoints that nothing refers to
    any more. It learns of them when the driver collects garbage, which a driver with
    little to do may not do for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(df: DataFrame, rows: int = 512, size: str = "8m") -> DataFrame:
    """``df``, after making the session's Arrow batches small enough for texts of any
    length. Values that the user has set are left as they are."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not conf.contains(key):
            df.sparkSession.conf.set(key, value)
    return df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def with_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns that ``make`` gives for a batch, after its own. Within,
    columns go by place, so their names may be anything, dots included."""
    every = [*df.schema.fields, *fields]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(every)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=schema.names)

    return df.toDF(*schema.names[: len(df.columns)]).mapInArrow(run, schema).toDF(*(f.name for f in every))


def tagged(docs: DataFrame, text_col: str, tag_of: Callable[[str | None], bytes], name: str) -> DataFrame:
    """``docs`` with a binary column that is a function of the text."""
    at = docs.columns.index(text_col)
    return with_columns(bounded_batches(docs), [T.StructField(name, T.BinaryType())], lambda batch: [pa.array([tag_of(t.as_py()) for t in batch.column(at)], pa.binary())])


def bitmap_of(slots: DataFrame, bits: int) -> bytes:
    """A bitmap of ``bits`` bits with the positions ``slot`` of ``slots`` set; at most
    ``bits / 8`` bytes reach the driver, whatever the input."""
    per_chunk = slots.groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("chunk")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits"))
    out = bytearray(bits // 8)
    for chunk, part in per_chunk.toLocalIterator():
        at = (chunk - 1) * len(part)
        out[at : at + len(part)] = part[: max(0, len(out) - at)]
    return bytes(out)


def bits_for(n: int, a_key: int, most: int) -> int:
    """A power of two: ``a_key`` bits for each of ``n`` keys, ``most`` at most."""
    return min(most, 1 << max(16, (a_key * n - 1).bit_length()))


def is_set(bitmap: bytes, slots: np.ndarray) -> np.ndarray:
    return np.frombuffer(bitmap, np.uint8)[slots >> 3] >> (slots & 7) & 1 > 0


def ids_repeat(docs: DataFrame, id_col: str) -> bool:
    return docs.groupBy(F.col(f"`{id_col}`")).count().where("count > 1").limit(1).count() > 0


def without_ids(docs: DataFrame, id_col: str, dropped: DataFrame, most: int = BROADCAST_IDS, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``dropped`` (id); a null id matches a null id.

    Up to ``most`` ids in ``BROADCAST_BYTES`` bytes are broadcast. Beyond, a bitmap of
    their hashes, of ``bits`` bits at most, keeps rows that are certainly not dropped
    where they lie; only the others, those to drop and a few more, are shuffled and
    joined. The result is the same."""
    gone = fresh_name(docs, "__gone")
    dropped = checkpointed(dropped.select(F.col("id").alias(gone)).distinct())
    size = dropped.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(gone).cast("string")) + 16), F.lit(0)).alias("bytes")).first()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(gone))
    if size["n"] <= most and size["bytes"] <= BROADCAST_BYTES:
        return docs.join(F.broadcast(dropped), same, "left_anti")
    n_bits = bits_for(size["n"], 32, bits)
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(dropped.select(F.xxhash64(gone).bitwiseAND(F.lit(n_bits - 1)).alias("slot")), n_bits))
    # Columns go by place, under names of our own.
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    slot = F.xxhash64(F.col(f"`{id_col}`")).bitwiseAND(F.lit(n_bits - 1))
    slotted = bounded_batches(docs).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, schema.names, strict=True)], slot.alias("slot"))

    def part(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chosen = is_set(held.value, batch.column(batch.num_columns - 1).to_numpy()) == hit
                rows = batch.filter(pa.array(chosen))
                yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=schema.names)

        return slotted.mapInArrow(run, schema).toDF(*docs.columns)

    return part(False).union(part(True).join(dropped, same, "left_anti"))


def keep_tagged(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str, tag_of: Callable[[str | None], bytes]) -> DataFrame:
    """Rows of ``docs`` that ``decisions`` (id, tag, kept: a row for each row of
    ``docs``) keeps, where ids repeat: rows are told apart by the tag too, a function
    of the text, and of rows that share both one stays. A null id matches a null id."""
    name, keep_id, keep_tag = (fresh_name(docs, n) for n in ("__tag", "__keep_id", "__keep_tag"))
    kept = decisions.where("kept").select(F.col("id").alias(keep_id), F.col("tag").alias(keep_tag))
    rows = tagged(docs, text_col, tag_of, name)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(keep_id)) & (F.col(name) == F.col(keep_tag))
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, name]).drop(name)
