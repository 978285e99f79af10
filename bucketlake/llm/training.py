"""Bounded, repeatable samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(labels: DataFrame, label_col: str, per_class: int, usable: Column) -> DataFrame:
    """(id, y): at most ``per_class`` ids of each class, those with the smallest
    hash. Repeated labels of an id are averaged, halves count as 1; null ids and
    labels are left out."""
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col(f"`{label_col}`").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.avg(F.col(f"`{label_col}`").cast("double")).alias("mean"))
        .select(F.col("doc_id").alias("id"), (F.col("mean") >= 0.5).cast("int").alias("y"))
    )
    order = [F.xxhash64("id"), F.col("id")]
    parts = [clean.where(F.col("y") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return parts[0].union(parts[1])


def prior(labels: DataFrame, label_col: str, usable: Column) -> float | None:
    """Share of the label 1 among all usable labels."""
    return labels.where(F.col(f"`{label_col}`").isNotNull() & usable).agg(F.avg((F.col(f"`{label_col}`") >= 1).cast("double"))).first()[0]
