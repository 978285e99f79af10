"""Connected components of a distributed edge list, by alternating large-star
and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond").

Neither nodes nor edges reach the driver. Each step reads a checkpoint and
writes one; the per-node minima are checkpointed too, so that the join which
spreads them has a plain exchange on both sides and Spark can split a hub.

Steps are many and, in most inputs, small: a checkpoint has a partition for
``EDGES`` edges (one a core at least), not one for each shuffle partition of the
session, which keeps files few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

EDGES = 100_000


def _minima(pairs: DataFrame, parts: int) -> DataFrame:
    """(node, low): the smallest of a node and its neighbours."""
    low = pairs.groupBy("u").agg(F.min("v").alias("v"))
    return checkpointed(low.select(F.col("u").alias("node"), F.least("u", "v").alias("low")).coalesce(parts))


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both, parts)
    out = both.where("v > u").join(low, F.col("u") == F.col("node")).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return checkpointed(out.distinct().coalesce(parts))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    # edges run from the larger to the smaller node
    low = _minima(edges, parts)
    joined = edges.join(low, F.col("u") == F.col("node"))
    moved = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = low.where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    return checkpointed(moved.union(own).distinct().coalesce(parts))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v of one orderable type);
    root is the smallest node that is reachable. Loops and repeats are allowed."""
    u, v = edges.columns
    step = checkpointed(
        edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    )
    seen = _signature(step)
    while seen[0]:
        parts = max(edges.sparkSession.sparkContext.defaultParallelism, seen[0] // EDGES + 1)
        step = _small_star(_large_star(step, parts), parts)
        now = _signature(step)
        if now == seen:
            break
        seen = now
    roots = step.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return step.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
