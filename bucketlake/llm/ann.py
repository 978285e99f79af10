"""Approximate nearest neighbours by inner product: inverted lists scanned with
adaptive dimension sampling (Gao and Long, "High-Dimensional Approximate Nearest
Neighbor Search: with Reliable and Efficient Distance Comparison Operations") over
column blocks.

Index. A bounded sample (``sample_rows``, less for very long vectors) gives the
centroids and the number of lists to probe; every row is then put into a list.
Vectors get one more coordinate that makes all norms equal, so that the largest
inner product is the smallest distance; lists are Voronoi cells in that space.
A list is stored in blocks of bounded size, dealt out by a hash of the id, so a
list that holds a large share of the rows is as many units as others together.

Scan. A unit is one block with up to ``query_rows`` of the queries that probe its
list. Vectors are rotated by a random orthogonal matrix and read in column blocks.
After each block the partial squared distance of t of d coordinates, scaled by d/t,
is tested against the distance that the query still has to beat: beyond
(1 + epsilon / sqrt(t))^2 times it, the hypothesis "may be among the nearest" is
rejected and the candidate abandoned. Queries start from the 2 k-th best row that
the sample has in the probed lists, which can't exceed their final k-th best. Survivors are scored with the
original vectors in double precision.

Recall. ``probes`` is the smallest number of lists that holds ``recall`` of the
sample's own neighbours (0.97 by default); a query probes more where the lists hold
fewer than k candidates.

Defined results
  null, zero or non-finite vectors, null ids   take no part
  lengths other than the commonest             take no part
  repeated ids     as candidates, each row counts; as a query, one of the rows
                   (the smallest bytes); rows with the query's id are its own
  ties             go to the smaller id
  fewer than k     all candidates; a query for which the tests leave fewer than there
                   are is answered again from all lists, without tests
  extra columns    are ignored, whatever their names
  empty table      empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20
QUERY_ROWS = 512
MAX_LISTS = 4096
COLUMNS = 16
EPSILON = 2.1
DENSE = 0.1
_PAIRS = 1 << 14


def stored_kind(table: DataFrame, vector_col: str) -> str:
    """How components travel: as they are, if they are floats of four bytes, which
    doubles hold exactly; else as doubles."""
    kind = table.schema[vector_col].dataType
    return "<f4" if isinstance(getattr(kind, "elementType", None), T.FloatType) else "<f8"


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): vec holds the components as little-endian numbers of ``stored_kind``."""
    kind = stored_kind(table, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(kind, copy=False)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            odd, some = (np.concatenate([[0], np.cumsum(m)]) for m in (~np.isfinite(x), x != 0))
            good = (odd[ends] == odd[begins]) & (some[ends] > some[begins])
            out = [x[a:b].tobytes() if g else None for a, b, g in zip(begins.tolist(), ends.tolist(), good.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<float>" if kind == "<f4" else "array<double>").alias("v")).where("id IS NOT NULL")
    return rows.mapInArrow(run, "id long, vec binary").where("vec IS NOT NULL")


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with the coordinate that brings their norm to ``norm``."""
    return np.concatenate([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1, keepdims=True), 0))], axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        alive = counts > 0
        centres[alive] = sums[alive] / counts[alive, None]
        if (~alive).any():
            centres[~alive] = x[rng.choice(len(x), int((~alive).sum()))]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(x), 4096)])


class Index:
    """What is broadcast: bounded by the sample and ``MAX_LISTS``."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, norm: float, n_rows: int, k: int, recall: float, seed: int = 3):
        self.k, self.norm, self.dims = k, norm, sample.shape[1]
        self.sample, self.ids = sample.astype(np.float32), ids
        n_lists = int(max(1, min(MAX_LISTS, n_rows**0.5 / 4, len(sample) / 8)))
        lifted = lift(sample, norm)
        self.centres = k_means(lifted, n_lists, seed=seed)
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.dims, self.dims)))[0].astype(np.float32)
        self.owner = nearest_centre(lifted, self.centres)
        self.probes = self._calibrate(sample, recall, seed)

    def _calibrate(self, sample: np.ndarray, recall: float, seed: int) -> int:
        """Probes needed by sample rows to find their neighbours in the sample."""
        n = len(self.centres)
        if n == 1 or len(sample) < 2:
            return n
        chosen = np.random.default_rng(seed).choice(len(sample), min(256, len(sample)), replace=False)
        scores = sample[chosen] @ sample.T
        scores[np.arange(len(chosen)), chosen] = -np.inf
        k = min(self.k, len(sample) - 1)
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(self.distances(sample[chosen]), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[None, :], axis=1)
        needed = np.take_along_axis(place, self.owner[best], axis=1).ravel() + 1
        return int(min(n, np.quantile(needed, recall, method="higher")))

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Of queries (their extra coordinate is zero) to the centres, up to a
        constant of each query."""
        return (self.centres**2).sum(axis=1) / 2 - queries @ self.centres[:, :-1].T

    def floors(self, ids: np.ndarray, queries: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """A score that at least 2 k rows of the probed lists reach, by query: that
        of the sample's 2 k-th best row in them. Twice k leaves room for the few
        that the hypothesis tests reject by mistake."""
        scores = (queries.astype(np.float32) @ self.sample.T).astype(float)
        scores[(ids[:, None] == self.ids[None, :]) | ~probed[:, self.owner]] = -np.inf
        k = 2 * self.k
        if scores.shape[1] < k:
            return np.full(len(ids), -np.inf)
        best = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        return best - 1e-4 * (1 + np.abs(best))  # the sample is held in single precision


def scan_unit(block_ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, rotation: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of up to k nearest of the block for each query.

    All pairs of a unit are taken a column block at a time: by a matrix product while
    many are alive, pair by pair once fewer than ``DENSE`` are. A pair that a test
    abandons is neither scored nor tested again."""
    turned, asked = block.astype(np.float32) @ rotation, queries.astype(np.float32) @ rotation
    dims = block.shape[1]
    # The squared distance that a pair has to beat.
    limit = np.maximum((block**2).sum(axis=1)[None, :] + (queries**2).sum(axis=1)[:, None] - 2 * floors[:, None], 0).astype(np.float32)
    alive = query_ids[:, None] != block_ids[None, :]
    partial = np.zeros(limit.shape, np.float32)
    at: tuple[np.ndarray, np.ndarray] | None = None  # places of the pairs, once they are few
    for start in range(0, dims, COLUMNS):
        seen = min(dims, start + COLUMNS)
        c, q = turned[:, start:seen], asked[:, start:seen]
        if at is None:
            partial += (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * (q @ c.T)
        else:
            partial += ((q[at[0]] - c[at[1]]) ** 2).sum(axis=1)
        # After all columns nothing is estimated; what is left is for single precision.
        doubt = (1 + epsilon / seen**0.5) ** 2 if seen < dims else 1.0
        stay = partial * np.float32(dims / seen) <= limit * np.float32(doubt) + np.float32(1e-4) * (1 + limit)
        if at is None:
            alive &= stay
            if np.count_nonzero(alive) < DENSE * alive.size or seen == dims:
                at = np.nonzero(alive)
                partial, limit = partial[at], limit[at]
        else:
            at = at[0][stay], at[1][stay]
            partial, limit = partial[stay], limit[stay]
    q, c = at
    scores = np.concatenate([np.einsum("ij,ij->i", block[c[a : a + _PAIRS]], queries[q[a : a + _PAIRS]]) for a in range(0, max(1, len(q)), _PAIRS)])
    good = scores >= floors[q]
    q, c, scores = q[good], c[good], scores[good]
    order = np.lexsort((block_ids[c], -scores, q))
    q, c, scores = q[order], c[order], scores[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    best = rank < k
    return query_ids[q[best]], block_ids[c[best]], scores[best]


def _packed(rows: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """One row for each value of ``keys``: ids, vectors and ``extra`` doubles, each
    packed into bytes. Groups are bounded by how the keys were made."""
    names = [*keys, "id", "vec", *extra]
    out_schema = ", ".join([*(f"{k} int" for k in keys), "ids binary", "vecs binary", *(f"{e} binary" for e in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch:
            ids = np.array([h[0] for h in held], "<i8").tobytes()
            vecs = b"".join(h[1] for h in held)
            more = [np.array([h[2 + i] for h in held], "<f8").tobytes() for i in range(len(extra))]
            arrays = [*(pa.array([v], pa.int32()) for v in key), *(pa.array([x], pa.binary()) for x in (ids, vecs, *more))]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "ids", "vecs", *extra])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[: len(keys)] != key:
                    if held:
                        yield flush()
                    key, held = row[: len(keys)], []
                held.append(row[len(keys) :])
        if held:
            yield flush()

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, out_schema)


def search(table: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.97, sample_rows: int = SAMPLE_ROWS, query_rows: int = QUERY_ROWS, block_bytes: int = BLOCK_BYTES, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row for which
    ``is_query``, a column of ``id``, holds."""
    spark = table.sparkSession
    rows = checkpointed(usable(table, id_col, vector_col))
    kind = stored_kind(table, vector_col)
    item = np.dtype(kind).itemsize
    unpacked = lambda data, dims: np.frombuffer(data, kind).astype(float).reshape(-1, dims)
    sizes = rows.groupBy((F.octet_length("vec") / item).cast("int").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dims, n_rows = sizes["dims"], sizes["count"]
    rows = rows.where(F.octet_length("vec") == dims * item)
    bound = max(64, min(sample_rows, SAMPLE_BYTES // (8 * dims)))
    drawn = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(bound).collect()  # bounded by rows and bytes
    sample = np.concatenate([unpacked(r.vec, dims) for r in drawn])

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(b"".join(batch.column(0).to_pylist()), dims)
            yield pa.RecordBatch.from_arrays([pa.array([float((x**2).sum(axis=1).max()) ** 0.5])], names=["norm"])

    norm = rows.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    index = spark.sparkContext.broadcast(Index(sample, np.array([r.id for r in drawn]), norm, n_rows, k, recall, seed))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(b"".join(batch.column(1).to_pylist()), dims)
            lists = nearest_centre(lift(x, norm), index.value.centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.astype(np.int32))], names=["id", "vec", "list"])

    placed = checkpointed(rows.mapInArrow(assign, "id long, vec binary, list int"))
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most MAX_LISTS
    per_block = max(64, block_bytes // (8 * dims))
    blocks = {c: -(-n // per_block) for c, n in counts.items()}
    sized = F.broadcast(spark.createDataFrame(list(blocks.items()), "l int, blocks int"))  # at most MAX_LISTS rows
    dealt = placed.join(sized, F.col("list") == F.col("l")).withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.col("blocks")).cast("int"))
    stored = checkpointed(_packed(dealt, ["list", "block"], []))

    def probed(queries: DataFrame, everything: bool) -> DataFrame:
        """(id, vec, list, blocks, floor): the lists that a query probes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = index.value
            size = np.array([counts.get(c, 0) for c in range(len(held.centres))])
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    ids, vecs = part.column(0).to_numpy(), part.column(1).to_pylist()
                    x = unpacked(b"".join(vecs), dims)
                    order = np.argsort(held.distances(x), axis=1, kind="stable")
                    chosen = np.full(order.shape, everything)
                    for q in range(len(ids)):
                        enough = int(np.searchsorted(np.cumsum(size[order[q]]), k + 1)) + 1
                        chosen[q, order[q][: max(held.probes, enough)]] = True
                    floors = np.full(len(ids), -np.inf) if everything else held.floors(ids, x, chosen)
                    q, c = np.nonzero(chosen & (size > 0))
                    arrays = [pa.array(ids[q]), pa.array([vecs[i] for i in q], pa.binary()), pa.array(c.astype(np.int32)), pa.array([blocks[i] for i in c.tolist()], pa.int32()), pa.array(floors[q])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "vec", "list", "blocks", "floor"])

        return queries.mapInArrow(run, "id long, vec binary, list int, blocks int, floor double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vecs, q_ids, q_vecs, floor = (batch.column(c)[i].as_py() for c in range(5))
                ids, q_ids, floor = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8"), np.frombuffer(floor, "<f8")
                found = scan_unit(ids, unpacked(vecs, dims), q_ids, unpacked(q_vecs, dims), floor, held.rotation, held.k)
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["query_id", "vec_id", "score"])

    def found_for(queries: DataFrame, n: int, everything: bool) -> DataFrame:
        groups = max(1, -(-n // query_rows))
        part = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
        asked = _packed(probed(queries, everything).withColumn("part", part), ["list", "part", "blocks"], ["floor"])
        # Each pack of queries goes to every block of its list: a unit is a block and a pack.
        asked = asked.select("list", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "floor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        units = stored.join(asked.hint("shuffle_merge"), ["list", "block"]).select("ids", "vecs", "q_ids", "q_vecs", "floor")
        return units.mapInArrow(scan, "query_id long, vec_id long, score double")

    queries = checkpointed(rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec")))
    found = checkpointed(found_for(queries, queries.count(), False))
    # Tests may abandon so many that fewer than k are left: such queries, rare ones, are
    # answered by all lists without any test.
    own = rows.join(queries.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    have = found.groupBy(F.col("query_id").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.least(F.lit(k), F.lit(n_rows) - F.col("own"))
    short = checkpointed(own.join(have, F.col("id") == F.col("h"), "left").where(F.coalesce("n", F.lit(0)) < wanted).select("id"))
    if n_short := short.count():
        again = found_for(queries.join(short, "id", "left_semi"), n_short, True)
        found = found.join(short, F.col("query_id") == F.col("id"), "left_anti").unionByName(again)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
