"""Near-duplicate detection: 64-bit SimHash fingerprints linked through covering
locality-sensitive hashing (Pagh, "Locality-sensitive Hashing without False
Negatives").

Masks. Each of the 64 bit positions gets a non-zero vector m(i) of r+1 bits. For
every non-zero vector v of r+1 bits, mask v keeps the positions whose m(i) has an
odd overlap with v. The vectors of r differing positions span at most r
dimensions, so some non-zero v is orthogonal to all of them, and that mask keeps
none of the differing positions: the pair is equal under it. 2^(r+1) - 1 tables
(15 for r = 3) thus see every pair within the radius, without exception.

Scale. Equal fingerprints are merged first. A table's bucket is one of three
kinds: two members (checked inside the aggregate), up to ``group_limit`` members
(streamed through a task, which links a spanning forest by block comparison), or
more. Large buckets are dealt out again under a second, independent family of
masks, joined with the first: a pair still meets in one of the 15 sub-tables, and
about 48 of the 64 bits are then fixed. Whatever is still large (at most 2^16
fingerprints differ in the 16 free bits) is compared in pairs of chunks, each
pair a unit of its own. Nothing is dropped, no task holds an unbounded bucket,
and only forest edges are emitted, never all pairs.

Similarity. Texts whose five-word shingles are 0.8 alike differ in about 10 of 64
bits. Masks that cover 10 bits would need 2^11 tables with keys of few bits, so with
``similarity`` candidates are added to those of the masks: equal bands of a MinHash
sketch (``BANDS`` of ``BAND_ROWS`` values) bring rows together, and all pairs of a
bucket are compared by ``SKETCH`` values, with ``SLACK`` below the threshold. A pair at
0.8 shares a band with probability 0.998. Candidates, those of the masks too, only form
groups; within a group rows are linked if their sets of shingles, compared whole, are
as similar as asked for. Large buckets and groups are compared in pairs of chunks.

Defined results
  null or blank text    fingerprint zero, linked like any other
  one or two words      the whole sequence is the single shingle
  very long texts       whole; one text's hashes are held, 8 bytes a word
  ties                  a bit that exactly half of the hashes set is 0
  repeated rows         each has its row; they share fingerprint and component
  null id               never a component's id unless all its ids are null
  empty table           empty result
  extra columns         are ignored, whatever their names; dropping keeps them
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, ids_repeat, keep_tagged, release, text_or_empty, without_ids
from .components import components

WORDS = 3
SEED = 42
RADIUS = 3
GROUP_LIMIT = 2048
CHUNK = 2048
SKETCH = 256
BANDS = 21
BAND_ROWS = 6
SKETCH_GROUP = 512
#: Four standard errors of a share of ``SKETCH`` values at 0.8.
SLACK = 0.1
#: So many ids of rows in groups of candidates are broadcast; beyond, they are joined.
BROADCAST_IDS = 100_000
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of texts with fewer words, of the
    whole sequence; of texts without words, none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([h(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint_of(every: np.ndarray) -> int:
    """A bit is set if over half the hashes set it."""
    ones = np.zeros(64, np.int64)
    every = every.astype("<u8", copy=False)
    for at in range(0, len(every), _BLOCK):
        part = every[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(every), bitorder="little").view("<u8")[0]) if len(every) else 0


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text, unsigned."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def covering_masks(radius: int, seed: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits, as signed longs.

    The vectors m(i) are dealt evenly over the non-zero values, so every mask
    keeps half of the positions or a little more.
    """
    size = 1 << (radius + 1)
    vectors = np.random.default_rng(seed).permutation(np.arange(64) % (size - 1) + 1)
    masks = []
    for v in range(1, size):
        kept = [i for i in range(64) if int(vectors[i] & v).bit_count() % 2]
        mask = sum(1 << i for i in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _tables(masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("mask")) for k, m in enumerate(masks)])


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _forest(ids: np.ndarray, values: np.ndarray, near: Near) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links within a group."""
    left, right, rest = [], [], np.arange(len(ids))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            close = near(values[rest], values[node])
            if close.any():
                found = rest[close]
                left += [int(ids[node])] * len(found)
                right += ids[found].tolist()
                frontier += found.tolist()
                rest = rest[~close]
    return left, right


def _across(ids: np.ndarray, values: np.ndarray, second: np.ndarray, near: Near) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links between two chunks; ``second`` tells
    which rows are of the second."""
    left, right = [], []
    open_ = [np.flatnonzero(~second), np.flatnonzero(second)]
    while len(open_[0]) and len(open_[1]):
        frontier, open_[0] = [(open_[0][0], 0)], open_[0][1:]
        while frontier:
            node, mine = frontier.pop()
            other = open_[1 - mine]
            close = near(values[other], values[node])
            if close.any():
                found = other[close]
                left += [int(ids[node])] * len(found)
                right += ids[found].tolist()
                frontier += [(x, 1 - mine) for x in found.tolist()]
                open_[1 - mine] = other[~close]
    return left, right


def _within(radius: int) -> Near:
    # a count of signed values would take their absolute values
    return lambda many, one: np.bitwise_count(many.view(np.uint64) ^ one.view(np.uint64)) <= radius


def _alike(share: float) -> Near:
    return lambda many, one: (many == one).mean(axis=1) >= share


def _confirmed(marks: np.ndarray, sets: list[np.ndarray], share: float) -> Near:
    """Compares rows, given by their place: sketches first, then whole sets."""
    hint = _alike(share - SLACK)

    def near(many: np.ndarray, one: np.ndarray) -> np.ndarray:
        close = hint(marks[many], marks[one])
        for k in np.flatnonzero(close):
            close[k] = similarity_of(sets[many[k]], sets[one]) >= share
        return close

    return near


def _link_groups(rows: DataFrame, keys: list[str], near: Near | None, side: bool, sketch: bool = False, share: float | None = None) -> DataFrame:
    """(u, v) in terms of fp: forest edges of each group of ``rows``; groups are
    streamed in key order. Rows are compared by fp, with ``sketch`` by sketch, or with
    ``share`` by sketch and set.

    ``side`` tells that rows carry a ``side`` column: 2 links within a chunk, 0
    and 1 are two chunks that are linked with each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(group: pa.Table) -> pa.RecordBatch | None:
            ids = group.column("fp").to_numpy()
            values = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u2").reshape(len(ids), -1) if sketch else np.ascontiguousarray(ids)
            where = group.column("side").to_numpy() if side else None
            whole = where is None or where[0] == 2
            linking = near
            if share is not None:
                linking = _confirmed(values, [np.frombuffer(x, "<u8") for x in group.column("set").to_pylist()], share)
                values = np.arange(len(ids))
            a, b = _forest(ids, values, linking) if whole else _across(ids, values, where == 1, linking)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"]) if a else None

        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            columns = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(len(table), bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (out := linked(table.slice(a, b - a))) is not None:
                    yield out
            kept = table.slice(cuts[-1]).combine_chunks()
        if kept is not None and len(kept) and (out := linked(kept)) is not None:
            yield out

    shaped = rows.select(*keys, "fp", *(["sketch"] if sketch else []), *(["set"] if share is not None else []), *(["side"] if side else []))
    return shaped.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def _units(large: DataFrame, keys: list[str], chunk: int, spread: Column) -> DataFrame:
    """Rows of large buckets, of size ``n``, dealt out as pairs of chunks."""
    placed = large.withColumn("blocks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(spread, F.col("blocks")).cast("int"))
    own = [c for c in large.columns if c not in (*keys, "n")]
    return placed.select(*keys, *own, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        *keys, *own,
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )


def _bucket_edges(rows: DataFrame, keys: list[str], radius: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Edges of the buckets of at most ``limit`` members, and the rows of larger
    buckets with their size ``n``."""
    sizes = checkpointed(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1")
    )
    pairs = sizes.where(f"n = 2 AND bit_count(low ^ high) <= {radius}").select(F.col("low").alias("u"), F.col("high").alias("v"))
    some = rows.join(sizes.where(f"n > 2 AND n <= {limit}").select(*keys), keys, "left_semi")
    large = rows.join(sizes.where(f"n > {limit}").select(*keys, "n"), keys)
    return pairs.union(_link_groups(some, keys, _within(radius), side=False)), large


def links(fps: DataFrame, radius: int = RADIUS, group_limit: int = GROUP_LIMIT, chunk: int = CHUNK, seed: int = 7) -> DataFrame:
    """(u, v): a forest for each group of distinct fingerprints ``fps`` (fp) that
    are linked within the radius; it has the same components as all links."""
    first, second = covering_masks(radius, seed), covering_masks(radius, seed + 1)
    dealt = fps.select("fp", F.explode(_tables(first)).alias("t")).select(
        "fp", F.col("t.k").alias("k1"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("part1"), F.col("t.mask").alias("mask1")
    )
    edges, large = _bucket_edges(dealt, ["k1", "part1"], radius, group_limit)
    again = large.select("fp", "k1", "mask1", F.explode(_tables(second)).alias("t")).select(
        "fp", "k1", F.col("t.k").alias("k2"), F.col("fp").bitwiseAND(F.col("mask1").bitwiseOR(F.col("t.mask"))).alias("part2")
    )
    more, still = _bucket_edges(checkpointed(again), ["k1", "k2", "part2"], radius, group_limit)
    keys = ["k1", "k2", "part2"]
    units = _units(still.select(*keys, "fp", "n"), keys, chunk, F.xxhash64("fp"))
    return edges.union(more).union(_link_groups(units, [*keys, "a", "b"], _within(radius), side=True))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    odd = rng.integers(1, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd[:, None], rng.integers(0, 2**32, SKETCH, dtype=np.uint32)[:, None]


_ODD, _ADD = _multipliers()


def sketch_of(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """Smallest values of ``SKETCH`` permutations of the shingles' hashes: their upper
    halves for comparison, and a key for each band of ``BAND_ROWS`` of them."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    mixed = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(mixed), 1024):
        low = np.minimum(low, (_ODD * mixed[None, at : at + 1024] + _ADD).min(axis=1))
    bands = low[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)]
    return (low >> np.uint32(16)).astype("<u2").tobytes(), [k - (1 << 64) if k >> 63 else k for k in keys]


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats; of empty ones, 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _digest(unique: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(unique.astype("<u8").tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp, digest, sketch, bands); digest is a hash of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests, marks, bands = [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), words)
                fps.append(fingerprint_of(hashes))
                hashes = np.unique(hashes)
                digests.append(_digest(hashes))
                mark, keys = sketch_of(hashes)
                marks.append(mark)
                bands.append(keys)
            fps = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array(digests, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "fp", "digest", "sketch", "bands"])

    id_type = docs.schema[id_col].dataType.simpleString()
    source = bounded_batches(docs).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"id {id_type}, fp long, digest long, sketch binary, bands array<long>")


def sketch_links(rows: DataFrame, share: float, group_limit: int = SKETCH_GROUP) -> DataFrame:
    """(u, v) in terms of fp: a forest for each band's bucket of the rows whose
    sketches agree in ``share`` of their values."""
    marks = checkpointed(rows.groupBy("fp", F.xxhash64("sketch").alias("mark")).agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    dealt = marks.select("fp", "mark", F.posexplode("bands").alias("band", "key"))
    keys = ["band", "key"]
    sizes = checkpointed(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # Only rows that share a bucket fetch their sketch.
    held = marks.select(F.col("fp").alias("f"), F.col("mark").alias("m"), "sketch")
    shared = checkpointed(dealt.join(sizes, keys).join(held, (F.col("fp") == F.col("f")) & (F.col("mark") == F.col("m"))).select(*keys, "fp", "sketch", "n"))
    some = _link_groups(shared.where(F.col("n") <= group_limit), keys, _alike(share), side=False, sketch=True)
    units = _units(shared.where(F.col("n") > group_limit), keys, group_limit, F.xxhash64("fp", "sketch"))
    return some.union(_link_groups(units, [*keys, "a", "b"], _alike(share), side=True, sketch=True))


def similar_links(docs: DataFrame, rows: DataFrame, coarse: DataFrame, id_col: str, text_col: str, words: int, share: float, group_limit: int = SKETCH_GROUP) -> DataFrame:
    """(u, v) in terms of digest: a forest of the links between different sets of
    shingles that are ``share`` alike, within the components ``coarse`` (node, root) of
    the fingerprints of ``rows``."""
    named = rows.select("id", "fp", "digest").join(coarse, rows.fp == coarse.node, "left").select("id", "digest", F.coalesce("root", "fp").alias("root"))
    members = checkpointed(named)
    kinds = members.select("root", "digest").distinct()
    open_ = checkpointed(kinds.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    wanted = checkpointed(kinds.join(open_, "root").groupBy("digest").agg(F.min("root").alias("root"), F.min("n").alias("n")))
    ids = checkpointed(members.join(open_, "root", "left_semi").select(F.col("id").alias("i")).distinct())
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(0)]
            arrays = [pa.array([_digest(x) for x in found], pa.int64()), pa.array([sketch_of(x)[0] for x in found], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["d", "sketch", "set"])

    source = bounded_batches(docs).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    texts = source.join(ids, F.col("id").eqNullSafe(F.col("i")), "left_semi").select("text")
    sets = texts.mapInArrow(run, "d long, sketch binary, set binary").groupBy("d").agg(F.first("sketch").alias("sketch"), F.first("set").alias("set"))
    held = sets.join(wanted, F.col("d") == F.col("digest")).select("root", F.col("d").alias("fp"), "n", "sketch", "set")
    units = _units(held, ["root"], group_limit, F.xxhash64("fp"))
    return _link_groups(units, ["root", "a", "b"], None, side=True, sketch=True, share=share)


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, similarity: float | None) -> DataFrame:
    """(id, fp, digest, component); without ``similarity``, digest is the fingerprint."""
    if similarity is None:
        rows = checkpointed(fingerprints(docs, id_col, text_col, words).withColumn("digest", F.col("fp")))
    else:
        rows = checkpointed(sketches(docs, id_col, text_col, words))
    edges = links(rows.select("fp").distinct(), radius)
    if similarity is not None:
        coarse = checkpointed(components(edges.union(sketch_links(rows, similarity - SLACK))))
        edges = similar_links(docs, rows, coarse, id_col, text_col, words, similarity)
        release(docs.sparkSession)
    roots = checkpointed(components(edges))
    del edges
    release(docs.sparkSession)
    nodes = checkpointed(rows.groupBy("digest").agg(F.min("id").alias("low")))
    # Nodes that have a link, with their root; the others are alone.
    named = nodes.join(roots, nodes.digest == roots.node, "left").select("digest", "low", F.coalesce("root", "digest").alias("root"))
    least = checkpointed(named.groupBy("root").agg(F.min("low").alias("component")))
    named = checkpointed(named.join(least.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("digest").alias("d"), "component"))
    return rows.select("id", "fp", "digest").join(named, F.col("digest") == F.col("d")).select("id", "fp", "digest", "component")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, radius: int = RADIUS, similarity: float | None = None
) -> DataFrame:
    """(id, fp, component): one row per input row; component is the smallest id
    that is reachable through fingerprints at most ``radius`` bits apart or, with
    ``similarity``, through sets of shingles that are at least so similar."""
    return _grouped(docs, id_col, text_col, words, radius, similarity).select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays, with
    all its columns. A group whose ids are all null keeps one row per
    fingerprint, with ``similarity`` per set of shingles."""
    found = _grouped(docs, id_col, text_col, words, radius, similarity)
    kept = F.col("id").eqNullSafe(F.col("component"))
    if not ids_repeat(docs, id_col):
        return without_ids(docs, id_col, found.where(~kept))
    tag = F.unhex(F.lpad(F.hex("digest"), 16, "0")).alias("tag")
    decisions = checkpointed(found.select("id", tag, kept.alias("kept")))

    def tag_of(text: str | None) -> bytes:
        value = fingerprint(text, words) if similarity is None else _digest(np.unique(shingle_hashes(text, words))) & (2**64 - 1)
        return value.to_bytes(8, "big")

    return keep_tagged(docs, decisions, id_col, text_col, tag_of)
