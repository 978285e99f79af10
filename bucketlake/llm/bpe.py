"""Byte-level BPE: overlapping chunk encoding, and decoding.

Encoding. A text is cut into chunks that overlap. Each chunk is pre-tokenised on
its own, as if the text began there. A match depends only on what follows its
start, so once a boundary of one chunk is also a boundary of the true
segmentation, all later ones are. Neighbouring chunks are stitched at the first
boundary that both found in their overlap; matches that touch the end of a chunk
are not relied on. Where an overlap has no common boundary (one run of letters
longer than the overlap, say) the left chunk is read on past its end, until the
two agree. The pieces are then encoded one by one; equal pieces are encoded once
a worker.

Chunks of long texts are spread over tasks: the text is cut in the scan, chunks
are dealt out by (row, chunk), neighbours exchange only the boundaries of their
overlaps, and each chunk encodes the pieces from where it met its left neighbour to
where it meets its right one. The task that ends up with a row only puts the ids of its
chunks one after the other. Rows in which two neighbours don't meet, rare ones, are
stitched and encoded in order by one task. Texts of a single chunk never leave the
scan's task.

Ids travel as packed little-endian unsigned 32-bit integers; ``unpack_ids`` makes
arrays of them. Decoding concatenates the raw bytes of the ids.

Defined results
  null text       encoded as the empty text: no ids
  empty text      no ids, empty bytes
  very long text  whole, in chunks; its ids are one value
  ties            of merges go to the lower rank, then to the left, as in the library
  repeated rows   each has its row
  extra columns   pass through; those named like the result are replaced by it
  empty table     empty result
  unknown id      decoding raises ValueError naming it
  special tokens  are ordinary text
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, text_or_empty, with_columns

CHUNK = 1 << 16
OVERLAP = 512
#: Ranks are broadcast; a vocabulary beyond this is refused.
MAX_RANKS = 1 << 20
_CACHE_PIECES = 100_000
_CODERS: dict[tuple[str, str], object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank a line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{path} has {len(ranks)} ranks, more than {MAX_RANKS}")
    return ranks


def unicode_gaps() -> dict[int, int]:
    """Code points that the two pattern engines put into different classes.

    The engines know different Unicode versions. Each such code point is mapped
    to one of the class that tiktoken's engine sees, on which both agree; pieces
    are then cut where tiktoken would cut them.
    """
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    single = {bytes([b]): b for b in range(256)}
    seen = {}
    for name, pattern in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        probe = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(probe.encode_ordinary(every)).decode())
        ours = set(regex.findall(pattern, every))
        seen[name] = (theirs, theirs ^ ours)
    stand_in = {"L": "\u4e2d", "N": "\u0663", "S": "\u2003"}
    gaps = set().union(*(diff for _, diff in seen.values()))
    return {ord(c): ord(next((stand_in[n] for n, (theirs, _) in seen.items() if c in theirs), "\u00a7")) for c in gaps}


class Encoder:
    """Pre-tokeniser and piece encoder of one vocabulary."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], gaps: dict[int, int] | None = None):
        self.pattern = regex.compile(pattern)
        self.gaps = unicode_gaps() if gaps is None else gaps
        # A class of the basic plane is a bit table; one with other planes in it
        # would be searched item by item, so texts with any of those are translated.
        low = "".join(re.escape(chr(c)) for c in sorted(self.gaps) if c < 0x10000)
        self.odd = re.compile(f"[{low}\U00010000-\U0010ffff]") if self.gaps else re.compile(r"(?!)")
        self.narrow = min(self.gaps, default=0x110000) > 0xFF
        # Pieces are cut here; to this encoder each of them is one match.
        self.core = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.pieces: dict[str, bytes] = {}

    # -- pre-tokenising -------------------------------------------------
    def plain(self, text: str) -> str:
        """The text with a stand-in, of equal length, for each code point that the
        pattern engines class differently."""
        if text.isascii():
            return text
        if self.narrow:
            try:
                text.encode("latin-1")
                return text
            except UnicodeEncodeError:
                pass
        return text.translate(self.gaps) if self.odd.search(text) else text

    def cuts(self, text: str, start: int, stop: int) -> list[int]:
        """Boundaries of the matches of text[start:stop], ``start`` included. The
        pattern is taken to match everywhere, as byte-level patterns do."""
        out = [start]
        for m in self.pattern.finditer(text, start, stop):
            a, b = m.span()
            if a != out[-1]:
                out.append(a)
            out.append(b)
        return out

    def boundaries(self, text: str, chunk: int, overlap: int) -> list[int]:
        """True boundaries of the whole text, by chunks and stitching."""
        size = len(text)
        if size <= chunk:
            return self.cuts(text, 0, size)
        starts = list(range(0, size, chunk))
        true = [0]
        for k, start in enumerate(starts):
            stop = min(size, start + chunk + overlap)
            own = self.cuts(text, start, stop)
            if k == 0:
                true = self._sure(own, stop, size)
                continue
            if true[-1] >= size:
                break
            true = self._stitch(text, true, own, start, stop, overlap)
        return true

    @staticmethod
    def _sure(cuts: list[int], stop: int, size: int) -> list[int]:
        """Without the boundaries that the end of a chunk may have made."""
        if stop >= size:
            return cuts
        return cuts[: max(1, len(cuts) - 2)]

    def _stitch(self, text: str, true: list[int], own: list[int], start: int, stop: int, overlap: int) -> list[int]:
        size = len(text)
        own = self._sure(own, stop, size)
        found = set(own)
        at = bisect_left(true, start)
        for k in range(at, len(true)):
            if true[k] in found:
                return true[: k + 1] + own[bisect_left(own, true[k]) + 1 :]
        # No common boundary yet: read on from the last true one.
        position = true[-1]
        while position < size:
            m = self.pattern.search(text, position)
            if m is None:
                break
            a, b = m.span()
            if a != true[-1]:
                true.append(a)
            true.append(b)
            position = b
            if b in found:
                return true + own[bisect_left(own, b) + 1 :]
            if b >= stop:
                break
        return true

    # -- encoding -------------------------------------------------------
    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = np.array(self.core.encode_ordinary(piece), "<u4").tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= _CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        """Packed ids of a whole text."""
        plain = self.plain(text)
        if len(text) <= chunk and plain is text and not self.pattern.groups:
            piece, known = self.piece, self.pieces.get
            return b"".join([known(p) or piece(p) for p in self.pattern.findall(text)])
        return self.encode_between(text, self.boundaries(plain, chunk, overlap))

    def encode_between(self, text: str, cuts: list[int]) -> bytes:
        piece, known = self.piece, self.pieces.get
        return b"".join([known(p) or piece(p) for p in (text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))])


class Decoder:
    """Token bytes by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        try:
            return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])
        except (IndexError, TypeError):
            bad = next(i for i in np.frombuffer(packed, "<u4").tolist() if i >= len(tokens) or tokens[i] is None)
            raise ValueError(f"id {bad} is not in the vocabulary") from None


class Vocabulary:
    """A vocabulary that executors get by broadcast; the file is read once, on
    the driver. Its size is bounded by ``MAX_RANKS``."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = load_ranks(path)
        self.pattern = pattern
        self.key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self.held = spark.sparkContext.broadcast((ranks, unicode_gaps()))

    def encoder(self) -> Encoder:
        return self._coder("encode", lambda: Encoder(self.pattern, *self.held.value))

    def decoder(self) -> Decoder:
        return self._coder("decode", lambda: Decoder(self.held.value[0]))

    def _coder(self, kind: str, make: Callable):
        """A worker keeps the coders of one vocabulary."""
        if (kind, self.key) not in _CODERS:
            for other in [k for k in _CODERS if k[1] != self.key]:
                del _CODERS[other]
            _CODERS[kind, self.key] = make()
        return _CODERS[kind, self.key]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "ids", *, decoded_col: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns of ``docs`` but the text, and the packed ids as ``out_col``. With
    ``decoded_col`` the ids are decoded too, as ``decode`` would after it, by the same
    workers: a chain of two operators would hold twice as many."""
    if not 0 < overlap < chunk:
        raise ValueError("chunks are longer than their overlap")
    results = [out_col, *([decoded_col] if decoded_col else [])]
    names = [c for c in docs.columns if c.lower() not in (text_col.lower(), *(r.lower() for r in results))]
    # Under names of our own, whatever those of the columns are.
    kept, text, result = [f"k{i}" for i in range(len(names))], "text", "ids"
    source = bounded_batches(docs).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept, strict=True)], text_or_empty(text_col).alias(text))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    made = [result, *(["decoded"] if decoded_col else [])]
    out_schema = ", ".join([*fields, *(f"{m} binary" for m in made)])

    def finished(columns: list, ids: list[bytes]) -> pa.RecordBatch:
        """Rows of the result, from their kept columns and their ids."""
        arrays = [pa.array(ids, pa.binary())]
        if decoded_col:
            coder = vocabulary.decoder()
            arrays.append(pa.array([coder.decode(i) for i in ids], pa.binary()))
        return pa.RecordBatch.from_arrays([*columns, *arrays], names=[*kept, *made])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.encoder()
        for batch in batches:
            yield finished(batch.columns[:-1], [coder.encode(t.as_py(), chunk, overlap) for t in batch.column(batch.num_columns - 1)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk a row: row number, chunk number, text with its overlap. The
        kept columns go with the first chunk only."""
        for batch in batches:
            at = batch.num_columns - 2
            for i in range(batch.num_rows):
                value, row = batch.column(at)[i].as_py(), batch.column(at + 1).slice(i, 1)
                for k, start in enumerate(range(0, len(value), chunk)):
                    own = [c.slice(i, 1) if k == 0 else pa.nulls(1, c.type) for c in batch.columns[:at]]
                    part = pa.array([value[start : start + chunk + overlap]], pa.string())
                    last = pa.array([start + chunk + overlap >= len(value)])
                    yield pa.RecordBatch.from_arrays([*own, row, pa.array([k], pa.int32()), part, last], names=[*kept, "__row", "__chunk", text, "__last"])

    def cuts_of(coder: Encoder, part: str) -> np.ndarray:
        return np.array(coder.cuts(coder.plain(part), 0, len(part)), "<i4")

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.encoder()
        for batch in batches:
            cuts = [cuts_of(coder, t.as_py()).tobytes() for t in batch.column(len(kept) + 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, pa.binary())], names=[*batch.schema.names, "__cuts"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, n = vocabulary.encoder(), len(kept)
        for columns, ids in _stitched(coder, batches, n, chunk):
            yield finished(columns, [ids])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The boundaries of a chunk's overlaps, in the coordinates of the right chunk:
        for the pair with its right neighbour, and for that with its left one."""
        coder = vocabulary.encoder()
        for batch in batches:
            rows, pairs, lefts, rights = [], [], [], []
            for row, k, part, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = cuts_of(coder, part)
                if not last:
                    cuts = cuts[: max(1, len(cuts) - 2)]
                    tail = cuts[np.searchsorted(cuts, chunk) :] - chunk
                    rows, pairs, lefts, rights = [*rows, row], [*pairs, k], [*lefts, tail.astype("<i4").tobytes()], [*rights, None]
                if k:
                    head = cuts[: np.searchsorted(cuts, overlap, side="right")]
                    rows, pairs, lefts, rights = [*rows, row], [*pairs, k - 1], [*lefts, None], [*rights, head.astype("<i4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(pairs, pa.int32()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], names=["__r", "__k", "left", "right"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the two chunks of a pair first agree; -1 if they don't."""
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                common = np.intersect1d(np.frombuffer(x or b"", "<i4"), np.frombuffer(y or b"", "<i4"))
                found.append(int(common[0]) if len(common) else -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["__r", "__k", "__meet"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of each chunk's own pieces."""
        coder, n = vocabulary.encoder(), len(kept)
        for batch in batches:
            ids = []
            for i in range(batch.num_rows):
                part = batch.column(n + 2)[i].as_py()
                begin, end, cuts = batch.column(n + 4)[i].as_py() or 0, batch.column(n + 5)[i].as_py(), cuts_of(coder, part)
                stop = len(part) if end is None else end + chunk
                own = cuts[np.searchsorted(cuts, begin) : np.searchsorted(cuts, stop, side="right")].tolist()
                ids.append(coder.encode_between(part, own))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], pa.array(ids, pa.binary())], names=[*kept, "__row", "__chunk", result])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, row, columns, out = len(kept), None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column(n)[i].as_py()
                if now != row:
                    if row is not None:
                        yield finished(columns, [b"".join(out)])
                    row, columns, out = now, [batch.column(c).slice(i, 1) for c in range(n)], []
                out.append(batch.column(n + 2)[i].as_py())
        if row is not None:
            yield finished(columns, [b"".join(out)])

    parts_schema = ", ".join([*fields, "__row long, __chunk int", f"{text} string", "__last boolean"])
    size = F.length(text)
    long = source.where(size > chunk).withColumn("__row", F.monotonically_increasing_id())
    # Chunks are cut anew where boundaries are needed: they are no larger than texts.
    pieces = long.mapInArrow(cut, parts_schema).repartition("__row", "__chunk")
    sides = pieces.select("__row", "__chunk", text, "__last").mapInArrow(edges, "__r long, __k int, left binary, right binary")
    pairs = sides.groupBy("__r", "__k").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    meets = checkpointed(pairs.mapInArrow(meet, "__r long, __k int, __meet int"))
    apart = checkpointed(meets.where("__meet < 0").select(F.col("__r").alias("__a")).distinct())
    begins = meets.select(F.col("__r").alias("__b"), (F.col("__k") + 1).alias("__bk"), F.col("__meet").alias("__begin"))
    ends = meets.select(F.col("__r").alias("__e"), F.col("__k").alias("__ek"), F.col("__meet").alias("__end"))
    met = pieces.join(apart, F.col("__row") == F.col("__a"), "left_anti")
    met = met.join(begins, (F.col("__row") == F.col("__b")) & (F.col("__chunk") == F.col("__bk")), "left").join(ends, (F.col("__row") == F.col("__e")) & (F.col("__chunk") == F.col("__ek")), "left")
    ids_schema = ", ".join([*fields, "__row long, __chunk int", f"{result} binary"])
    parted = met.drop("__b", "__bk", "__e", "__ek").mapInArrow(between, ids_schema)
    out = source.where(size <= chunk).mapInArrow(whole, out_schema).unionByName(parted.repartition("__row").sortWithinPartitions("__row", "__chunk").mapInArrow(gathered, out_schema))
    if apart.limit(1).count():
        rest = pieces.join(apart, F.col("__row") == F.col("__a"), "left_semi").mapInArrow(pretokenise, parts_schema + ", __cuts binary").repartition("__row").sortWithinPartitions("__row", "__chunk")
        out = out.unionByName(rest.mapInArrow(stitch, out_schema))
    return out.toDF(*names, *results)


def _stitched(coder: Encoder, batches: Iterator[pa.RecordBatch], n: int, chunk: int) -> Iterator[tuple[list, bytes]]:
    """The kept columns and the packed ids of each row, from its chunks in order.

    Holds one chunk beyond those being stitched: ``text`` is what has no ids yet,
    ``base`` its place in the row, ``true`` its boundaries that are certain.
    """
    row, columns, out, text, base, true = None, [], [], "", 0, [0]

    def flush() -> bytes:
        out.append(coder.encode_between(text, coder.cuts(coder.plain(text), 0, len(text)) if true[-1] < len(text) else true))
        return b"".join(out)

    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column(n)[i].as_py() != row:
                if row is not None:
                    yield columns, flush()
                row, out, text, base, true = batch.column(n)[i].as_py(), [], "", 0, [0]
                columns = [batch.column(c).slice(i, 1) for c in range(n)]
            start = batch.column(n + 1)[i].as_py() * chunk
            part, last = batch.column(n + 2)[i].as_py(), batch.column(n + 3)[i].as_py()
            own = np.frombuffer(batch.column(n + 4)[i].as_py(), "<i4")
            if not last:
                own = own[: max(1, len(own) - 2)]
            if start == 0:
                text, true = part, own.tolist()
                continue
            # in the coordinates of ``text``
            offset = start - base
            here = true[bisect_left(true, offset) :]
            theirs = own + offset
            common = np.intersect1d(here, theirs)
            if not len(common):
                # No resynchronisation in this overlap: the chunk is joined to the
                # text that waits, which is cut anew from its certain start.
                text += part[len(text) - offset :]
                cuts = coder.cuts(coder.plain(text), 0, len(text))
                true = cuts if last else cuts[: max(1, len(cuts) - 2)]
                continue
            meet = int(common[0])
            upto = bisect_left(true, meet)
            out.append(coder.encode_between(text, true[: upto + 1]))
            text, base = part[meet - offset :], base + meet
            true = (theirs[np.searchsorted(theirs, meet) :] - meet).tolist()
    if row is not None:
        yield columns, flush()


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the raw bytes that the packed ids stand for; null ids give null."""
    names = [c for c in rows.columns if c.lower() != out_col.lower()]
    source = bounded_batches(rows).select(*[F.col(f"`{c}`") for c in names])
    at = names.index(ids_col)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = vocabulary.decoder()
        return [pa.array([None if (p := x.as_py()) is None else coder.decode(p) for x in batch.column(at)], pa.binary())]

    return with_columns(source, [T.StructField(out_col, T.BinaryType())], make)


def n_ids(ids_col: str) -> Column:
    return (F.octet_length(ids_col) / 4).cast("long")
