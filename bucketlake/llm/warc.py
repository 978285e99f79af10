"""WARC archives: a deterministic sharded writer, and a reader.

Writing. Payloads are digested where they lie; their bytes give the number of ranges
(``RANGE_BYTES`` each, but one a core at least). Digests that occur more than once
choose their response, the smallest id, in an aggregate of rows of a few dozen
bytes; the rows that become revisits learn it by a join of such rows. The records
are then range-sorted by id in one shuffle, together with those decisions, and each
range is written by one task as a run of gzip files, one member a record. A file is
closed when its compressed size reaches ``roll_bytes``. Headers and digests are made
anew from the payload; record ids are name-based and the date is a parameter, so
equal input and ranges give equal bytes.

Committing. A task writes to a name of its own attempt and renames the file when it
is complete; a file's name has its range, number and content digest. Each task
returns the files it completed. The driver of the query collects that list only as
a table: the manifest, a Parquet table, is written first under a temporary name and
renamed last, which is the commit. Readers read the files that the manifest names
and no others, so remains of lost attempts are never read.

Reading. The manifest's bytes give the number of reading tasks (``READ_BYTES`` of
files each, but ``TASKS_A_CORE`` a core or one a file at least). Files are dealt out to
them by their manifest rows and parsed as streams, member by member; a task holds one
record at a time. Digest and length of each
response are checked against its headers.

The archive folder can be in any store that pyarrow's file systems open (local,
HDFS, S3, GCS); it must be shared by driver and executors.

Defined results
  null html          the empty payload
  small payloads     under ``min_dedup`` bytes: always responses
  equal ids          with equal payloads: the first is the response, others revisit
  null id            kept; such a record's id is null, and is chosen last
  null url           the record has no WARC-Target-URI
  long payloads      whole; a record is held in memory, once packed and once not
  ties               equal ids and payloads are ordered by url
  extra columns      are ignored, whatever their names
  empty table        an empty manifest; reading gives no rows
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, qualified, remove_folder, shared_dir

MIN_DEDUP = 100
ROLL_BYTES = 32 << 20
RANGE_BYTES = 64 << 20
READ_BYTES = 128 << 20
TASKS_A_CORE = 2
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "path string, first_id long, last_id long, records long, bytes long, sha256 string"
_READ = 1 << 20


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a qualified path."""
    return pafs.FileSystem.from_uri(path)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has no block; it names the response."""
    block = b"" if revisit else payload
    urn = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}|{revisit}").urn
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    else:
        lines.append(f"WARC-Block-Digest: sha256:{digest}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes members to files that are closed by compressed size."""

    def __init__(self, folder: str, part: int, roll_bytes: int):
        self.fs, self.root = open_store(folder)
        self.part, self.roll, self.number, self.out = part, roll_bytes, 0, None
        self.fs.create_dir(self.root, recursive=True)

    def add(self, page_id: int | None, record: bytes) -> dict | None:
        if self.out is None:
            self.temporary = f"{self.root}/_tmp-{self.part:05d}-{self.number:05d}-{uuid.uuid4().hex}"
            self.out, self.size, self.count, self.first, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, page_id, hashlib.sha256()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.count, self.last = self.size + len(member), self.count + 1, page_id
        return self.close() if self.size >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out, digest = None, self.sha.hexdigest()
        name = f"part-{self.part:05d}-{self.number:05d}-{digest[:16]}.warc.gz"
        self.fs.move(self.temporary, f"{self.root}/{name}")
        self.number += 1
        return {"path": name, "first_id": self.first, "last_id": self.last, "records": self.count, "bytes": self.size, "sha256": digest}


def _digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))


def write_archive(pages: DataFrame, folder: str, *, min_dedup: int = MIN_DEDUP, roll_bytes: int = ROLL_BYTES, ranges: int | None = None, date: str = DATE) -> str:
    """Write ``pages`` (page_id, url, html) below ``folder`` and return the path of
    the committed manifest."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    every = checkpointed(_digests(pages))
    total = every.agg(F.sum("n")).first()[0] or 0
    rows = every.where(f"n >= {min_dedup}")
    chosen = checkpointed(
        rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("digest").alias("d"), "first")
    )
    # Rows of shared payloads learn their response. The sides are checkpoints, so a
    # payload that holds a large share of the rows can be split.
    decided = rows.join(chosen, rows.digest == chosen.d).select("page_id", "digest", "first").distinct()
    kind = pages.schema["page_id"].dataType.simpleString()
    text = [F.col(c).cast("string").alias(c) for c in ("url", "html")]
    items = (
        bounded_batches(pages).select("page_id", *text, F.lit(None).cast("string").alias("digest"), F.lit(None).cast(kind).alias("first"), F.lit(1).alias("kind"))
        .unionByName(decided.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first", F.lit(0).alias("kind")))
    )
    n = ranges or max(math.ceil(total / RANGE_BYTES), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    dealt = items.repartitionByRange(n, F.col("page_id").asc_nulls_last()).sortWithinPartitions(F.col("page_id").asc_nulls_last(), "kind", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        roller, done = _Roller(folder, TaskContext.get().partitionId(), roll_bytes), []
        current, known, given = object(), {}, set()
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, first, sort = (batch.column(c)[i].as_py() for c in range(6))
                if page_id != current:
                    current, known, given = page_id, {}, set()
                if sort == 0:
                    known[digest] = first
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                revisit = digest in known and (known[digest] != page_id or digest in given)
                given.add(digest)
                done.append(roller.add(page_id, record_bytes(page_id, url, payload, digest, known.get(digest), revisit, date)))
        done.append(roller.close())
        if files := [f for f in done if f]:
            yield pa.RecordBatch.from_pylist(files, schema=pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    manifest = f"{folder}/manifest"
    pending = f"{folder}/_pending-{uuid.uuid4().hex}"
    dealt.mapInArrow(write, _SCHEMA).write.parquet(pending)
    _rename(spark, pending, manifest)
    return manifest


def _rename(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path(target)) or not store.rename(path(source), path(target)):
        raise FileExistsError(f"{target} exists or can't be written")


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = rest or stream.read(_READ)
            if not data:
                if parts:
                    raise ValueError("the file ends within a record")
                return
            parts.append(unpacker.decompress(data))
            rest = unpacker.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def read_archive(spark: SparkSession, manifest: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (of responses; null without ``with_payload``)."""
    manifest = qualified(spark, manifest)
    folder = manifest.rsplit("/", 1)[0]
    files = spark.read.parquet(manifest)
    size = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    # A number that is asked for is kept; without one, tiny rows would end in one task.
    tasks = max(1, min(size["files"], max(math.ceil(size["bytes"] / READ_BYTES), TASKS_A_CORE * spark.sparkContext.defaultParallelism)))
    files = files.select("path").repartitionByRange(tasks, "path")
    shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, held = [], 0
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for record in members(stream):
                        fields, block = parse(record)
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if not revisit and (hashlib.sha256(block).hexdigest() != digest or len(block) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        number = lambda k, f=fields: int(f[k]) if f.get(k) else None
                        out.append({
                            "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest,
                            "record_type": "revisit" if revisit else "response", "refers_to": number("X-Refers-To-Page-ID"), "payload": block if with_payload and not revisit else None,
                        })
                        held += len(block) if with_payload else 0
                        if len(out) >= 1000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=shape)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=shape)

    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def remove_archive(spark: SparkSession, manifest: str) -> None:
    """Delete an archive with its manifest."""
    remove_folder(spark, qualified(spark, manifest).rsplit("/", 1)[0])
