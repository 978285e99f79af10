import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from bucketlake.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "<p>" + "é" * 80
ROWS = [
    (5, "http://a/5", BIG, "x"), (3, "http://a/3", BIG, None), (3, "http://a/3", BIG, None), (9, None, BIG, None), (1, "http://b/\r\n1", "small", None),
    (2, "http://b/2", "small", None), (4, "http://b/4", None, None), (6, "u", "", None), (None, "u", BIG, None), (7, "u", "y" * 99, None), (8, "u", "y" * 99, None),
    (10, "u", "z" * 100, None), (11, "u", "z" * 100, None), (12, "u", "\r\n\r\nWARC/1.1\r\n" * 30_000, None),
]


def brute(rows):
    out = []
    groups = {}
    for i, (page_id, _, html, _) in enumerate(rows):
        payload = (html or "").encode()
        if len(payload) >= 100:
            groups.setdefault(payload, []).append((page_id is None, page_id or 0, i))
    for i, (page_id, _, html, _) in enumerate(rows):
        payload = (html or "").encode()
        first = min(groups[payload]) if payload in groups else None
        revisit = first is not None and first[2] != i
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", rows[first[2]][0] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("ranges", "roll"), [(1, 1), (3, 400), (4, 1 << 20)])
def test_round_trip(spark, tmp_path, ranges, roll):
    df = spark.createDataFrame(ROWS, SCHEMA)
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archive(df, folder, ranges=ranges, roll_bytes=roll)
    back = warc.read_archive(spark, manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr) == brute(ROWS)
    texts = {r[0]: (r[2] or "").encode() for r in ROWS}
    assert all(bytes(r.payload) == texts[r.page_id] for r in back if r.record_type == "response")
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith("_")]
    names = {r.path: r.sha256 for r in spark.read.parquet(manifest).collect()}
    assert names == {f: hashlib.sha256((tmp_path / "a" / f).read_bytes()).hexdigest() for f in os.listdir(tmp_path / "a") if f.endswith(".gz")}
    again = warc.write_archive(df, f"file://{tmp_path}/b", ranges=ranges, roll_bytes=roll)
    assert names == {r.path: r.sha256 for r in spark.read.parquet(again).collect()}
    for f in names:
        assert gzip.decompress((tmp_path / "a" / f).read_bytes()).startswith(b"WARC/1.1\r\n")
    with pytest.raises(FileExistsError):
        warc.write_archive(df, folder, ranges=1)


def test_damage_is_noticed(spark, tmp_path):
    record = warc.record_bytes(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None, False, warc.DATE)
    fields, block = warc.parse(record)
    assert block == b"abc" and fields["X-Page-ID"] == "1"
    with pytest.raises(ValueError):
        warc.parse(record[:-1])


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert warc.read_archive(spark, warc.write_archive(df, f"file://{tmp_path}/e")).count() == 0


def test_reading_is_dealt_out(spark, tmp_path):
    """Adaptive execution must not merge the tiny manifest rows into one task."""
    df = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(cast(id AS string), 256), 40) AS html")
    manifest = warc.write_archive(df, f"{tmp_path}/c", ranges=4, roll_bytes=4000)
    assert spark.read.parquet(manifest).count() > 30
    read = warc.read_archive(spark, manifest, with_payload=False)
    by_task = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) >= warc.TASKS_A_CORE * spark.sparkContext.defaultParallelism - 2 and sum(by_task) == 400 and max(by_task) < 130
    warc.remove_archive(spark, manifest)
    assert not os.path.exists(tmp_path / "c")


def test_query_leaves_no_archive(spark):
    from bucketlake.llm.common import shared_dir
    from bucketlake.llm.queries import QUERIES

    assert QUERIES["op10_warc"](spark, "/root/testdata/sf0.001").count() == 50
    assert not [f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("warc-")]
