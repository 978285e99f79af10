import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketlake.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        rows = sorted((-v, i) for v, i in zip(s, ids, strict=True) if i != q)[:k]
        out[q] = [(i, -v) for v, i in rows]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 48)).astype(np.float32)
    x[:1000] = x[0] + rng.normal(scale=0.05, size=(1000, 48))  # a hot list
    x *= rng.uniform(0.5, 2, size=(3000, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in enumerate(x)], SCHEMA)
    got = ann.search(df, F.col("id") % 20 == 0, k=20, block_bytes=1 << 15, query_rows=16).collect()
    want = brute(list(range(3000)), x.astype(float), range(0, 3000, 20), 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert by.keys() == want.keys()
    hits = 0
    for q, ranks in by.items():
        assert sorted(ranks) == list(range(1, 21))
        order = [ranks[k] for k in range(1, 21)]
        assert order == sorted(order, key=lambda t: (-t[1], t[0]))
        for i, s in order:
            assert i != q and s == pytest.approx(float(x[i].astype(float) @ x[q].astype(float)), rel=1e-12, abs=1e-12)
        hits += len({i for i, _ in order} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_small_and_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], None, None), (20, [0.0, 1.0], None, None), (1, [1.0, 1.0], None, None), (2, [1.0, 1.0], None, None), (3, [0.0, 0.0], None, None),
        (4, None, None, None), (5, [float("nan"), 1.0], None, None), (6, [None, 1.0], None, None), (7, [float("inf"), 1.0], None, None), (8, [], None, None),
        (9, [1.0, 2.0, 3.0], None, None), (None, [1.0, 1.0], None, None), (40, None, None, None), (2, [1.0, 1.0], None, None),
    ]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 2, 1.0), (20, 4, 0, 0.0),
    ]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ann.search(df, F.col("id") % 20 == 0).count() == 0


def test_scan_of_a_unit():
    """Without doubt the scan is brute force; with it, abandoned pairs are few."""
    rng = np.random.default_rng(2)
    block, queries = rng.normal(size=(500, 50)), rng.normal(size=(40, 50))
    ids, asked = np.arange(500), np.arange(480, 520)
    rotation = np.linalg.qr(rng.normal(size=(50, 50)))[0].astype(np.float32)
    scores = queries @ block.T
    scores[asked[:, None] == ids[None, :]] = -np.inf
    floors = np.sort(scores, axis=1)[:, -15] - 1e-9
    want = {(int(asked[q]), int(ids[c])) for q in range(40) for c in np.flatnonzero(scores[q] >= floors[q])}
    for given in (floors, np.full(40, -np.inf)):
        q, c, found = ann.scan_unit(ids, block, asked, queries, given, rotation, 15, epsilon=100.0)
        assert set(zip(q.tolist(), c.tolist(), strict=True)) == want
        assert np.allclose(found, [queries[a - 480] @ block[b] for a, b in zip(q, c, strict=True)], rtol=1e-12)
    q, c, _ = ann.scan_unit(ids, block, asked, queries, floors, rotation, 15)
    assert len(q) >= 0.9 * len(want) and set(zip(q.tolist(), c.tolist(), strict=True)) <= want
    assert len(ann.scan_unit(ids, block, asked, queries, np.full(40, 1e9), rotation, 15)[0]) == 0


def test_queries_left_short_are_answered_again(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in enumerate(x)], SCHEMA)
    monkeypatch.setattr(ann.Index, "floors", lambda self, ids, queries, probed: np.full(len(ids), 15.0))  # few reach this
    got = ann.search(df, F.col("id") % 20 == 0, k=20).collect()
    want = brute(list(range(600)), x.astype(float), range(0, 600, 20), 20)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {q: [i for i, _ in v] for q, v in want.items()}


def test_repeats_ties_and_clashing_columns(spark):
    rows = [(20 * i, [1.0, float(i % 3)], 1, 2, 3, 4) for i in range(30)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, vec int, list int, n int")
    got = ann.search(df, F.col("id") % 20 == 0, k=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, found in by.items():
        want = sorted((-(1.0 + (i % 3) * (q // 20 % 3)), 20 * i) for i in range(30) for _ in range(2) if 20 * i != q)[:3]
        assert found == [(i, -s) for s, i in want]
    assert len(by) == 30
