import hashlib
import re
from collections import Counter

from bucketlake.llm import exact_dedup
from bucketlake.llm.common import without_ids

SCHEMA = "doc_id long, text string, digest string, kept int"


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    return {(n, m[4]): (min(g)[4], len(g)) for n, g in groups.items() for m in g}


def test_against_brute_force(spark):
    long = "wörd " * 50_000
    rows = [(0, None), (1, ""), (2, " \t\n\r\x0b\x0c"), (3, "ab c"), (4, "a bc"), (5, "abc"), (6, "ab c"), (7, "ABC"), (8, long), (9, long + " "), (9, long + " "), (10, "é"), (None, "abc"), (12, "x" * 300 + "y"), (13, "x" * 300 + "z"), (14, "x" * 300 + " y")]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)
    want = brute(rows)
    for bits in (1 << 16, 1 << 25):
        got = exact_dedup.exact_duplicates(df, hash_all=True, filter_bits=bits).collect()
        assert len(got) == len(rows)
        norm = {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).digest(): re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows}
        for r in got:
            assert (r.keep_id, r.group_size) == want[norm[bytes(r.digest)], r.id]
        assert sum(r.kept for r in got) == len({n for n, _ in want})
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 6, 7, 9, 10, 13, 14]


def test_each_step_takes_the_survivors_of_the_last(spark):
    rows = [(i, "a" * (1000 + i)) for i in range(20)]  # told by length
    rows += [(100 + i, f"{i:02d}" + "b" * 500) for i in range(15)]  # by prefix
    rows += [(200 + i, "c" * 400 + f"{i:02d}") for i in range(10)]  # by content only
    rows += [(300 + i, " d" * 300 + " " * i) for i in range(5)]  # copies
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(df).collect()
    assert Counter(r.step for r in got) == {exact_dedup.BY_LENGTH: 20, exact_dedup.BY_PREFIX: 15, exact_dedup.BY_CONTENT: 15}
    assert all((r.digest is not None) == (r.step == exact_dedup.BY_CONTENT) for r in got)
    assert exact_dedup.prefixes(df, "text", exact_dedup._shared(exact_dedup.lengths(df, "text"), 1 << 20)).count() == 30
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(df).collect()) == [r[0] for r in rows if r[0] < 300] + [304]
    full = exact_dedup.exact_duplicates(df, filter_bits=1 << 3).collect()  # a full bitmap tells nothing, results stay
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in full) == sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got)


def test_without_ids_beyond_the_broadcast(spark):
    rows = [(i if i else None, f"t{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.slot` int").repartition(7)
    for gone in ([], [None, 5, 77], list(range(1, 2900))):
        dropped = spark.createDataFrame([(g,) for g in gone], "id long")
        want = sorted(r[1] for r in rows if r[0] not in gone)
        for options in ({}, {"most": 0}, {"most": 0, "bits": 1 << 17}):
            got = without_ids(df, "doc_id", dropped, **options)
            assert got.columns == df.columns and sorted(r.text for r in got.collect()) == want


def test_clashing_columns(spark):
    rows = [(1, "a b", 1, 2, 3, 4, 5), (2, "ab", 1, 2, 3, 4, 5), (3, "b", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, step int, row int, __id int, Digest int")
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(df).collect()) == [1, 3]
    assert exact_dedup.drop_exact_duplicates(df).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(df).count() == 0
    assert exact_dedup.drop_exact_duplicates(df).count() == 0
