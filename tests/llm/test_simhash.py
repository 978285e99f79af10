import itertools

import numpy as np
import xxhash

from bucketlake.llm import simhash
from bucketlake.llm.components import components

SCHEMA = "doc_id long, text string, FP string, id string"


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_fingerprint_matches_brute_force():
    texts = [None, "", " \t\n", "One", "ONE two", "a b c", "É é Ünï x y z w", "the cat sat on the mat " * 40, "x\x0by\x0cz q"]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_masks_cover_every_pair_within_radius():
    rng = np.random.default_rng(0)
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(3, 7)]
    assert len(masks) == 15
    for _ in range(2000):
        bits = rng.choice(64, 3, replace=False)
        delta = sum(1 << int(b) for b in bits)
        assert any(not delta & m for m in masks)


def _near(rng, centre, n, flips):
    out = {centre}
    while len(out) < n:
        x = centre
        for b in rng.choice(64, flips, replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return list(out)


def test_links_have_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(6):
        c = int(rng.integers(0, 2**63))
        fps |= set(_near(rng, c, 60, 2))
        fps |= set(_near(rng, c ^ 0xFF, 30, 4))
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    ids = {f: f for f in fps}
    want = brute_components(ids)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for limit, chunk in ((2048, 2048), (8, 5), (3, 2)):
        got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(simhash.links(df, 3, limit, chunk)).collect()}
        groups, expected = {}, {}
        for f in fps:
            groups.setdefault(got.get(f, f), set()).add(f)
            expected.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_documents(spark):
    base = "one two three four five six seven eight nine ten " * 30
    texts = [None, "", "solo", base, base + "eleven", base.upper(), "quite other words stand here for once " * 9, "solo"]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(3, base, None, None), (None, base, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.id is not None:
            assert r.fp & (2**64 - 1) == fps[r.id] and r.component == want[r.id]
        else:
            assert r.component == want[3]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_similarity(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, family = {}, {}
    for base in range(30):
        words = [rng.choice(vocabulary) for _ in range(300)]
        texts[base * 10] = " ".join(words)
        for k in range(1, 4):  # each change spoils five shingles
            copy = list(words)
            for at in rng.sample(range(300), 2 * k):
                copy[at] = rng.choice(vocabulary)
            texts[base * 10 + k], family[base * 10 + k] = " ".join(copy), base * 10
        far = list(words)
        for at in rng.sample(range(300), 60):
            far[at] = rng.choice(vocabulary)
        texts[base * 10 + 9] = " ".join(far)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.component for r in simhash.near_duplicates(df, words=5, similarity=0.8).collect()}
    assert got == {i: family.get(i, i) for i in texts}
    kept = simhash.drop_near_duplicates(df, words=5, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in texts if i not in family)
    rows = simhash.sketches(df, "doc_id", "text", 5)
    small = {frozenset((r.node, r.root)) for r in components(simhash.sketch_links(rows, 0.775, 2)).collect()}
    assert small == {frozenset((r.node, r.root)) for r in components(simhash.sketch_links(rows, 0.775)).collect()}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df, words=5, similarity=0.8).count() == 0


def test_path_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_links_are_confirmed_by_whole_sets(spark):
    import random

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]

    def sets(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    texts, want = {}, {}
    for base in range(60):
        words = [rng.choice(vocabulary) for _ in range(300)]
        copy = list(words)
        for at in range(0, 300, 300 // (6 + base % 4)):  # 0.71 to 0.83 alike
            copy[at] = rng.choice(vocabulary)
        texts[2 * base], texts[2 * base + 1] = " ".join(words), " ".join(copy)
        a, b = sets(texts[2 * base]), sets(texts[2 * base + 1])
        want |= {2 * base: 2 * base, 2 * base + 1: 2 * base + (len(a & b) / len(a | b) < 0.8)}
    assert 10 < sum(k != v for k, v in want.items()) < 50
    # one line very often: equal fingerprints, other sets
    for k in range(2):
        texts[200 + k] = "one two three four five six " * 500 + " ".join(rng.choice(vocabulary) for _ in range(40))
        want[200 + k] = 200 + k
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.component for r in simhash.near_duplicates(df, words=5, similarity=0.8).collect()}
    assert got == want
    rows = simhash.sketches(df, "doc_id", "text", 5).cache()
    one = rows.select("fp").distinct().selectExpr("fp AS node", "0L AS root")
    names = {r.digest: r.id for r in rows.collect()}
    for limit in (512, 7):
        edges = simhash.similar_links(df, rows, one, "doc_id", "text", 5, 0.8, limit).collect()
        assert {max(names[e.u], names[e.v]) for e in edges} == {k for k, v in want.items() if k != v}


def test_long_texts_ties_and_clashing_columns(spark):
    long = " ".join(f"w{k % 5000}" for k in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, long.upper()), (4, "a b c"), (4, "a b c"), (5, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS fp", "3 AS component", "4 AS digest", "5 AS root")
    got = {(r.id, r.component) for r in simhash.near_duplicates(df).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4)} <= got
    assert simhash.fingerprint(long) == simhash.fingerprint(long.upper()) == brute_fingerprint(long)
    # two shingles that differ in a bit set it in half of the hashes: 0
    assert simhash.fingerprint("a b c d") == brute_fingerprint("a b c d") == simhash.fingerprint("a b c") & simhash.fingerprint("b c d")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {1, 4}
