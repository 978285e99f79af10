import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from bucketlake.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, tokens int, p int"


def rows(n=600):
    out = []
    for i in range(n):
        text = " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(5 + i % 60))
        out.append((i, text, ["en", "de", None][i % 3 if i % 7 else 0], "hot" if i % 3 else f"s{i % 5}", 1, 2))
    return out


def test_raking_meets_the_margins():
    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(s, a, t, float(rng.integers(1, 100))) for s, a, t in itertools.product("abc", "xy", range(3))], columns=[*mixing.MARGINS, "tokens"])
    shares = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"x": 0.9, "y": 0.1}, "topic": {0: 0.6, 1: 0.3, 2: 0.1}}
    w = mixing.rake(cells, shares)
    for m, want in shares.items():
        got = pd.Series(w).groupby(cells[m].to_numpy()).sum()
        assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_calibration_meets_the_budget():
    tokens, w = np.array([10.0, 100.0, 50.0, 0.0]), np.array([0.7, 0.2, 0.1, 0.0])
    for budget in (5, 40, 120, 160, 1000):
        p = mixing.calibrate(tokens, w, budget)
        assert p.max() <= 1 and p.min() >= 0
        assert (p * tokens).sum() == pytest.approx(min(budget, 160))


def test_distributed_and_local_paths_agree(spark):
    df = spark.createDataFrame([*rows(), (None, None, None, None, None, None), (9001, "", "en", "hot", 1, 1)], SCHEMA)
    options = {"targets": {"lang": {"en": 0.6, "de": 0.4}}, "rest": 0.1, "fraction": 0.4, "topics": 3, "rounds": 6}
    local = {(r.doc_id, r.source): r for r in mixing.mixture(df, **options).collect()}
    spread = {(r.doc_id, r.source): r for r in mixing.mixture(df, max_cells=1, carry=["doc_id", "source"], **options).collect()}
    assert len(local) == len(spread) == 602
    for k, r in local.items():
        assert r.p == pytest.approx(spread[k].p, abs=1e-6) and r.topic == spread[k].topic and 0 <= r.p <= 1
    expected = sum(r.p * r.tokens for r in local.values())
    assert expected == pytest.approx(0.4 * sum(r.tokens for r in local.values()), rel=1e-6)
    got = mixing.sample(df, **options)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((k[0] for k, r in local.items() if r.sampled), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mixture(df).count() == 0 and mixing.sample(df).count() == 0


def brute_topics(texts, k, rounds=6):
    """Profiles and k-means in exact fractions of whole numbers, row by row."""
    rows = []
    for text in texts:
        counts = Counter(zlib.crc32(w.encode()) % 64 for w in set((text or "").lower().split()))
        rows.append([round(255 * (counts[j] / max(1, sum(counts.values()))) ** 0.5) for j in range(64)])
    x = np.array(rows, float)
    scale = 1 / np.sqrt(np.maximum((x**2).mean(axis=0) - x.mean(axis=0) ** 2, 1))
    z = (x - x.mean(axis=0)) * scale
    signed = lambda b: (h := xxhash.xxh64_intdigest(b, 42)) - (1 << 64 if h >> 63 else 0)
    first = {bytes(r): i for i, r in enumerate(rows)}
    seeds = [z[first[b]] for b in sorted(first, key=lambda b: (signed(b), b))[:512]]
    centres = [seeds[0]]
    while len(centres) < min(k, len(seeds)):
        gaps = [round(min(((a - c) ** 2).sum() for c in centres), 6) for a in seeds]
        centres.append(seeds[gaps.index(max(gaps))])
    centres = np.array(centres)
    for turn in range(rounds + 1):
        nearest = [min(range(len(centres)), key=lambda c: (round(((r - centres[c]) ** 2).sum(), 6), c)) for r in z]
        if turn == rounds:
            return nearest
        for c in set(nearest):
            centres[c] = z[[i for i, n in enumerate(nearest) if n == c]].mean(axis=0)


def brute_mix(rows, topics, lang, rest, flatten, fraction):
    """Raking by dicts until nothing moves, the scale by bisection, draws by the hash."""
    cells = defaultdict(float)
    of = [(s, g, t) for (_, _, g, s), t in zip(rows, topics, strict=True)]
    for (_, text, _, _), c in zip(rows, of, strict=True):
        cells[c] += len((text or "").split())
    want = []
    for m in range(3):
        totals = defaultdict(float)
        for c, n in cells.items():
            totals[c[m]] += n
        totals = {v: n for v, n in totals.items() if n}
        if m == 1:
            named, others = sum(lang[v] for v in totals if v in lang), sum(n for v, n in totals.items() if v not in lang)
            raw = {v: lang[v] if v in lang else rest * named / (1 - rest) * n / others for v, n in totals.items()}
        else:
            raw = {v: n**flatten for v, n in totals.items()}
        want.append({v: r / sum(raw.values()) for v, r in raw.items()})
    w = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(60):
        worst = 0
        for m in range(3):
            have = defaultdict(float)
            for c, x in w.items():
                have[c[m]] += x
            worst = max(worst, *(abs(have[v] - want[m].get(v, 0)) for v in have))
            w = {c: x * (want[m].get(c[m], 0) / have[c[m]] if have[c[m]] else 0) for c, x in w.items()}
        if worst < 1e-9:
            break
    budget = fraction * sum(cells.values())
    low, high = 0.0, 1e12
    for _ in range(300):
        middle = (low + high) / 2
        given = sum(min(cells[c], middle * x) for c, x in w.items())
        low, high = (middle, high) if given < budget else (low, middle)
    p = {c: min(1.0, high * w[c] / n) if n else 1.0 for c, n in cells.items()}
    return [(p[c], (xxhash.xxh64_intdigest(f"11:{i}".encode(), 42) >> 11) / (1 << 53) < p[c]) for (i, _, _, _), c in zip(rows, of, strict=True)]


def test_query_against_brute_force(spark):
    from bucketlake.llm.queries import QUERIES

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    data = [tuple(None if x is None else x for x in r) for r in docs[["doc_id", "text", "lang", "source"]].itertuples(index=False)]
    topics = brute_topics([r[1] for r in data], mixing.TOPICS)
    mix = mixing.DEFAULT_MIX
    want = brute_mix(data, topics, mix["targets"]["lang"], mix["rest"], mix["flatten"], mix["fraction"])
    got = {r.doc_id: r for r in QUERIES["op7_mixing"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(data) and len(set(topics)) > 3
    for (i, text, _, _), t, (p, sampled) in zip(data, topics, want, strict=True):
        assert (got[i].topic, got[i].tokens, got[i].sampled) == (t, len((text or "").split()), sampled) and got[i].p == pytest.approx(p, abs=1e-7)


def test_topics_are_learnt(spark):
    """Texts of three vocabularies, dealt out in two ways."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'xyz'[i % 3]}{k}" for k in rng.integers(0, 60, 40)), "en", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = [{r.doc_id: r.topic for r in mixing.mixture(df.repartition(n), topics=3).collect()} for n in (1, 9)]
    assert found[0] == found[1]
    for k in range(3):
        votes = Counter(t for i, t in found[0].items() if i % 3 == k)
        assert votes.most_common(1)[0][1] >= 95
    assert len({Counter(t for i, t in found[0].items() if i % 3 == k).most_common(1)[0][0] for k in range(3)}) == 3


def test_topic_column_and_margin_report(spark):
    rows = [(i, "a b c", "en" if i % 2 else "de", "s", "news" if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, theme string")
    options = {"targets": {"lang": {"en": 0.9, "de": 0.1}}, "flatten": 1.0}
    mixed = mixing.mixture(df, topic_col="theme", fraction=0.5, **options)
    assert {r.topic for r in mixed.select("topic").distinct().collect()} == {"news", None}
    report = {(r.margin, r.value): r for r in mixing.margin_report(mixed, **options).collect()}
    assert report["lang", "en"].target == pytest.approx(0.9) and report["lang", "en"].expected == pytest.approx(0.9, abs=1e-6)
    whole = mixing.mixture(df, topic_col="theme", fraction=0.9, **options)  # more than the cells have
    report = {(r.margin, r.value): r for r in mixing.margin_report(whole, **options).collect()}
    assert report["lang", "en"].target == pytest.approx(0.9) and report["lang", "en"].expected < 0.6


def test_odd_rows(spark):
    long = "word " * 300_000
    rows = [(1, None, None, None, 1), (1, None, None, None, 1), (2, "", "en", "s", 1), (3, long, "en", "s", 1), (None, "x y", "en", "s", 1), (4, "x y", "en", "s", 1), (4, "x y", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __profile int")
    df = df.withColumn("dotted.name", df["__profile"]).withColumn("__p", df["__profile"]).withColumn("__s", df["__profile"])
    got = mixing.mixture(df, fraction=1.0)
    kept = mixing.sample(df, fraction=1.0)
    assert kept.columns == df.columns
    found = got.collect()
    assert len(found) == 7 and {r.tokens for r in found if r.doc_id == 3} == {300_000}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.sampled)
