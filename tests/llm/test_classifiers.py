import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketlake.llm import quality, toxicity
from bucketlake.llm.training import labelled_sample, remainder

WORDS = "river stone meadow winter harbour letter candle morning garden window".split()


def clean(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {
        "W": rng.normal(size=(7, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)),
        "w": rng.normal(size=3), "c": rng.normal(size=4), "d": rng.normal(size=1),
    }
    x, starts, y, weight = rng.normal(size=(9, 7)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = quality.forward(w, x, starts)["p"]
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())

    grad = quality.gradients(w, x, starts, y, weight)
    for k, v in w.items():
        for at in np.ndindex(v.shape):
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert grad[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_passages_cover_the_whole_text():
    for n in (1, 47, 48, 49, 500):
        assert len(quality.passages("word " * n)) == -(-n // quality.PASSAGE_WORDS)
    assert quality.passages(None).shape == quality.passages("").shape == (1, quality.FEATURES)
    head = "word " * quality.PASSAGE_WORDS * 3
    assert not np.array_equal(quality.passages(head + "AAA !!!")[-1], quality.passages(head + "bbb ccc")[-1])


def test_quality_finds_a_bad_passage(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = clean(rng, rng.randint(20, 300))
        if bad:
            cut = rng.randint(0, len(text))
            text = text[:cut] + " " + " ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=40)) + " " + text[cut:]
        rows.append((i, text, 0.5))
        labels.append((i, int(not bad)))
    rows += [(None, None, None), (999, "", None), (5, rows[5][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE double")
    table = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 0), (8, 1)], "doc_id long, quality int")
    model = quality.train(docs, table, remainder("doc_id", 3) != 1)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id != 8]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rude = [f"grobian{x}" for x in ("a", "o", "er", "em", "st", "us", "ix", "il")]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
        if i % 5 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(rude))
        rows.append((i, " ".join(words), "x"))
        if i % 2 == 0:
            labels.append((i, int(i % 5 == 0)))
    rows += [(None, None, None), (999, "", None), (5, rows[5][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, table, remainder("doc_id", 5) != 0)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held]) > 0.95


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    empty = docs.limit(0)
    some = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(empty, quality.train(empty, some)).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, some)).count() == 0


def test_remainder_and_sample(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.m for r in df.withColumn("m", remainder("doc_id", 3)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}
    labels = df.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    assert labelled_sample(labels, "quality", 10, F.lit(True)).count() == 20


def test_rare_words_are_features():
    words = [f"grobian{x}" for x in "abcdefg"]
    positive = [{"=river", "=" + words[i % 7]} for i in range(91)]
    unlabelled = [{"=river", "=" + WORDS[i % 10]} for i in range(300)]
    model = toxicity.fit(positive, unlabelled, 0.05)
    assert set(model.words) == set(words) and all(model.score(w) > 0.5 > model.score("river stone") for w in words)


def test_features_are_chosen_alike_where_they_lie(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS + ["grobian", "grobianer", "lump"] * (i % 4 == 0)) for _ in range(30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    far = toxicity.train(docs, table)
    positive = [toxicity.features(t) for i, t in rows if i % 4 == 0]
    near = toxicity.fit(positive, [toxicity.features(t) for _, t in rows], 0.5)
    assert far.words.keys() == near.words.keys() >= {"grobian", "lump"} and far.stems.keys() == near.stems.keys()
    assert toxicity.train(docs, table, n_features=1).weights.shape[1] == 1


def test_blocks_of_long_texts():
    """Passages, and scores, don't depend on where blocks end; memory does not grow with
    texts without spaces."""
    import tracemalloc

    rng = np.random.default_rng(0)
    w = {k: rng.normal(size=s).astype(np.float32) * 0.3 for k, s in {"W": (quality.FEATURES, 32), "b": 32, "V": (32, 16), "U": (32, 16), "w": 16, "c": 32, "d": 1}.items()}
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), w)
    text = ("Some words, and MORE of them. " * 9 + "x" * 1000 + " ").encode() * 2500
    whole = quality.passages(text)
    assert len(whole) == -(-(9 * 6 + 4) * 2500 // quality.PASSAGE_WORDS)
    assert model.score_texts([text, b"", text[:500]]) == pytest.approx([*model.scores([whole]), *model.scores([quality.passages(b"")]), *model.scores([quality.passages(text[:500])])], rel=1e-4)
    for long in ("\u4e2d\u6587".encode() * 8_000_000, b"x;" * 25_000_000, b"a b " * 12_500_000):
        tracemalloc.start()
        assert 0 <= model.score_texts([long])[0] <= 1
        assert tracemalloc.get_traced_memory()[1] < 150 << 20  # beside the text
        tracemalloc.stop()


def test_documents_over_the_bound_of_the_sample(spark):
    rng = random.Random(1)
    rows = [(i, (clean(rng, 60) if i % 2 else "AAA!!! " * 60)) for i in range(60)] + [(100, "word " * 48 * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 0)], "doc_id long, quality int")
    model = quality.train(docs, table, max_bag=30)
    assert model.weights is not None
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 61 and got[1] > 0.5 > got[2]


def test_toxicity_of_long_repeated_and_clashing_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS + ["grobian"] * (3 * (i % 4 == 0))) for _ in range(60))) for i in range(200)]
    long = clean(rng, 300_000)
    extra = [(900, long), (901, long + " grobian"), (901, long + " grobian"), (902, None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS kind", "3 AS found", "4 AS SCORE")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "id", "kind", "found", "score"]
    got = [(r.doc_id, r.score) for r in scored.collect() if r.doc_id >= 900]
    assert len(got) == 4 and all((s > 0.5) == (i == 901) for i, s in got) and len({s for i, s in got if i == 901}) == 1
