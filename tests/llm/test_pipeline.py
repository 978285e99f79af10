import base64
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from bucketlake.llm import mixing, quality
from bucketlake.llm.queries import QUERIES
from bucketlake.llm.training import remainder

from .test_mixing import brute_mix, brute_topics

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, score double, tag string, `__tag` int, topic int, ids int, `dotted.name` string"
STAGES = dict(corpus_pipeline.STAGES)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), 1, 0.5, "t", 2, 3, 4, "d")


def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_exact(docs):
    best = {}
    for d in docs:
        norm = re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")
        best[norm] = min(best.get(norm, d), d, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
    return [d for d in docs if d in best.values()]


def brute_near(docs):
    """All pairs of sets of five-word shingles, linked at 0.8; the smallest id stays."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = {d[0]: shingles(d[1]) for d in docs}, {d[0]: d[0] for d in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [d for d in docs if find(d[0]) == d[0]]


def test_against_brute_force(spark):
    """Each stage on its own input, and run() as all of them."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()]
    model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"), remainder("doc_id", 3) != 1)
    docs = [d for d in docs if model.scores([quality.passages(d[1])])[0] >= 0.5]
    docs = brute_near(brute_exact(docs))
    mix = mixing.DEFAULT_MIX
    drawn = brute_mix(docs, brute_topics([d[1] for d in docs], mixing.TOPICS), mix["targets"]["lang"], mix["rest"], mix["flatten"], mix["fraction"])
    encoding = coder()
    want = {d[0]: encoding.encode_ordinary(d[1] or "") for d, (_, kept) in zip(docs, drawn, strict=True) if kept}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and len(want) > 30
    for i, ids in want.items():
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids) and got[i].restored


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
        if name != "byte_bpe":
            assert docs.columns == columns
    assert docs.where("NOT restored").count() == 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows, columns that clash."""
    story = " ".join(f"word{(k * k + 7 * k) % 997}" for k in range(400))
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [row(1, story), row(1, story), row(2, story + " "), row(3, story.replace("word10 ", "other ", 1)), row(4, None), row(5, ""), row(6, " \n"), row(None, "lone text here"), row(None, "lone text here")]
    rows += [row(7, long), row(8, long + " end"), row(9, "a"), row(10, "a"), (11, None, None, None, None, None, None, None, None, None, None, None), row(12, "x" * 300_000, None, None)]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows(spark, odd, name):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = STAGES[name](spark, docs, odd)
    rows = out.collect()
    assert out.columns == docs.columns if name != "byte_bpe" else all(r.restored for r in rows)
    found = sorted((r.doc_id for r in rows), key=lambda x: (x is None, x or 0))
    if name == "exact_dedup":
        # 6 is the longest of the blank texts; 2 is the longest of the equal stories
        assert found == [2, 3, 6, 7, 8, 9, 12, None]
    if name == "near_dedup":
        # a null id is no component's id: its copies have no smaller one, one stays
        assert found == [1, 4, 7, 9, 12, None]
    if name == "mixing":
        assert sum(r.doc_id == 1 for r in rows) in (0, 2)
    if name == "byte_bpe":
        texts = {r.doc_id: r.text for r in docs.collect()}
        encoding = coder()
        assert len(rows) == 15 and all(np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(texts[r.doc_id] or "") for r in rows if r.doc_id != 12)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, odd, name):
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA), odd).count() == 0


def test_run_on_odd_and_on_no_rows(spark, odd, tmp_path):
    out = corpus_pipeline.run(spark, odd).collect()
    assert all(r.restored for r in out)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert all(name.split("_")[0][2:].isdigit() for name in QUERIES)
