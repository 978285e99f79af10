import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from bucketlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
WHOLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.Encoder(public_tokenizers.PATTERN, bpe.load_ranks(PATH))
DECODER = bpe.Decoder(bpe.load_ranks(PATH))


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", "'s", "'t", " ", "  ", "\n", "\t", "123", "é", "中", "!!", " ", "՘", "\U00012685", "<|endoftext|>"]), max_size=120))
def test_chunks_match_the_library(parts):
    text = "".join(parts)
    for chunk, overlap in ((1 << 16, 512), (16, 8), (7, 3), (5, 1)):
        got = CODER.encode(text, chunk, overlap)
        assert ids(got) == WHOLE.encode_ordinary(text)
        assert DECODER.decode(got) == text.encode()


def long_texts():
    rng = random.Random(3)
    words = ["the", "Straße", "naïve", "x" * 40, "42", "...", "\n\n", "  ", "it's", "中文"]
    return [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 400, 2000)] + ["a" * 5000, " " * 3000 + "b" + " " * 700, "\n" * 900, "1" * 1200 + "z" * 1300]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (256, 64), (1000, 20)])
def test_long_rows_are_stitched_across_tasks(spark, chunk, overlap):
    texts = [None, "", *long_texts()]
    df = spark.createDataFrame([(i, t, "e", i if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, ids string, __row long")
    vocabulary = bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    rows = bpe.decode(bpe.encode(df, vocabulary, chunk=chunk, overlap=overlap), vocabulary).collect()
    assert len(rows) == len(texts)
    both = bpe.encode(df, vocabulary, decoded_col="decoded", chunk=chunk, overlap=overlap)
    assert both.columns == ["doc_id", "__row", "ids", "decoded"]
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in both.collect()) == sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert ids(r.ids) == WHOLE.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        assert r["__row"] == (r.doc_id if r.doc_id % 2 else None)


def test_unknown_id():
    with pytest.raises(ValueError, match="50256"):
        DECODER.decode(np.array([50256], "<u4").tobytes())


def test_empty(spark):
    vocabulary = bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, vocabulary), vocabulary).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    vocabulary = bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    long = "words and " * 40_000
    rows = [(1, "same text"), (1, "same text"), (2, "same text"), (None, long), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS `__text`", "'x' AS `IDS`", "'y' AS `decoded`", "3 AS `__chunk`", "4 AS `__row`", "5 AS k0", "6 AS `a.b`")
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    assert [c for c in got.columns if c.lower() not in ("ids", "decoded")] == ["doc_id", "__text", "__chunk", "__row", "k0", "a.b"]
    found = got.collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "None", "None"] and all(r["__text"] == 7 for r in found)
    for r in found:
        text = long if r.doc_id is None else "same text"
        assert ids(r.ids) == WHOLE.encode_ordinary(text) and bytes(r.decoded).decode() == text


def test_chunks_of_a_text_are_encoded_apart(spark):
    """Only rows whose chunks don't meet go through one task."""
    text = " ".join(f"word{k}" for k in range(4000))
    df = spark.createDataFrame([(1, text), (2, "a" * 9000), (3, text + "!" * 3000 + text)], "doc_id long, text string")
    vocabulary = bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    for only, plans in (("doc_id = 1", 0), ("doc_id > 1", 1)):
        out = bpe.encode(df.where(only), vocabulary, chunk=1000, overlap=50)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow stitch(") == plans
        for r in out.collect():
            assert ids(r.ids) == WHOLE.encode_ordinary({1: text, 2: "a" * 9000, 3: text + "!" * 3000 + text}[r.doc_id])
    with pytest.raises(ValueError):
        bpe.encode(df, vocabulary, chunk=10, overlap=10)
