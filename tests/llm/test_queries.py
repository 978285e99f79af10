"""The registered queries of the subpackage against oracles and brute force."""

import base64
import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

from bucketlake.llm.queries import ORACLES, QUERIES
from tests.helpers import connect, same

from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


def table(name, sf=SF):
    return pd.read_parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    same(connect(), QUERIES[name](spark, SF), ORACLES[name])


def test_op2(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(zip(*table("documents")[["doc_id", "text"]].T.values, strict=True))
    got = QUERIES["op2_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = whole.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op4(spark):
    fps = {int(i): brute_fingerprint(t) for i, t in table("documents")[["doc_id", "text"]].itertuples(index=False)}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, SF).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_op8_recall(spark):
    e = table("embeddings", SF_MORE)
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = {}
    for r in QUERIES["op8_ann"](spark, SF_MORE).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = [i for _, i in sorted(zip(-s, ids, strict=True)) if i != q][:20]
        hits += len(set(best) & got[q])
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize(("name", "label", "modulus", "held", "least"), [("op1_quality_mil", "quality", 3, 1, 0.95), ("op9_toxicity_nnpu", "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, modulus, held, least):
    truth = dict(zip(*table("labels", SF_MORE)[["doc_id", label]].T.values, strict=True))
    got = QUERIES[name](spark, SF_MORE).collect()
    assert len(got) == len(table("documents", SF_MORE))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > least


def test_op3_op5_op7(spark):
    pages = QUERIES["op3_html_extract"](spark, SF).collect()
    assert len(pages) == len(table("pages")) and all(r.n_chars == len(r.text) > 0 and "<" not in r.text[:1] for r in pages)
    chats = QUERIES["op5_chat_format"](spark, SF).collect()
    roles = {(r.conv_id, r.turn): r.role for r in table("conversations").itertuples()}
    held = [r for r in chats if zlib.crc32(str(r.conv_id).encode()) % 3 == 1]
    assert len(chats) == len(roles) and held and all(r.held_out for r in held) and sum(r.held_out for r in chats) == len(held)
    assert np.mean([roles[r.conv_id, r.turn] == r.role for r in held]) > 0.9
    mix = QUERIES["op7_mixing"](spark, SF).collect()
    assert len(mix) == len(table("documents")) and {r.sampled for r in mix} == {True, False}
