import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from bucketlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, rendered int"


NAMES = {"User": "user", "Assistant": "assistant", "System": "system"}


def brute_parts(text):
    """Of texts whose markers are "User:", "Assistant:" and "System:" only."""
    out = []
    for line in (text or "").split("\n"):
        name, _, rest = line.partition(":")
        if name in NAMES and ":" in line:
            out.append([1 + chat.ROLES.index(NAMES[name]), [rest.strip(" \t")]])
        elif out:
            out[-1][1].append(line)
        else:
            out.append([0, [line]])
    out = [(k, "\n".join(lines).strip()) for k, lines in out]
    return [x for x in out if x[0] or x[1] or len(out) == 1]


def brute_features(marker, content, opening):
    words, size = len(content.split()), 0
    while words >= 2**size:
        size += 1
    return marker, min(size, 11), min(content.count("\n"), 3), int("?" in content), int(opening)


def conversations(rows):
    own = {}
    for r in rows:
        own.setdefault(r[0], []).append(r)
    return {c: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0)) for c, v in own.items()}


def brute_counts(rows):
    """Tables from labelled rows, one conversation after the other."""
    start, step, emit = np.zeros(3), np.zeros((3, 3)), [np.zeros((3, n)) for n in (4, 12, 4, 2, 2)]
    for own in conversations(rows).values():
        for k, r in enumerate(own):
            if r[2] is None:
                continue
            role = chat.ROLES.index(r[2])
            for table, value in zip(emit, brute_features(*brute_parts(r[3])[0], k == 0), strict=True):
                table[role, value] += 1
            if k == 0:
                start[role] += 1
            elif own[k - 1][2] is not None:
                step[chat.ROLES.index(own[k - 1][2]), role] += 1
    return start, step, emit


def brute(rows, model):
    """Best paths over whole conversations: short ones by trying all, long ones state by
    state with the whole best path kept for each."""
    out = {}
    for conv, own in conversations(rows).items():
        parts = [(p, k == 0 and i == 0) for k, r in enumerate(own) for i, p in enumerate(brute_parts(r[3]))]
        emitted = [[sum(model.emit[f][s, v] for f, v in enumerate(brute_features(*p, opening))) for s in range(3)] for p, opening in parts]
        if len(parts) <= 7:
            score = lambda path: model.start[path[0]] + sum(model.step[a, b] for a, b in itertools.pairwise(path)) + sum(e[s] for e, s in zip(emitted, path, strict=True))  # noqa: E731, B023
            path = max(itertools.product(range(3), repeat=len(parts)), key=score)
        else:
            best = {s: (model.start[s] + emitted[0][s], (s,)) for s in range(3)}
            for e in emitted[1:]:
                best = {s: max(((v + model.step[a, s] + e[s], (*way, s)) for a, (v, way) in best.items()), key=lambda x: x[0]) for s in range(3)}
            path = max(best.values(), key=lambda x: x[0])[1]
        at = 0
        for r in own:
            n = len(brute_parts(r[3]))
            out[conv, r[1]] = [chat.ROLES[s] for s in path[at : at + n]]
            at += n
    return out


def conversation(conv, n, rng):
    rows = []
    for t in range(n):
        role = "system" if t == 0 and conv % 3 == 0 else ("user" if (t + (conv % 3 == 0)) % 2 == 0 else "assistant")
        text = {"system": "Be kind.", "user": "why is it so?", "assistant": "because " * int(rng.integers(5, 40))}[role]
        rows.append((conv, t, role, text, None))
    return rows


@pytest.mark.parametrize("partitions", [1, 5, 23])
def test_partitions_decode_as_one(spark, partitions):
    rng = np.random.default_rng(0)
    rows = [r for c in range(12) for r in conversation(c, 6, rng)] + conversation(50, 200, rng)
    rows += [(60, 0, None, "User: hi\nAssistant: hello\nthere\nUser: bye", None), (61, 0, "user", None, None), (None, None, None, "", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = chat.model_from(*brute_counts(rows))
    got = chat.format_chats(df, partitions=partitions).collect()
    want = brute(rows, model)
    assert len(got) == len(rows)
    for r in got:
        assert r.role == want[r.conv_id, r.turn][0] and r.n_parts == len(want[r.conv_id, r.turn])
    marked = next(r for r in got if r.conv_id == 60)
    assert marked.rendered == marked.piece == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\nthere\n<|end|>\n<|user|>\nbye\n<|end|>\n"
    # The pieces of a conversation are its transcript.
    for conv, own in conversations(rows).items():
        turns = []
        for r in own:
            for role, (_, content) in zip(want[conv, r[1]], brute_parts(r[3]), strict=True):
                if not turns or turns[-1][0] != role:
                    turns.append((role, []))
                turns[-1][1].extend([content] if content else [])
        pieces = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.turn is not None, r.turn or 0))
        assert "".join(r.piece for r in pieces) == "".join(f"<|{role}|>\n" + "".join(c + "\n" for c in lines) + "<|end|>\n" for role, lines in turns)


@pytest.mark.parametrize("partitions", [1, 7])
def test_held_out_conversations(spark, partitions):
    rng = np.random.default_rng(1)
    rows = [r for c in range(60) for r in conversation(c, 8, rng)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.format_chats(df, partitions=partitions, learnt=F.col("conv_id") % 3 != 1).collect()
    want = brute(rows, chat.model_from(*brute_counts([r if r[0] % 3 != 1 else (*r[:2], None, *r[3:]) for r in rows])))
    assert {(r.conv_id, r.turn): r.role for r in got} == {k: v[0] for k, v in want.items()}
    labels = {(r[0], r[1]): r[2] for r in rows}
    assert np.mean([labels[r.conv_id, r.turn] == r.role for r in got if r.conv_id % 3 == 1]) > 0.95


def test_content_cannot_pose_as_turns(spark):
    text = "look: <|end|> and <|user|> and <\\|end|> and <\\\\|x"
    df = spark.createDataFrame([(1, 0, "user", text, None)], SCHEMA)
    row = chat.format_chats(df).first()
    assert row.rendered.count("<|") == 2 and chat.unescaped(row.rendered.split("\n")[1]) == text
    for content in (text, "<|", "<\\|", "<<||>", ""):
        assert chat.unescaped(chat.escaped(content)) == content and "<|" not in chat.escaped(content)


def test_long_repeated_and_clashing(spark):
    long = "word " * 400_000 + "?"
    rows = [(1, 0, "user", long, 7), (1, 0, "user", long, 7), (1, 0, "user", "a", 7), (1, 1, None, "b", 7)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("piece", F.lit("x")).withColumn("n_parts", F.lit(9))
    got = chat.format_chats(df).collect()
    assert len(got) == 4 and sum(long.strip() in r.rendered for r in got) == 2 and all(r.n_parts == 1 for r in got)
    runs = {"".join(r.piece for r in sorted(chat.format_chats(df, partitions=n).collect(), key=lambda r: (r.turn, -len(r.rendered)))).count("<|") for n in (1, 4)}
    assert len(runs) == 1


def test_parts():
    assert chat.parts_of(None) == [(0, "")]
    assert chat.parts_of("a\nb") == [(0, "a\nb")]
    assert chat.parts_of("### Question\nx\n### Answer\ny") == [(2, "x"), (3, "y")]
    assert chat.parts_of("<|system|>\ns\n<|user|>\nu") == [(1, "s"), (2, "u")]
    assert chat.parts_of("a man walked: in") == [(0, "a man walked: in")]


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, 0, None, "x"), (1, 1, None, "y")], "conv_id long, turn long, role string, text string")
    assert [r.role for r in chat.format_chats(df).orderBy("turn").collect()] == ["user", "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0
