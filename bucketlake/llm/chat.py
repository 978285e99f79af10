"""Chat formatting: a hidden Markov model recovers the role of each part of a
transcript by Viterbi, then turns are rendered canonically.

A row's text is cut where a line opens with a speaker marker ("User:", "### Answer",
"<|assistant|>", ...). Each part is an observation: its marker, its number of words,
its lines, whether it asks, whether it opens the conversation. The states are the
roles. The model's tables are counts over all labelled rows that may be learnt from,
smoothed; without labels, fixed ones that expect user and assistant to alternate. A
row's own role label is never an observation, and callers can hold out conversations,
so that accuracy is measured on rows that the tables have not counted.

Rendering. A turn is "<|role|>", its contents line by line, "<|end|>"; parts with
equal roles that follow each other are one turn. ``rendered`` is a row by itself;
``piece`` is its part of the conversation's transcript: the pieces of a conversation,
in the order of its rows, one after the other, are the transcript, in which turns go on
over rows. So a conversation of any length needs no task that holds it. Where content
has "<|", with any number of backslashes between the two, one more is put there, so
that no content can pose as a turn; ``unescaped`` takes it out again.

Scale. Rows are range-sorted by conversation and turn, so one conversation may lie
in many partitions. Viterbi is a product of matrices in the (max, +) algebra, which
is associative: each partition reduces its part of the conversations that cross its
ends to matrices of roles by roles; the driver, with a row for each partition,
fixes the states at those borders; each partition then decodes on its own, from the
fixed state before it to the fixed state after it. Decoding equals that of the
whole sequence, ties included: they go to the earlier role of ``ROLES``.

Defined results
  null text          one empty part
  very long texts    whole; a partition's part of a conversation is held while it is
                     decoded, nine numbers and the content of each part
  null conv_id       such rows form a conversation
  null turn          comes first in its conversation
  repeated rows      are parts one after the other, ordered by text
  unknown labels     don't count
  ties               equal paths: the earlier role of ``ROLES``
  extra columns      are ignored, whatever their names
  empty table        empty result
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

ROLES = ("system", "user", "assistant")
_SPEAKERS = {
    "system": "system|sys|instruction|instructions|context",
    "user": "user|human|question|q|customer|prompter|you|me|inst",
    "assistant": "assistant|ai|bot|model|answer|a|agent|gpt|response",
}
_MARKER = re.compile(
    r"[ \t]*(?:<\|(?:im_start\|>)?|\[|#{2,4}[ \t]*|\*\*)?[ \t]*(?P<who>" + "|".join(_SPEAKERS.values()) + r")[ \t]*(?P<end>\|>|\]|\*\*:?|:)[ \t]*|[ \t]*#{2,4}[ \t]*(?P<head>" + "|".join(_SPEAKERS.values()) + r")[ \t]*(?=\n|\Z)",
    re.I,
)
_ROLE_OF = {w: r for r, words in _SPEAKERS.items() for w in words.split("|")}
#: Values of each feature: marker, words, lines, question, opening.
SIZES = (4, 12, 4, 2, 2)


def parts_of(text: str | None) -> list[tuple[int, str]]:
    """(marker, content) of each part; marker is 0 or 1 + the role's number."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = _MARKER.match(line)
        if m:
            role = _ROLE_OF[(m["who"] or m["head"]).lower()]
            out.append((1 + ROLES.index(role), [line[m.end() :]]))
        elif out:
            out[-1][1].append(line)
        else:
            out.append((0, [line]))
    return [(k, "\n".join(lines).strip()) for k, lines in out if k or len(out) == 1 or "".join(lines).strip()] or [(0, "")]


def features(marker: int, content: str, opening: bool) -> tuple[int, ...]:
    words = len(content.split())
    return marker, min(words.bit_length(), SIZES[1] - 1), min(content.count("\n"), SIZES[2] - 1), int("?" in content), int(opening)


class Model:
    """Log tables: start[r], step[r, s], emit[feature][r, value]."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start, self.step, self.emit = start, step, emit

    def score(self, f: tuple[int, ...]) -> np.ndarray:
        return sum(self.emit[k][:, v] for k, v in enumerate(f))


def _logs(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    counts = counts + prior
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def model_from(start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]) -> Model:
    """From counts; the priors weigh as a few observations each. How often a role has
    a marker is counted; that a marker names its own role is given."""
    marked = _logs(np.stack([emit[0][:, 0], emit[0][:, 1:].sum(axis=1)], axis=1), np.full((3, 2), 2.0))
    named = np.log(np.where(np.eye(3), 0.998, 0.001))
    markers = np.concatenate([marked[:, :1], marked[:, 1:] + named], axis=1)
    return Model(
        _logs(start, np.array([1.0, 3.0, 0.5])),
        _logs(step, np.array([[0.1, 3, 0.5], [0.1, 0.5, 4], [0.1, 4, 0.5]])),
        [markers, *(_logs(c, np.full((3, n), 2.0)) for c, n in zip(emit[1:], SIZES[1:], strict=True))],
    )


DEFAULT = model_from(np.zeros(3), np.zeros((3, 3)), [np.zeros((3, n)) for n in SIZES])


def _sorted(rows: DataFrame, partitions: int | None, learnt: Column) -> DataFrame:
    """(conv_id, turn, text, role) in range order, checkpointed: its partitions and
    their order are fixed from here on. Roles that may not be learnt from are null."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shaped = rows.select("conv_id", "turn", F.col("text").cast("string").alias("text"), F.when(learnt, F.col("role")).cast("string").alias("role"))
    order = ["conv_id", "turn", F.xxhash64("text"), "text", "role"]
    return checkpointed(shaped.repartitionByRange(n, *order[:3]).sortWithinPartitions(*order))


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _borders(ordered: DataFrame) -> list[dict]:
    """First and last conversation and role of each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or (batch.column(0)[0].as_py(), batch.column(3)[0].as_py())
                last = (batch.column(0)[batch.num_rows - 1].as_py(), batch.column(3)[batch.num_rows - 1].as_py())
        if first:
            row = {"part": TaskContext.get().partitionId(), "first": str(first[0]), "first_role": first[1], "last": str(last[0]), "last_role": last[1]}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("first", pa.string()), ("first_role", pa.string()), ("last", pa.string()), ("last_role", pa.string())]))

    return sorted((r.asDict() for r in ordered.mapInArrow(run, "part int, first string, first_role string, last string, last_role string").collect()), key=lambda r: r["part"])


def train(ordered: DataFrame, borders: list[dict]) -> Model:
    """Counts over all rows: the driver gets one row a partition."""
    opens = {b["part"]: not k or borders[k - 1]["last"] != b["first"] for k, b in enumerate(borders)}
    before = {b["part"]: borders[k - 1]["last_role"] if k and borders[k - 1]["last"] == b["first"] else None for k, b in enumerate(borders)}
    shapes = [(3,), (3, 3), *((3, n) for n in SIZES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        counts = [np.zeros(s) for s in shapes]
        current, previous, fresh = None, before.get(part), opens.get(part, True)
        begun = False
        for batch in batches:
            for conv, text, role in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if begun and conv != current:
                    previous, fresh = None, True
                begun, current = True, conv
                if role in ROLES:
                    r = ROLES.index(role)
                    marker, content = parts_of(text)[0]
                    for table, value in zip(counts[2:], features(marker, content, fresh), strict=True):
                        table[r, value] += 1
                    if fresh:
                        counts[0][r] += 1
                    elif previous in ROLES:
                        counts[1][ROLES.index(previous), r] += 1
                previous, fresh = role, False
        flat = np.concatenate([c.ravel() for c in counts]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["counts"])

    total = sum((np.array(r.counts) for r in ordered.mapInArrow(run, "counts array<double>").toLocalIterator()), np.zeros(sum(int(np.prod(s)) for s in shapes)))
    cuts = np.split(total, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    start, step, *emit = (c.reshape(s) for c, s in zip(cuts, shapes, strict=True))
    return model_from(start, step, emit)


def _matrix(model: Model, text: str | None, opening: bool) -> Iterator[tuple[np.ndarray, str]]:
    """The (max, +) matrix and the content of each part of a row. At an opening all
    rows of the matrix are alike: what came before doesn't matter."""
    for k, (marker, content) in enumerate(parts_of(text)):
        fresh = opening and k == 0
        emitted = model.score(features(marker, content, fresh))
        yield (np.tile(model.start + emitted, (3, 1)) if fresh else model.step + emitted[None, :]), content


def _ends(ordered: DataFrame, model: Model, opens: dict[int, bool]) -> dict[int, tuple[np.ndarray, np.ndarray, bool]]:
    """part -> matrix of its first and of its last conversation, and whether those
    are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = product = None
        current, fresh, runs = None, opens.get(part, True), 0
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if runs and conv != current:
                    first = product if first is None else first
                    product, fresh, runs = None, True, runs + 1
                runs, current = runs or 1, conv
                for m, _ in _matrix(model, text, fresh):
                    product = m if product is None else _plus(product, m)
                fresh = False
        if runs:
            flat = [part, float(runs == 1), *(product if first is None else first).ravel(), *product.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["m"])

    return {int(r.m[0]): (np.array(r.m[2:11]).reshape(3, 3), np.array(r.m[11:]).reshape(3, 3), r.m[1] == 1.0) for r in ordered.mapInArrow(run, "m array<double>").collect()}


def _border_states(borders: list[dict], ends: dict) -> tuple[dict[int, int], dict[int, int]]:
    """State before the first row and after the last row of each partition whose
    conversation goes on there, as one best path has it."""
    before, after = {}, {}
    k = 0
    while k < len(borders):
        chain = [k]
        while chain[-1] + 1 < len(borders) and borders[chain[-1] + 1]["first"] == borders[chain[-1]]["last"]:
            nxt = chain[-1] + 1
            chain.append(nxt)
            if not ends[borders[nxt]["part"]][2]:
                break
        if len(chain) > 1:
            matrices = [ends[borders[c]["part"]][1 if i == 0 else 0] for i, c in enumerate(chain)]
            forward = [matrices[0][0]]  # it opens here, so all rows are alike
            for m in matrices[1:]:
                forward.append((forward[-1][:, None] + m).max(axis=0))
            state = int(np.argmax(forward[-1]))
            for i in range(len(chain) - 1, 0, -1):
                state = int(np.argmax(forward[i - 1] + matrices[i][:, state]))
                after[borders[chain[i - 1]]["part"]] = before[borders[chain[i]]["part"]] = state
        k = chain[-1] if len(chain) > 1 else k + 1
    return before, after


def viterbi(matrices: list[np.ndarray], start: int | None, end: int | None) -> list[int]:
    forward = matrices[0][0 if start is None else start]
    back = []
    for m in matrices[1:]:
        through = forward[:, None] + m
        back.append(np.argmax(through, axis=0))
        forward = through.max(axis=0)
    path = [int(np.argmax(forward)) if end is None else end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


_POSE = re.compile(r"<(\\*)\|")
_POSED = re.compile(r"<\\(\\*)\|")


def escaped(content: str) -> str:
    return _POSE.sub(r"<\1\\|", content)


def unescaped(content: str) -> str:
    return _POSED.sub(r"<\1|", content)


def pieces(parts: list[tuple[str, str]], before: str | None, last: bool) -> str:
    """What the parts of a row add to a transcript that is in a turn of ``before``, or in
    none; ``last`` closes it."""
    out = []
    for role, content in parts:
        if role != before:
            out.append(f"<|end|>\n<|{role}|>\n" if before else f"<|{role}|>\n")
        if content:
            out.append(escaped(content) + "\n")
        before = role
    return "".join(out) + ("<|end|>\n" if last else "")


def render(parts: list[tuple[str, str]]) -> str:
    """Canonical turns of a row by itself: equal neighbours are joined."""
    return pieces(parts, None, True)


def format_chats(rows: DataFrame, *, model: Model | None = None, partitions: int | None = None, learnt: Column | bool = True) -> DataFrame:
    """(conv_id, turn, role, n_parts, rendered, piece) of each row of ``rows`` (conv_id,
    turn, text, and role as a label, which may be null). ``role`` is that of the
    row's first part. The model is counted where it is None, from the labels of rows for
    which ``learnt`` holds."""
    learnt = F.lit(learnt) if isinstance(learnt, bool) else learnt
    ordered = _sorted(rows if "role" in rows.columns else rows.withColumn("role", F.lit(None).cast("string")), partitions, learnt)
    borders = _borders(ordered)
    opens = {b["part"]: not k or borders[k - 1]["last"] != b["first"] for k, b in enumerate(borders)}
    goes_on = {b["part"]: k + 1 < len(borders) and borders[k + 1]["first"] == b["last"] for k, b in enumerate(borders)}
    model = model or train(ordered, borders)
    before, after = _border_states(borders, _ends(ordered, model, opens))
    fields = [f"{c} {ordered.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []  # rows of the current conversation: conv, turn, parts
        matrices: list[np.ndarray] = []
        start = before.get(part)

        def flush(end: int | None, more: bool) -> pa.RecordBatch:
            path = iter(viterbi(matrices, start, end))
            out, at = [], ROLES[start] if start is not None else None
            for k, (conv, turn, contents) in enumerate(held):
                roles = [(ROLES[next(path)], c) for c in contents]
                out.append((conv, turn, roles[0][0], len(roles), render(roles), pieces(roles, at, k == len(held) - 1 and not more)))
                at = roles[-1][0]
            columns = list(zip(*out, strict=True))
            kinds = [schema.field(0).type, schema.field(1).type, pa.string(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "role", "n_parts", "rendered", "piece"])

        fresh = opens.get(part, True)
        for batch in batches:
            schema = batch.schema
            for conv, turn, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if held and conv != held[-1][0]:
                    yield flush(None, False)
                    held, matrices, start, fresh = [], [], None, True
                found = list(_matrix(model, text, fresh))
                matrices += [m for m, _ in found]
                held.append((conv, turn, [c for _, c in found]))
                fresh = False
        if held:
            yield flush(after.get(part), goes_on.get(part, False))

    return ordered.mapInArrow(run, ", ".join([*fields, "role string, n_parts int, rendered string, piece string"]))
