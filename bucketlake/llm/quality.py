"""Quality classifier: attention-based multiple-instance learning (Ilse, Tomczak
and Welling, "Attention-based Deep Multiple Instance Learning").

A document is a bag of passages of ``PASSAGE_WORDS`` words; words of more than
``WORD_BYTES`` bytes, as in texts without spaces, count as several. Every passage of
the whole text is encoded: shares of character-class pairs, and how words look and
repeat. A layer embeds the passages; gated attention, tanh(V h) * sigmoid(U h),
weighs them; the weighted representation gives the score. All weights are learnt
together from document labels, in numpy, on a bounded sample of labelled rows:
``per_class`` documents of each label, of at most ``max_bag`` passages each, and
``max_passages`` passages in all, whole documents in hash order. Scoring streams over
the documents; a text of more than ``BLOCK_BYTES`` is encoded in blocks, over which the
attention's weighted mean is carried on, so memory doesn't grow with its length beyond
the text itself.

Defined results
  null, empty text   one passage of zeros, scored like any other
  very long texts    whole, block by block
  ties               equal texts get equal scores; a mean label of one half counts as 1
  no labels, or one  the score is the share of label 1 (0.5 without labels)
  repeated rows      each is scored; repeated labels are averaged
  empty table        empty result
  extra columns      pass through; a column named like the score is replaced
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, text_or_empty, with_columns
from .training import labelled_sample, prior

PASSAGE_WORDS = 48
PER_CLASS = 1500
MAX_PASSAGES = 120_000
MAX_BAG = 2_000
WORD_BYTES = 256
#: A multiple of ``WORD_BYTES``, so that blocks cut long words where passages do.
BLOCK_BYTES = 1 << 20
HIDDEN = 32
ATTENTION = 16
_CLASSES = 13
_SHAPES = 6
FEATURES = _CLASSES * _CLASSES + _SHAPES
_PASSAGES_AT_ONCE = 8192


def _byte_classes() -> np.ndarray:
    """Character class of each byte of UTF-8."""
    table = np.zeros(256, np.uint8)
    groups = [
        b" ", b"\n\r", b"\t\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
        b".,;:", b"!?", b"'\"()-", b"#$%&*@^~+=", b"|<>[]{}/\\_`", bytes(range(128, 256)),
    ]
    for k, group in enumerate(groups, 1):
        table[list(group)] = k
    return table


_TABLE = _byte_classes()


def _encode_block(words: list[bytes]) -> np.ndarray:
    """Features of consecutive passages; the last may be shorter."""
    count = -(-len(words) // PASSAGE_WORDS)
    joined = b" ".join(words) + b" "
    kinds = _TABLE[np.frombuffer(joined, np.uint8)].astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    sizes = np.diff(np.concatenate([[0], ends[PASSAGE_WORDS - 1 :: PASSAGE_WORDS], ends[-1:]]))[:count]
    owner = np.repeat(np.arange(count), sizes)
    pairs = kinds[:-1] * _CLASSES + kinds[1:]
    grid = np.bincount(owner[:-1] * _CLASSES**2 + pairs, minlength=count * _CLASSES**2).reshape(count, -1).astype(np.float32)
    grid /= np.maximum(grid.sum(axis=1, keepdims=True), 1)
    shapes = np.zeros((count, _SHAPES), np.float32)
    for k in range(count):
        part = words[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS]
        n = len(part)
        lengths = [len(w) for w in part]
        shapes[k] = (
            len(set(part)) / n,
            sum(a == b for a, b in zip(part, part[1:], strict=False)) / n,
            sum(lengths) / n / 10,
            max(lengths) / 40,
            sum(w.isupper() for w in part) / n,
            n / PASSAGE_WORDS,
        )
    return np.concatenate([np.sqrt(grid), shapes], axis=1)


def _words(utf8: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a block at a time; words don't depend on where blocks end."""
    at = 0
    while at < len(utf8):
        end = at + BLOCK_BYTES
        if end < len(utf8):
            space = utf8.rfind(b" ", at, end)
            end = space + 1 if space >= 0 else end
        words = [w for w in utf8[at:end].split(b" ") if w]
        if any(len(w) > WORD_BYTES for w in words):
            words = [w[k : k + WORD_BYTES] for w in words for k in range(0, len(w), WORD_BYTES)]
        yield words
        at = end


def passage_blocks(utf8: bytes) -> Iterator[np.ndarray]:
    """Rows of features, one for each passage of the whole text, a block at a time."""
    held, found = [], False
    for words in _words(utf8):
        held += words
        if whole := len(held) // PASSAGE_WORDS * PASSAGE_WORDS:
            yield _encode_block(held[:whole])
            held, found = held[whole:], True
    if held:
        yield _encode_block(held)
    elif not found:
        yield np.zeros((1, FEATURES), np.float32)


def passages(text: str | bytes | None) -> np.ndarray:
    """One row of features for each passage of the whole text."""
    return np.concatenate(list(passage_blocks(text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace"))))


def _utf8(text: pa.Scalar) -> bytes:
    held = text.as_buffer()
    return held.to_pybytes() if held is not None else b""


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights, and what is needed to standardise the features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray] | None, constant: float = 0.5):
        self.mean, self.scale, self.weights, self.constant = mean, scale, weights, constant

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bags), self.constant)
        x = np.clip((np.concatenate(bags) - self.mean) * self.scale, -8, 8)
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        return forward(self.weights, x, starts)["p"].astype(float)

    def score_blocks(self, blocks: Iterator[np.ndarray]) -> float:
        """The score of one document whose passages come in blocks."""
        if self.weights is None:
            return self.constant
        w, top, total, z = self.weights, -np.inf, 0.0, np.zeros(HIDDEN)
        for block in blocks:
            h, _, _, e = attention(w, np.clip((block - self.mean) * self.scale, -8, 8))
            now = max(top, float(e.max()))
            share, before = np.exp(e - now), np.exp(top - now)
            top, total, z = now, total * before + float(share.sum()), z * before + share @ h
        return float(_sigmoid(z / total @ w["c"] + w["d"][0]))

    def score_texts(self, texts: list[bytes]) -> list[float]:
        """Short texts together, a bounded number of passages at a time, long ones alone."""
        out, bags, at, held = [0.0] * len(texts), [], [], 0
        for i, text in enumerate(texts):
            if len(text) > BLOCK_BYTES:
                out[i] = self.score_blocks(passage_blocks(text))
                continue
            bags.append(passages(text))
            at.append(i)
            held += len(bags[-1])
            if held >= _PASSAGES_AT_ONCE:
                for k, p in zip(at, self.scores(bags).tolist(), strict=True):
                    out[k] = p
                bags, at, held = [], [], 0
        if bags:
            for k, p in zip(at, self.scores(bags).tolist(), strict=True):
                out[k] = p
        return out


def attention(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Embedding, the two factors of the gate, and the logarithm of the weight."""
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    return h, t, g, (t * g) @ w["w"]


def forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.append(starts, len(x)))
    h, t, g, e = attention(w, x)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(h * a[:, None], starts)
    return {"sizes": sizes, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"][0])}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss."""
    f = forward(w, x, starts)
    d_out = (f["p"] - y) * weight / weight.sum()
    d_z = np.repeat(np.outer(d_out, w["c"]), f["sizes"], axis=0)
    d_a = (d_z * f["h"]).sum(axis=1)
    mean = np.repeat(np.add.reduceat(d_a * f["a"], starts), f["sizes"])
    d_e = f["a"] * (d_a - mean)
    d_t = np.outer(d_e, w["w"]) * f["g"] * (1 - f["t"] ** 2)
    d_g = np.outer(d_e, w["w"]) * f["t"] * f["g"] * (1 - f["g"])
    d_h = (d_z * f["a"][:, None] + d_t @ w["V"].T + d_g @ w["U"].T) * (1 - f["h"] ** 2)
    return {
        "W": x.T @ d_h, "b": d_h.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g,
        "w": (f["t"] * f["g"]).T @ d_e, "c": f["z"].T @ d_out, "d": np.array([d_out.sum()]),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, share: float | None = None, *, epochs: int = 24, batch: int = 64, rate: float = 3e-3, decay: float = 1e-5, seed: int = 5) -> Model:
    """Adam on the log loss. ``share`` is the share of label 1 among all labelled
    rows; the sample, which is drawn by class, is weighted back to it."""
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), 1 / np.maximum(every.std(axis=0), 0.02)
    rng = np.random.default_rng(seed)
    size = every.shape[1]
    w = {
        "W": rng.normal(0, size**-0.5, (size, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, ATTENTION)),
        "U": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.2, ATTENTION), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    bags = [np.clip((b - mean) * scale, -8, 8).astype(np.float32) for b in bags]
    share = float(labels.mean()) if share is None else share
    balance = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    first, second, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        now = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            starts = np.cumsum([0, *(len(bags[i]) for i in chosen)])[:-1]
            grad = gradients(w, np.concatenate([bags[i] for i in chosen]), starts, labels[chosen], balance[chosen])
            step += 1
            for k, g in grad.items():
                g = g + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = (w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, usable: Column | bool = True, *, label_col: str = "quality", per_class: int = PER_CLASS, max_passages: int = MAX_PASSAGES, max_bag: int = MAX_BAG, text_col: str = "text") -> Model:
    """Learn from labelled rows of ``docs`` for which ``usable`` holds.

    The sample is bounded by ``per_class`` documents a class, and in bytes by
    ``max_bag`` and ``max_passages``; documents of more than ``max_bag`` passages take no
    part in it. Ids that repeat in ``docs`` add their rows. Features, not texts, reach
    the driver.
    """
    usable = F.lit(usable) if isinstance(usable, bool) else usable
    # at most 2 * per_class ids: a proven bound for the broadcast
    wanted = F.broadcast(labelled_sample(labels, label_col, per_class, usable))
    rows = bounded_batches(docs).select(F.col("doc_id").alias("id"), text_or_empty(text_col).alias("text")).join(wanted, "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bag, n = [], 0
                for block in passage_blocks(_utf8(batch.column(2)[i])):
                    bag.append(block.astype("<f2"))
                    n += len(block)
                    if n > max_bag:
                        break
                else:
                    arrays = [batch.column(0).slice(i, 1).cast(pa.int64()), batch.column(1).slice(i, 1), pa.array([np.concatenate(bag).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "y", "x"])

    total, bags, y = 0, [], []
    for row in rows.mapInArrow(run, "id long, y int, x binary").orderBy(F.xxhash64("id"), "id", "x").toLocalIterator():
        bag = np.frombuffer(row.x, "<f2").astype(np.float32).reshape(-1, FEATURES)
        total += len(bag)
        if total > max_passages and len(bags) >= 200:
            break
        bags.append(bag)
        y.append(row.y)
    share = prior(labels, label_col, usable)
    if len(set(y)) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, 0.5 if share is None else float(share))
    return fit(bags, np.array(y, np.float32), share)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with its score (0 to 1, higher: label 1 likelier) as ``out_col``."""
    names = [c for c in docs.columns if c.lower() != out_col.lower()]
    source = bounded_batches(docs).select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out: list[float] = []
        for a in range(0, batch.num_rows, 64):
            out += held.value.score_texts([_utf8(t) for t in batch.column(at).slice(a, 64)])
        return [pa.array(out, pa.float64())]

    return with_columns(source, [T.StructField(out_col, T.DoubleType())], make)
