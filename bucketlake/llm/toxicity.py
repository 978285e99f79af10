"""Toxicity: non-negative positive-unlabelled learning (Kiryo et al.,
"Positive-Unlabeled Learning with Non-Negative Risk Estimator").

Confirmed toxic rows are the positive sample P, a draw from all documents is the
unlabelled sample U; labels of harmless rows are used for the class prior pi only.
The risk of a classifier g is

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])

with the logistic loss l, so that g estimates the log-odds of "toxic". Where the
part for the negatives goes below zero, its gradient is reversed, which keeps the
classifier from fitting the unlabelled sample as negative.

A document's features are the distinct words of its whole text and the first 5 and
7 letters of longer words. Features are chosen on the samples by the same correction: with
p and u the shares of P and U that hold a feature, its share of the negatives is
(u - pi p) / (1 - pi); the ``n_features`` with the largest gap in excess of its
standard error stay; their weights are held at zero or above. ``n_models`` classifiers, each on its own bootstrap of the samples, are averaged.

Bounds: ``per_sample`` documents in P and ``2 * per_sample`` in U, in hash order; of
ids that repeat, one row. Features are counted where the samples lie; the driver gets
the ``n_features`` that are chosen and, for each sampled row, which of them it holds.
Everything else covers all rows: the prior counts all usable labels, scoring reads
every whole text.

Defined results
  null, empty text   scored by the bias alone
  no toxic label     the score is 0 for all rows
  very long texts    whole; the distinct words of one text are held
  ties               of features go to the first in order; a mean label of one half
                     counts as 1
  repeated rows      each is scored; repeated labels are averaged
  empty table        empty result
  extra columns      pass through; a column named like the score is replaced
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, text_or_empty, with_columns
from .training import labelled_sample, prior

STEMS = (5, 7)
PER_SAMPLE = 3000
N_FEATURES = 3000
N_MODELS = 3
MIN_GAP = 3.5
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words ("=word") and stems of longer ones ("stem")."""
    words = set(_WORD.findall((text or "").lower()))
    stems = {w[:n] for n in STEMS for w in words if len(w) > n}
    return {"=" + w for w in words} | stems


class Model:
    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: np.ndarray):
        """``weights`` has a row for each classifier, ``bias`` a value."""
        self.words = {k[1:]: v for k, v in index.items() if k[0] == "="}
        self.stems = {k: v for k, v in index.items() if k[0] != "="}
        self.weights, self.bias = weights, bias

    def rows_of(self, text: str | None) -> list[int]:
        words = set(_WORD.findall((text or "").lower()))
        hits = [self.words[w] for w in words & self.words.keys()]
        stems = {w[:n] for n in STEMS for w in words if len(w) > n}
        return hits + [self.stems[s] for s in stems & self.stems.keys()]

    def score(self, text: str | None) -> float:
        if not len(self.bias):
            return 0.0
        logits = self.bias + self.weights[:, self.rows_of(text)].sum(axis=1)
        return float((1 / (1 + np.exp(-np.clip(logits, -30, 30)))).mean())


def _gap(in_p, in_u, n_p: int, n_u: int, pi: float, root, most):
    """How far a feature's share of P exceeds that of the negatives, in standard
    errors; of numbers, or of columns with their functions."""
    p, u = in_p / n_p, in_u / n_u
    negative = most((u - pi * p) / (1 - pi))
    return (p - negative) / root(p * (1 - p) / n_p + (u * (1 - u) + 1 / n_u) / n_u)


def fit(positive: list[set[str]], unlabelled: list[set[str]], pi: float, *, n_features: int = N_FEATURES, **options) -> Model:
    """As ``train`` does, from features in memory."""
    in_p, in_u = Counter(f for s in positive for f in s), Counter(f for s in unlabelled for f in s)
    gaps = {f: _gap(n, in_u[f], len(positive), len(unlabelled), pi, math.sqrt, lambda x: max(0.0, x)) for f, n in in_p.items() if n >= 2}
    chosen = sorted((-g, f) for f, g in gaps.items() if g > MIN_GAP)[:n_features]
    index = {f: k for k, (_, f) in enumerate(chosen)}
    rows = lambda docs: [sorted(index[f] for f in s if f in index) for s in docs]
    return fit_rows(rows(positive), rows(unlabelled), index, pi, **options)


def fit_rows(positive: list[list[int]], unlabelled: list[list[int]], index: dict[str, int], pi: float, *, n_models: int = N_MODELS, steps: int = 300, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """The classifiers, from the chosen features that each row holds."""

    def dense(docs: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(docs), len(index) + 1), np.float32)
        out[:, -1] = 1  # bias
        for k, d in enumerate(docs):
            out[k, d] = 1
        return out

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    p_all, u_all = dense(positive), dense(unlabelled)
    found = []
    for seed in range(n_models):
        # Whole samples at each step: the risk of the negatives is a difference of
        # two means, too noisy in small batches for its sign to mean anything.
        # Each classifier gets its own bootstrap of both samples.
        rng = np.random.default_rng(seed)
        xp = p_all[rng.integers(0, len(p_all), len(p_all))] if seed else p_all
        xu = u_all[rng.integers(0, len(u_all), len(u_all))] if seed else u_all
        w = np.zeros(len(index) + 1, np.float32)
        w[-1] = np.log(pi / (1 - pi))
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            gp, gu = xp @ w, xu @ w
            # slopes of l(g) = log(1 + exp(-g)) and of l(-g)
            as_positive = pi * (-sigmoid(-gp)) @ xp / len(xp)
            negatives = np.logaddexp(0, gu).mean() - pi * np.logaddexp(0, gp).mean()
            as_negative = sigmoid(gu) @ xu / len(xu) - pi * sigmoid(gp) @ xp / len(xp)
            grad = (as_positive + as_negative if negatives >= 0 else -as_negative) + decay * w
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            now = rate * (1 - (step - 1) / steps)
            w = (w - now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            w[:-1] = np.maximum(w[:-1], 0)  # features were chosen as signs of toxicity
        found.append(w)
    stacked = np.array(found)
    return Model(index, stacked[:, :-1], stacked[:, -1])


def train(docs: DataFrame, labels: DataFrame, usable: Column | bool = True, *, label_col: str = "toxic", per_sample: int = PER_SAMPLE, n_features: int = N_FEATURES, text_col: str = "text", **options) -> Model:
    """Learn from the labelled rows for which ``usable`` holds and from unlabelled
    text. Only chosen features of the bounded samples reach the driver."""
    usable = F.lit(usable) if isinstance(usable, bool) else usable
    none = Model({}, np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    pi = prior(labels, label_col, usable)
    if not pi:
        return none
    pi = min(max(pi, 1e-4), 0.999)
    toxic = labelled_sample(labels, label_col, per_sample, usable).where("y = 1").select("id", F.lit(1).alias("kind"))
    drawn = docs.select(F.col("doc_id").alias("id")).where("id IS NOT NULL").distinct()
    drawn = drawn.orderBy(F.xxhash64("id", F.lit("unlabelled")), "id").limit(2 * per_sample).select("id", F.lit(0).alias("kind"))
    # at most 3 * per_sample ids: a proven bound for the broadcast
    wanted = F.broadcast(toxic.union(drawn))
    rows = bounded_batches(docs).select(F.col("doc_id").alias("id"), text_or_empty(text_col).alias("text")).join(wanted, "id").select("id", "kind", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features(t.as_py())) for t in batch.column(2)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), found], names=["id", "kind", "found"])

    # One row an id, and none that changes when a lost one is made again.
    sampled = rows.mapInArrow(run, "id long, kind int, found array<string>").groupBy("id", "kind").agg(F.min_by("found", F.xxhash64("found")).alias("found"))
    sampled = checkpointed(sampled)
    sizes = {r["kind"]: r["count"] for r in sampled.groupBy("kind").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return none
    counted = sampled.select("kind", F.explode("found").alias("f")).groupBy("f").agg(F.sum("kind").alias("in_p"), F.sum(1 - F.col("kind")).alias("in_u"))
    gap = _gap(F.col("in_p"), F.col("in_u"), sizes[1], sizes[0], pi, F.sqrt, lambda x: F.greatest(F.lit(0.0), x))
    chosen = counted.where("in_p >= 2").withColumn("gap", gap).where(F.col("gap") > MIN_GAP).orderBy(F.desc("gap"), "f").limit(n_features).collect()
    index = {r["f"]: k for k, r in enumerate(chosen)}
    held = docs.sparkSession.sparkContext.broadcast(index)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [sorted(held.value[f] for f in found.as_py() if f in held.value) for found in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32()))], names=["id", "kind", "at"])

    sides: dict[int, list[list[int]]] = {0: [], 1: []}
    for row in sampled.mapInArrow(columns, "id long, kind int, at array<int>").orderBy(F.xxhash64("id"), "id", "kind").collect():  # at most 3 * per_sample
        sides[row["kind"]].append(row["at"])
    return fit_rows(sides[1], sides[0], index, pi, **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with its score (0 to 1, higher: toxic likelier) as ``out_col``."""
    names = [c for c in docs.columns if c.lower() != out_col.lower()]
    source = bounded_batches(docs).select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(source, [T.StructField(out_col, T.DoubleType())], lambda batch: [pa.array([held.value.score(t.as_py()) for t in batch.column(at)], pa.float64())])
