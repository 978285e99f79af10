"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking scales the weights of
the cells in turn until the weighted token shares of the sources, of the languages
and of the topics equal their targets. Each document is then kept with the
probability of its cell, calibrated so that no probability exceeds 1 and the
expected tokens reach the budget or, where a target asks for more than a cell
has, come as near as whole documents allow. A draw is a hash of the id, so it is
the same in every run and on every machine.

Targets. ``{value: weight}`` for each margin; values without a target get none of
the mix if ``rest`` is zero, else share ``rest`` in proportion to their tokens. A
margin whose target is None gets ``flatten``: shares proportional to tokens to the
power ``flatten`` (1 keeps them, 0 makes them equal).

Scale. The cells are an aggregate of the documents. Where there are at most
``max_cells`` in ``CELL_BYTES``, a checked bound, they are raked in numpy and their
probabilities broadcast; beyond it the same steps, with the same end, run as
aggregates and joins over the cell table, which stays distributed. Raking ends when
all margins are met to ``TOLERANCE`` or after ``rounds``; ``margin_report`` tells, by
value of a margin, the share that was asked for and the one that is expected.

Topic. Topics are learnt from the texts: ``topics`` clusters (k-means) of all
documents by their profiles, the shares of their distinct words in ``DIMS`` hash
classes, standardised over all documents. Every round of the clustering is one
aggregate over all profiles. Profiles are whole numbers, so sums, and with them the
clusters, don't depend on how rows are dealt out. Only the ``SEED_ROWS`` profiles that
the first centres are chosen from (farthest first) are a bounded sample, in hash order
of profiles. ``topic_col`` takes a column instead.

Defined results
  null source, lang   are a value of their own
  null, empty text    no tokens, the profile of zeros; kept if its cell's probability
                      is 1, else drawn
  very long texts     whole; one is held with its distinct words
  ties                go to the topic with the smaller number
  repeated rows       share a draw: all stay or all go
  null id             draws as the id ''
  extra columns       pass through; those named like a result are replaced by it
  empty table         empty result
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, fresh_name, with_columns

TOPICS = 8
DIMS = 64
TOPIC_ROUNDS = 6
SEED_ROWS = 512
MAX_CELLS = 200_000
CELL_BYTES = 32 << 20
ROUNDS = 60
TOLERANCE = 1e-9
MARGINS = ("source", "lang", "topic")
#: The mix of the registered query and of the pipeline: languages by given weights,
#: others together a tenth; sources and topics flattened to the square root.
DEFAULT_MIX = {"targets": {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}}, "rest": 0.1, "flatten": 0.5, "fraction": 0.5}


def profile(text: str | None) -> tuple[np.ndarray, int]:
    """255 times the root of the share of the distinct words in each hash class, and
    the number of words."""
    words = (text or "").lower().split()
    classes = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in set(words)], np.int64) % DIMS
    counts = np.bincount(classes, minlength=DIMS)
    return np.rint(255 * np.sqrt(counts / max(1, len(classes)))).astype(np.uint8), len(words)


class Topics:
    """Standardised centres."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, centres: np.ndarray):
        self.mean, self.scale, self.centres = mean, scale, centres

    def of(self, profiles: np.ndarray) -> np.ndarray:
        """The nearest centre of each row; distances are rounded, so that equal ones
        stay equal however many rows are taken at once."""
        x = (profiles - self.mean) * self.scale
        far = ((x[:, None, :] - self.centres[None, :, :]) ** 2).sum(axis=2)
        return np.argmin(np.round(far, 6), axis=1)


def _sums(profiles: DataFrame, key_of: Callable[[np.ndarray], np.ndarray], squares: bool) -> dict[int, np.ndarray]:
    """key -> (rows, sums by class, with ``squares`` sums of squares): at most as many
    rows as keys times classes reach the driver."""
    width = 1 + DIMS * (2 if squares else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, DIMS)
            for at in range(0, len(x), 2048):
                part = x[at : at + 2048].astype(np.int64)
                wide = np.concatenate([np.ones((len(part), 1), np.int64), part, *([part**2] if squares else [])], axis=1)
                keys = key_of(part)
                for k in np.unique(keys):
                    total[int(k)] = total.get(int(k), 0) + wide[keys == k].sum(axis=0)
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(v, pa.int64())], names=["key", "at", "v"])

    out: dict[int, np.ndarray] = {}
    for r in profiles.mapInArrow(run, "key int, at int, v long").groupBy("key", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["key"], np.zeros(width, np.int64))[r["at"]] = r["v"]
    return out


def learn_topics(profiles: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> Topics:
    """k-means over ``profiles`` (profile), which should be a checkpoint."""
    whole = _sums(profiles, lambda x: np.zeros(len(x), int), squares=True).get(0)
    if whole is None:
        return Topics(np.zeros(DIMS), np.ones(DIMS), np.zeros((1, DIMS)))
    n, sums, squares = int(whole[0]), whole[1 : DIMS + 1], whole[DIMS + 1 :]
    mean = sums / n
    scale = 1 / np.sqrt(np.maximum(squares / n - mean**2, 1.0))
    drawn = profiles.groupBy("profile").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("profile"), "profile").limit(SEED_ROWS).collect()
    seeds = (np.array([np.frombuffer(r["profile"], np.uint8) for r in drawn]) - mean) * scale
    chosen = [0]
    near = ((seeds - seeds[0]) ** 2).sum(axis=1)
    while len(chosen) < min(topics, len(seeds)):
        chosen.append(int(np.argmax(np.round(near, 6))))
        near = np.minimum(near, ((seeds - seeds[chosen[-1]]) ** 2).sum(axis=1))
    model = Topics(mean, scale, seeds[chosen])
    for _ in range(rounds):
        found = _sums(profiles, model.of, squares=False)
        centres = model.centres.copy()
        for k, v in found.items():
            centres[k] = (v[1:] / v[0] - mean) * scale
        if np.array_equal(centres, model.centres):
            break
        model = Topics(mean, scale, centres)
    return model


def _profiled(docs: DataFrame, text_col: str, name: str, tokens: str) -> DataFrame:
    """``docs`` with profile and number of words."""
    at = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [profile(t.as_py()) for t in batch.column(at)]
        return [pa.array([p.tobytes() for p, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())]

    return with_columns(bounded_batches(docs), [T.StructField(name, T.BinaryType()), T.StructField(tokens, T.LongType())], make)


def _with_topic(rows: DataFrame, name: str, topic: str, model: Topics) -> DataFrame:
    """``rows`` with the topic of the profile ``name``."""
    held, at = rows.sparkSession.sparkContext.broadcast(model), rows.columns.index(name)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        x = np.frombuffer(b"".join(batch.column(at).to_pylist()), np.uint8).reshape(-1, DIMS)
        return [pa.array(held.value.of(x).astype(np.int32) if len(x) else [], pa.int32())]

    return with_columns(rows, [T.StructField(topic, T.IntegerType())], make)


def _topics_of(docs: DataFrame, text_col: str, topic: str, model: Topics) -> DataFrame:
    """``docs`` with the topic of the text, in one pass."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [profile(t.as_py())[0] for t in batch.column(at)]
        return [pa.array(held.value.of(np.stack(found)).astype(np.int32) if found else [], pa.int32())]

    return with_columns(bounded_batches(docs), [T.StructField(topic, T.IntegerType())], make)


def target_shares(totals: dict, target: dict | None, flatten: float, rest: float) -> dict:
    """Shares by value, summing to 1 over the values that have tokens."""
    alive = {k: v for k, v in totals.items() if v > 0}
    if target is None:
        raw = {k: float(v) ** flatten for k, v in alive.items()}
    else:
        named = sum(target.get(k, 0.0) for k in alive)
        others = sum(v for k, v in alive.items() if k not in target)
        raw = {k: target.get(k, rest * named / max(1e-300, 1 - rest) * v / others if others else 0.0) for k, v in alive.items()}
    whole = sum(raw.values())
    return {k: v / whole for k, v in raw.items()} if whole else dict.fromkeys(raw, 0.0)


def rake(cells: pd.DataFrame, shares: dict[str, dict], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weighted tokens of each cell, summing to 1; ``cells`` has the margins and
    ``tokens``."""
    w = cells["tokens"].to_numpy(float)
    w = w / w.sum() if w.sum() else w
    codes = {}
    for m in MARGINS:
        values, index = {}, []
        for v in cells[m].astype(object).where(cells[m].notna(), None):
            index.append(values.setdefault(v, len(values)))
        codes[m] = np.array(index, int), np.array([shares[m].get(v, 0.0) for v in values])
    for _ in range(rounds):
        worst = 0.0
        for m in MARGINS:
            index, want = codes[m]
            have = np.bincount(index, w, len(want))
            factor = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            worst = max(worst, float(np.abs(have - want).max(initial=0)))
            w = w * factor[index]
        if worst < tolerance:
            break
    return w


def rake_distributed(cells: DataFrame, shares: dict[str, DataFrame], rounds: int, tolerance: float = TOLERANCE, every: int = 3) -> DataFrame:
    """The same steps over a distributed cell table, to the same end; ``shares`` has
    (value, want) of each margin. Adds ``w``."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for k in range(rounds):
        worst = 0.0
        for m in MARGINS:
            have = out.groupBy(F.col(m).alias("__v")).agg(F.sum("w").alias("__have"))
            want = F.coalesce("want", F.lit(0.0))
            factor = checkpointed(
                have.join(shares[m], F.col("__v").eqNullSafe(F.col("value")), "left").select(
                    "__v", F.when(F.col("__have") > 0, want / F.col("__have")).otherwise(0.0).alias("__f"), F.abs(F.col("__have") - want).alias("__off")
                )
            )
            worst = max(worst, factor.agg(F.max("__off")).first()[0] or 0.0)
            out = out.join(factor.drop("__off"), F.col(m).eqNullSafe(F.col("__v"))).withColumn("w", F.col("w") * F.col("__f")).drop("__v", "__f")
        if k % every == every - 1:
            out = checkpointed(out)
        if worst < tolerance:
            break
    return checkpointed(out)


def calibrate(tokens: np.ndarray, w: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, s * w / tokens) whose expected tokens are ``budget``,
    or all that positive weights allow."""
    rate = np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)
    order = np.argsort(-rate, kind="stable")
    full = np.concatenate([[0.0], np.cumsum(tokens[order])])
    left = w.sum() - np.concatenate([[0.0], np.cumsum(w[order])])
    for k in range(len(order) + 1):
        if k == len(order) or rate[order[k]] == 0:
            return (rate > 0).astype(float)
        scale = (budget - full[k]) / left[k] if left[k] > 0 else 0.0
        if scale * rate[order[k]] <= 1:
            return np.minimum(1.0, np.maximum(0.0, scale) * rate)
    raise AssertionError


def probabilities(cells: DataFrame, *, targets: dict[str, dict | None], flatten: float, rest: float, fraction: float, max_cells: int = MAX_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, p) from the cell table (margins, tokens)."""
    spark = cells.sparkSession
    cells = checkpointed(cells)
    n = cells.limit(max_cells + 1).count()
    if n <= max_cells:
        named = sum((F.coalesce(F.octet_length(F.col(m).cast("string")), F.lit(0)) for m in MARGINS), F.lit(32))
        n = n if (cells.agg(F.sum(named)).first()[0] or 0) <= CELL_BYTES else max_cells + 1
    schema = T.StructType([*[cells.schema[m] for m in MARGINS], T.StructField("p", T.DoubleType())])
    if n <= max_cells:
        rows = cells.collect()  # at most max_cells
        table = pd.DataFrame([(r["source"], r["lang"], r["topic"], r["tokens"]) for r in rows], columns=[*MARGINS, "tokens"], dtype=object)
        table["tokens"] = table["tokens"].astype(float)
        shares = {}
        for m in MARGINS:
            totals: dict = {}
            for r in rows:
                totals[r[m]] = totals.get(r[m], 0) + r["tokens"]
            shares[m] = target_shares(totals, targets.get(m), flatten, rest)
        w, tokens = rake(table, shares, rounds), table["tokens"].to_numpy(float)
        p = np.where(tokens > 0, calibrate(tokens, w, fraction * tokens.sum()), 1.0)
        found = spark.createDataFrame([(r["source"], r["lang"], r["topic"], float(x)) for r, x in zip(rows, p, strict=True)], schema)
        return F.broadcast(found)  # max_cells rows of CELL_BYTES at most
    shares = {m: _share_table(cells, m, targets.get(m), flatten, rest) for m in MARGINS}
    raked = rake_distributed(cells, shares, rounds).withColumn("__r", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    # The scale by bisection: each step is one small aggregate.
    budget = fraction * float(raked.agg(F.sum("tokens")).first()[0] or 0)
    most = float(raked.where("w > 0").agg(F.sum("tokens")).first()[0] or 0)
    low, high = 0.0, 1.0

    def expected(scale: float) -> float:
        return float(raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(scale) * F.col("__r")))).first()[0] or 0)

    if most > budget:
        while expected(high) < budget:
            low, high = high, high * 2
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if expected(middle) < budget else (low, middle)
            if high - low <= 1e-12 * high:
                break
        p = F.least(F.lit(1.0), F.lit(high) * F.col("__r"))
    else:
        p = (F.col("__r") > 0).cast("double")
    return checkpointed(raked.select(*MARGINS, F.when(F.col("tokens") > 0, p).otherwise(1.0).alias("p")))


def _share_table(cells: DataFrame, margin: str, target: dict | None, flatten: float, rest: float) -> DataFrame:
    totals = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    if target is None:
        raw = totals.withColumn("raw", F.pow(F.col("t").cast("double"), F.lit(flatten)))
    else:
        kind = cells.schema[margin].dataType
        given = cells.sparkSession.createDataFrame(list(target.items()), T.StructType([T.StructField("g", kind), T.StructField("named", T.DoubleType())]))
        joined = totals.join(F.broadcast(given), F.col("value").eqNullSafe(F.col("g")), "left")  # as long as the caller's dict
        sums = joined.agg(F.sum("named").alias("n"), F.sum(F.when(F.col("named").isNull(), F.col("t"))).alias("o")).first()
        share = rest * (sums["n"] or 0.0) / max(1e-300, 1 - rest) / (sums["o"] or 1)
        raw = joined.withColumn("raw", F.coalesce("named", F.lit(share) * F.col("t")))
    whole = raw.agg(F.sum("raw")).first()[0] or 1.0
    return checkpointed(raw.select("value", (F.col("raw") / F.lit(float(whole))).alias("want")))


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    return F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))


def _joined(rows: DataFrame, found: DataFrame, topic: str) -> tuple[DataFrame, str]:
    """``rows`` with the probability of their cell, and the name of its column."""
    s, g, t, p = (fresh_name(rows, n) for n in ("__s", "__l", "__t", "__p"))
    found = found.select(F.col("source").alias(s), F.col("lang").alias(g), F.col("topic").alias(t), F.col("p").alias(p))
    same = F.col("source").eqNullSafe(F.col(s)) & F.col("lang").eqNullSafe(F.col(g)) & F.col(f"`{topic}`").eqNullSafe(F.col(t))
    return rows.join(found, same).drop(s, g, t), p


def _cells(rows: DataFrame, topic: str, tokens: str) -> DataFrame:
    return rows.groupBy("source", "lang", F.col(f"`{topic}`").alias("topic")).agg(F.sum(tokens).alias("tokens"))


def mixture(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, targets: dict[str, dict | None] | None = None, flatten: float = 0.5,
    rest: float = 0.0, fraction: float = 0.5, topics: int = TOPICS, seed: int = 11, max_cells: int = MAX_CELLS, rounds: int = ROUNDS, carry: list[str] | None = None,
) -> DataFrame:
    """Each row with its topic, tokens, inclusion probability ``p`` and ``sampled``.

    ``carry`` names the columns of ``docs`` to keep, all where None. ``fraction`` is the
    token budget as a share of all tokens. One scan of the texts gives profiles, which
    are kept with the carried columns; topics, cells and draws are made of these. The
    cell table is aggregated before anything is shuffled; probabilities come back by a
    join on the cell, broadcast while the table is small, split where it is skewed.
    """
    kept = docs.columns if carry is None else carry
    name, topic, tokens = (fresh_name(docs, n) for n in ("__profile", "__topic", "__tokens"))
    source = docs.withColumn(topic, F.col(f"`{topic_col}`")) if topic_col else docs
    rows = _profiled(source, text_col, name, tokens)
    rows = checkpointed(rows.select(*(f"`{c}`" for c in dict.fromkeys([*kept, "source", "lang", id_col, tokens, topic if topic_col else name]))))
    if not topic_col:
        rows = _with_topic(rows, name, topic, learn_topics(rows.select(F.col(name).alias("profile")), topics))
    found = probabilities(_cells(rows, topic, tokens), targets=targets or {}, flatten=flatten, rest=rest, fraction=fraction, max_cells=max_cells, rounds=rounds)
    joined, p = _joined(rows, found, topic)
    extra = {topic: "topic", tokens: "tokens", p: "p"}
    own = [c for c in kept if c.lower() not in {"topic", "tokens", "p", "sampled"}]
    return joined.select(
        *[F.col(f"`{c}`") for c in own], *[F.col(a).alias(b) for a, b in extra.items()], (draw(id_col, seed) < F.col(p)).alias("sampled")
    )


def sample(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, targets: dict[str, dict | None] | None = None, flatten: float = 0.5,
    rest: float = 0.0, fraction: float = 0.5, topics: int = TOPICS, seed: int = 11, max_cells: int = MAX_CELLS, rounds: int = ROUNDS,
) -> DataFrame:
    """The sampled rows with the columns of ``docs``: those that ``mixture`` samples.
    Two scans: one for profiles, one to draw where the rows lie."""
    name, topic, tokens = (fresh_name(docs, n) for n in ("__profile", "__topic", "__tokens"))
    source = docs.withColumn(topic, F.col(f"`{topic_col}`")) if topic_col else docs
    first = checkpointed(_profiled(source.select(*(f"`{c}`" for c in dict.fromkeys(["source", "lang", text_col, *([topic] if topic_col else [])]))), text_col, name, tokens).drop(text_col))
    model = None if topic_col else learn_topics(first.select(F.col(name).alias("profile")), topics)
    cells = _cells(first if topic_col else _with_topic(first, name, topic, model), topic, tokens)
    found = probabilities(cells, targets=targets or {}, flatten=flatten, rest=rest, fraction=fraction, max_cells=max_cells, rounds=rounds)
    rows = source if topic_col else _topics_of(docs, text_col, topic, model)
    joined, p = _joined(rows, found, topic)
    return joined.where(draw(id_col, seed) < F.col(p)).select(*(f"`{c}`" for c in docs.columns))


def margin_report(mixed: DataFrame, *, targets: dict[str, dict | None] | None = None, flatten: float = 0.5, rest: float = 0.0) -> DataFrame:
    """(margin, value, tokens, target, expected): for each value of a margin the share
    of tokens that was asked for and the share that the rows of ``mixture`` are expected
    to give. They differ where a cell has too few tokens or margins contradict."""
    cells = checkpointed(mixed.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("p")).alias("given")))
    whole = cells.agg(F.sum("given")).first()[0] or 1.0
    out = None
    for m in MARGINS:
        want = _share_table(cells, m, (targets or {}).get(m), flatten, rest)
        have = cells.groupBy(F.col(m).alias("v")).agg(F.sum("tokens").alias("tokens"), (F.sum("given") / F.lit(float(whole))).alias("expected"))
        part = have.join(want, F.col("v").eqNullSafe(F.col("value")), "left").select(
            F.lit(m).alias("margin"), F.col("v").cast("string").alias("value"), "tokens", F.coalesce("want", F.lit(0.0)).alias("target"), "expected"
        )
        out = part if out is None else out.unionByName(part)
    return out
