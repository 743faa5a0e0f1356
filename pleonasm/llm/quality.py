"""Quality classifier: naive Bayes features in a linear support vector machine."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pleonasm.llm.batches import text_bytes, window_hashes, word_hashes, words

#: Buckets of the hashed n-grams: of words (one and two), then of bytes (three and four).
BITS = 16
#: One more feature each for a word that stands two, four, eight and sixteen times in a row.
RUNS = (2, 4, 8, 16)
FEATURES = (2 << BITS) + len(RUNS)


def ngram_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted numbers of the n-grams it holds: words, word pairs, runs of three and
    four bytes, words repeated in a row."""
    data, offsets = text_bytes(column)
    starts, ends, first = words(data, offsets)
    single = word_hashes(data, starts, ends)
    pairs = window_hashes(single, 2)
    same = np.concatenate([[0], np.cumsum(single[1:] == single[:-1])]) if len(single) else np.zeros(0, np.int64)
    shift = np.uint64(64 - BITS)
    single, pairs = (single >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)
    seen = np.zeros(FEATURES, bool)
    grams = np.array([0x9E3779B1, 0x85EBCA77], dtype=np.uint32)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        seen[single[a:b]] = True
        seen[pairs[a : max(b - 1, a)]] = True
        for k, run in enumerate(RUNS):
            if b - a >= run and (same[a + run - 1 : b] - same[a : b - run + 1] == run - 1).any():
                seen[(2 << BITS) + k] = True
        raw = data[offsets[i] : offsets[i + 1]].astype(np.uint32)
        if len(raw) > 2:
            three = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
            seen[(1 << BITS) + ((three * grams[0]) >> np.uint32(32 - BITS))] = True
            four = three[:-1] << np.uint32(8) | raw[3:]
            seen[(1 << BITS) + ((four * grams[1]) >> np.uint32(32 - BITS))] = True
        found = np.flatnonzero(seen)
        yield found.astype(np.int32)
        seen[found] = False


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = sum of weights / sqrt(number of n-grams) + bias."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, grams: np.ndarray) -> float:
        return float(self.weights[grams].sum() / np.sqrt(max(len(grams), 1)) + self.bias)

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.shift, -40, 40))))


def log_count_ratio(good: np.ndarray, bad: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the share an n-gram has of its class's counts, good over bad."""
    p, q = good + smooth, bad + smooth
    return np.log((p / p.sum()) / (q / q.sum()))


def fit_svm(sets: Sequence[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model over indicators times `ratio`, by dual coordinate descent.

    A row is divided by the root of its number of n-grams, and classes weigh the same in all. The bias is a feature
    of value 1. Values of a row are made when it is its turn, so nothing as large as `sets` is held besides them.
    """
    sides = np.where(labels > 0, 1.0, -1.0)
    n = len(sides)
    caps = np.where(sides > 0, cost * n / max(2 * (sides > 0).sum(), 1), cost * n / max(2 * (sides < 0).sum(), 1))
    scale = [1 / np.sqrt(max(len(s), 1)) for s in sets]
    norms = np.array([(v := ratio[s] * k) @ v + 1 for s, k in zip(sets, scale, strict=True)])
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(n)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(n):
            grams = sets[i]
            values = ratio[grams] * scale[i]
            gradient = sides[i] * (w[grams] @ values + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), caps[i])
            step = (new - alpha[i]) * sides[i]
            if step:
                w[grams] += step * values
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w * ratio, bias


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, by Newton steps with a little shrinkage."""
    target = np.where(labels > 0, 1 - 1 / (2 + (labels > 0).sum()), 1 / (2 + (labels <= 0).sum()))
    x = np.stack([margins, np.ones(len(margins))])
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        gradient = x @ (p - target) + 1e-3 * theta
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(max(theta[0], 1e-6)), float(theta[1])


def fit(sets: Sequence[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 8) -> Model:
    """The model, with its sigmoid fitted to margins of rows that were left out of the fit (three folds)."""
    if len(set(labels.tolist())) < 2:
        always = 4.0 if len(labels) == 0 or labels[0] > 0 else -4.0
        return Model(np.zeros(len(ratio)), 0.0, 1.0, always)
    fold = np.arange(len(labels)) % 3
    margins = np.zeros(len(labels))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        w, bias = fit_svm([sets[i] for i in inside], labels[inside], ratio, cost, epochs)
        part = Model(w, bias, 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(sets[i])
    slope, shift = fit_sigmoid(margins, labels)
    w, bias = fit_svm(sets, labels, ratio, cost, epochs)
    return Model(w, bias, slope, shift)


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a prompt is kept for testing: the CRC-32 of its key as text is a multiple of `folds`; null is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn_quality(
    prompts: DataFrame,
    labels: DataFrame,
    key: str = "prompt_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    most_rows: int = 3000,
) -> Model:
    """Fits the classifier to labels of prompts that are not held out.

    At most `most_rows` labelled keys (those of the smallest hash) are used; only their texts are read into features, by
    a broadcast of that many keys. N-grams are hashed, so a text comes to the driver as a packed bitmap of 16 kB at
    most, whatever its length. Counts of n-grams by class give log-count ratios (the naive Bayes part), which scale the
    indicators for the linear model. Rows of a null label or key are not used. A key counts once, however many rows it
    has: with the larger of its labels and the text of the smallest hash. Without labels of both classes every text gets
    the same score.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key), folds))
    single = usable.groupBy(F.col(key).alias("labelled")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sample = single.withColumn("order", F.xxhash64("labelled")).orderBy("order", "labelled").limit(most_rows)
    rows = prompts.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("labelled"))
    rows = rows.groupBy("id").agg(F.first("order").alias("order"), F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for found in ngram_sets(batch.column(2)):
                bits = np.zeros(FEATURES, bool)
                bits[found] = True
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["order", "label", "grams"])

    known, sets = _unpacked(rows.select("order", "label", "text").mapInArrow(features, "order long, label int, grams binary").toArrow())
    counts = {side: np.zeros(FEATURES) for side in (True, False)}
    for i, value in enumerate(known):
        counts[bool(value > 0)][sets[i]] += 1
    return fit(sets, known, log_count_ratio(counts[True], counts[False]))


class GramSets(Sequence):
    """Sets of n-gram numbers as slices of one flat array."""

    def __init__(self, flat: np.ndarray, ends: list[int]) -> None:
        self.flat, self.cuts = flat, [0, *ends]

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return self.flat[self.cuts[i] : self.cuts[i + 1]]


def _unpacked(table: pa.Table) -> tuple[np.ndarray, GramSets]:
    """Labels and n-gram sets of packed bitmaps, in an order that does not depend on how rows arrived."""
    order, labels, grams = (c.to_pylist() for c in table.columns)
    places = sorted(range(len(order)), key=lambda i: (order[i], labels[i], grams[i]))
    ends, total, parts = [], 0, []
    for i in places:
        part = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(grams[i]), np.uint8), count=FEATURES)).astype(np.int32)
        total += len(part)
        ends.append(total)
        parts.append(part)
    return np.array([labels[i] for i in places], np.int64), GramSets(np.concatenate(parts) if parts else np.zeros(0, np.int32), ends)


def score_column(prompts: DataFrame, text: str, model: Model) -> Column:
    """The score of a text as a column: other columns of the prompts do not leave Spark."""
    shared = prompts.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        known = shared.value
        parts = []
        for at in range(0, len(column), 500):  # bounds the arrays of a batch
            parts.extend(known.score(grams) for grams in ngram_sets(column.slice(at, 500)))
        return pa.array(parts, pa.float64())

    return score(F.coalesce(F.col(text), F.lit("")))


def score_quality(
    prompts: DataFrame,
    labels: DataFrame,
    key: str = "prompt_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    most_rows: int = 3000,
    threshold: float = 0.3,
) -> DataFrame:
    """Scores every whole text by a model learned from the labels: higher means label 1 is likelier.

    N-grams are words, pairs of words, runs of three and four bytes, and words repeated in a row; nothing but the text
    enters a score. Log-count ratios scale the indicators, a linear hinge-loss model is fitted by dual coordinate
    descent, and a sigmoid fitted to left-out margins turns its margin into a probability. See `learn_quality` for what
    is learned from.

    Returns one row per input row: `key`, held_out, score (0 to 1), predicted (1 if the score is at least `threshold`).
    A null or empty text has the score of no n-grams. Repeated rows are scored each for itself, null keys are kept, other
    columns are not read, an empty table gives no rows.
    """
    model = learn_quality(prompts, labels, key, text, label, folds, most_rows)
    scored = prompts.select(F.col(key), held_out(F.col(key), folds).alias("held_out"), score_column(prompts, text, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
