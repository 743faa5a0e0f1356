"""Resampling of prompts towards a target distribution by hashed n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pleonasm.llm.batches import text_bytes
from pleonasm.llm.radix import Field, sorted_positions
from pleonasm.llm.scratch import Scratch

#: Bytes of text that are worked on at a time, and bytes of a word that are hashed side by side with other words.
PART_BYTES, SIDE_BY_SIDE = 4 << 20, 64


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By byte: its lower case (A-Z only), and whether it belongs to a word (digits, letters, all beyond ASCII)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        inside[a:b] = True
    return lower, inside


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_LOWER, _INSIDE = _letters()
_CRC = _crc_table()


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what `state` has read and then the bytes start to end of each row."""
    state = ~state
    order = np.argsort(starts - ends, kind="stable")  # long ones first, so that those still open are a prefix
    at, open_rows = starts[order], state[order]
    lengths = (ends - starts)[order]
    for i in range(min(int(lengths[0]) if len(lengths) else 0, SIDE_BY_SIDE)):
        n = int(np.searchsorted(-lengths, -i, side="left"))
        some = open_rows[:n]
        open_rows[:n] = _CRC[(some ^ data[at[:n] + i]) & np.uint32(255)] ^ (some >> np.uint32(8))
    for k in range(int(np.searchsorted(-lengths, -SIDE_BY_SIDE, side="left"))):
        rest = data[at[k] + SIDE_BY_SIDE : at[k] + lengths[k]].tobytes()
        open_rows[k] = ~np.uint32(zlib.crc32(rest, int(~open_rows[k])))
    state[order] = open_rows
    return ~state


def hashed_runs(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of each word with the one after it, whether that one is in the same text, and for
    each text the number of words before it."""
    data, offsets = text_bytes(column)
    size = int(offsets[-1])
    data = _LOWER[data]
    inside = _INSIDE[data[:size]]
    border = np.zeros(size + 1, bool)
    border[offsets] = True
    open_before = np.concatenate([[False], inside[:-1]]) if size else inside
    starts = np.flatnonzero(inside & (~open_before | border[:size]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | border[1:])) + 1 if size else starts
    first = np.searchsorted(starts, offsets)
    words = _crc_on(np.zeros(len(starts), np.uint32), data, starts, ends)
    spaced = words[:-1]
    spaced = ~(_CRC[(~spaced ^ np.uint32(32)) & np.uint32(255)] ^ (~spaced >> np.uint32(8)))
    pairs = _crc_on(spaced, data, starts[1:], ends[1:])
    together = np.ones(max(len(starts) - 1, 0), bool)
    last = first[1:-1] - 1  # the last word of each text but the last
    together[last[(last >= 0) & (last < len(together))]] = False
    n = np.uint32(buckets)
    return (words % n).astype(np.int64), (pairs % n).astype(np.int64), together, first


def _parts(column: pa.Array) -> Iterator[pa.Array]:
    """The column in runs of rows of about PART_BYTES each, one row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(total, (int(total[at - 1]) if at else 0) + PART_BYTES, side="right")))
        yield column.slice(at, stop - at)
        at = stop


def bucket_counts(texts: DataFrame, text: str, buckets: int) -> DataFrame:
    """(bucket, n): how many words and pairs of neighbours of all texts fall into each bucket; a task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _parts(batch.column(0)):
                words, pairs, together, _ = hashed_runs(part, buckets)
                held += np.bincount(words, minlength=buckets) + np.bincount(pairs[together], minlength=buckets)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(held[met])], names=["bucket", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """For each bucket floor(1000 * log of its share among the target's features over its share among the source's), one added to every count."""
    s_all, t_all = sum(source.values()) + buckets, sum(target.values()) + buckets
    gains = [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all) / (float(source.get(b, 0) + 1) * float(t_all)))) for b in range(buckets)]
    return np.array(gains, np.int64)


def _weigh(prompts: DataFrame, text: str, gains: np.ndarray) -> Column:
    shared = prompts.sparkSession.sparkContext.broadcast(gains)
    names = ("n_words", "n_features", "weight")

    @F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in names]))
    def weigh(column: pa.Array) -> pa.Array:
        gain = shared.value
        rows: list[list[np.ndarray]] = [[], [], []]
        for part in _parts(column):
            words, pairs, together, first = hashed_runs(part, len(gain))
            of_words = np.concatenate([[0], np.cumsum(gain[words])])
            of_pairs = np.concatenate([[0], np.cumsum(np.where(together, gain[pairs], 0)), [0]])
            of_pairs[-1] = of_pairs[-2]  # the last word has no pair
            n = np.diff(first)
            features = n + np.maximum(n - 1, 0)
            summed = of_words[first[1:]] - of_words[first[:-1]] + of_pairs[np.minimum(first[1:], len(words))] - of_pairs[np.minimum(first[:-1], len(words))]
            for held, values in zip(rows, (n, features, summed // np.maximum(features, 1)), strict=True):
                held.append(values)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(r) if r else np.zeros(0, np.int64), pa.int64()) for r in rows], names=list(names))

    return weigh(F.col(text))


def resample_prompts(
    prompts: DataFrame,
    cases: DataFrame,
    key: str = "prompt_id",
    text: str = "text",
    case_text: str = "prompt",
    buckets: int = 10_000,
    min_words: int = 20,
    percent: int = 25,
    seed: int = 7,
    block_rows: int = 1 << 17,
    digit_bits: int = 11,
) -> DataFrame:
    """Draws prompts that look like the benchmark `cases`, without replacement, by importance weights.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. Features are words and pairs of
    neighbouring words, repeats counted, hashed by CRC-32 into `buckets`. A bucket's gain is floor(1000 * log) of its
    share among the cases over its share among all prompts; a prompt's weight is the floored mean of its features'
    gains. Its score is the weight plus Gumbel noise from a hash of `seed` and key, so the highest scores are a draw
    without replacement. Of the prompts with at least `min_words` words, `percent` percent (rounded down) are drawn.

    Texts are read twice, for counts and for weights; what leaves a task is one count a bucket, and what reaches the
    driver and every executor is one number a bucket. Keys and scores are ranked by a distributed radix sort
    (`radix.sorted_positions`); ties go to the smaller key.

    Returns one row per input row: `key` (a whole number), n_features, weight, score, rank (1, 2, 3 ... among those drawn,
    else null). A null or empty text has no features and weight 0. Repeated rows take part each for itself, in any order
    among themselves; a null key has the noise of an empty key and comes after all others. Other columns are not read.
    Without cases, gains compare with even shares; an empty table gives no rows.
    """
    spark = prompts.sparkSession
    known = {r["bucket"]: r["n"] for r in bucket_counts(prompts, text, buckets).collect()}  # at most one row a bucket
    wanted = {r["bucket"]: r["n"] for r in bucket_counts(cases, case_text, buckets).collect()}
    weighed = prompts.select(F.col(key).alias("key"), _weigh(prompts, text, bucket_gains(known, wanted, buckets)).alias("w"))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    scored = weighed.select("key", "w.n_words", "w.n_features", "w.weight", (F.col("w.weight") + gumbel).cast("long").alias("score"))
    scratch = Scratch(spark, "resampling")
    scored = scratch.write(scored, "scores")
    ranked = sorted_positions(scored.where(F.col("n_words") >= min_words), [Field("score", descending=True), Field("key")], scratch, block_rows, digit_bits)
    drawn = ranked.count() * percent // 100
    rank = F.when(F.col("position") < drawn, F.col("position") + 1).cast("long")
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionAll(scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))
