"""Quality rules of prompts, and of the hosts they come from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pleonasm.llm.batches import text_bytes, window_hashes, word_hashes, words
from pleonasm.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8


def _repeated_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the words inside windows of eight words that stand in it twice or more."""
    n_words = np.diff(first)
    hashes = window_hashes(word_hashes(data, starts, ends), WINDOW)
    at = np.arange(len(hashes))
    at = at[at + WINDOW <= np.repeat(first[1:], n_words)[: len(hashes)]]
    owner = np.repeat(np.arange(len(n_words), dtype=np.uint64), n_words)[at]
    # The text enters the hash, so one sort finds what repeats inside each text.
    own = (hashes[at] ^ (owner * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    edge = np.zeros(len(starts) + WINDOW + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: len(starts)] > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
def rule_counts(column: pa.Array) -> pa.Array:
    """Counts the rules are about, for each whole text."""
    parts: list[list[np.ndarray]] = [[] for _ in _COUNTS]
    for at in range(0, len(column), 500):
        data, offsets = text_bytes(column.slice(at, 500))
        starts, ends, first = words(data, offsets)
        body = data[: int(offsets[-1])]
        space = (body == 32) | ((body >= 9) & (body <= 13))
        chars = np.concatenate([[0], np.cumsum(((body & 0xC0) != 0x80) & ~space)])
        marks = np.concatenate([[0], np.cumsum(np.isin(body, np.frombuffer(SYMBOLS, np.uint8)))])
        raw = body.tobytes()
        lines = np.array([_duplicate_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
        repeated = _repeated_words(data, offsets, starts, ends, first)
        for part, values in zip(parts, (np.diff(first), np.diff(chars[offsets]), np.diff(marks[offsets]), lines, repeated), strict=True):
            part.append(values)
    whole = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
    return pa.StructArray.from_arrays([pa.array(w, pa.int64()) for w in whole], names=list(_COUNTS))


def host_of(url: Column) -> Column:
    """Host name of a URL in lower case, without a port; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def failed_rules(counts: str, min_words: int, most_repeated: int, most_symbols: int, line_words: int) -> dict[str, Column]:
    """The rules a prompt can fail, by the counts in the struct `counts`."""
    n = F.col(f"{counts}.n_words")
    return {
        "words": n < min_words,
        "repeats": 100 * F.col(f"{counts}.n_repeat_words") > most_repeated * n,
        "symbols": 100 * F.col(f"{counts}.n_symbols") > most_symbols * n,
        "lines": line_words * F.col(f"{counts}.n_dup_lines") > n,
    }


def host_verdicts(failures: DataFrame, host: str, rules: list[str], excess: float, doubt: float) -> DataFrame:
    """(host, prompts, the rates of all `rules`, host_failed): failure rates of hosts, drawn to the rate of all hosts.

    For each rule, rates are taken as draws from a beta distribution whose mean and variance are those of the hosts' own
    rates; a host's rate is the mean of what its prompts leave of that. So a host of few prompts is not judged by them
    alone. A host fails if, for some rule, its rate less `doubt` standard deviations still lies above `excess` times
    the mean of all hosts. Hosts that all fail alike do not stand out, however often they fail.
    """
    counts = cut_lineage(failures.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("prompts"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules]))
    own = {r: F.col(r) / F.col("prompts") for r in rules}
    moments = counts.agg(*[c for r in rules for c in (F.avg(own[r]), F.var_pop(own[r]))]).first()
    failed, rates = F.lit(False), []
    for i, r in enumerate(rules):
        mean, spread = moments[2 * i : 2 * i + 2]
        mean, spread = min(max(mean or 0.0, 1e-3), 1 - 1e-3), spread or 0.0
        # Without spread all hosts share one rate: the prior weighs as much as very many prompts.
        weight = min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1.0), 1e6)
        total = F.col("prompts") + weight
        rate = (F.col(r) + mean * weight) / total
        failed |= rate - doubt * F.sqrt(rate * (1 - rate) / (total + 1)) > excess * mean
        rates.append(rate.alias(f"{r}_rate"))
    return counts.select(host, "prompts", *rates, failed.alias("host_failed"))


def judge_prompts(
    prompts: DataFrame,
    key: str = "prompt_id",
    text: str = "text",
    host: str = "host",
    min_words: int = 20,
    most_repeated: int = 30,
    most_symbols: int = 30,
    line_words: int = 30,
    excess: float = 3.0,
    doubt: float = 2.0,
) -> DataFrame:
    """Applies rules to whole texts, and to hosts by how many of their prompts fail each rule.

    Words are `[^\\x20\\x09-\\x0D]+`. A prompt fails with fewer than `min_words` words, or with more than
    `most_repeated` percent of its words inside 8-word windows that stand in it twice. Two more rules count for hosts
    only: more than `most_symbols` symbols for 100 words, and more than one repeated line for `line_words` words. Failures
    are counted by host and rule, before the shuffle. A host whose shrunk rate for a rule stands out (see
    `host_verdicts`; `excess` times the mean, `doubt` standard deviations off) loses its other prompts too.

    Returns one row per input row: `key`, n_words, word_chars (code points in words), n_symbols (characters of
    `#*$%&|<>`), n_dup_lines (lines with a word that equal an earlier one), n_repeat_words, base_failed, host_rate (of
    the rule on words), host_failed, kept. A null or empty text has no words and fails. A null host is judged by its
    prompt alone (host_rate null, host_failed false); one host alone, or hosts of equal rates, do not stand out.
    Repeated rows count each, null keys are kept, other columns are not read, an empty table gives no rows.
    """
    counted = prompts.select(F.col(key).alias("id"), F.col(host).alias("host"), rule_counts(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    rules = failed_rules("c", min_words, most_repeated, most_symbols, line_words)
    base = cut_lineage(counted.select("id", "host", "c.*", *[c.alias(f"fails_{r}") for r, c in rules.items()]))
    judged = host_verdicts(base, "host", [f"fails_{r}" for r in rules], excess, doubt)
    verdicts = cut_lineage(judged.select(F.col("host").alias("named"), F.col("fails_words_rate").alias("rate"), "host_failed"))
    joined = base.join(verdicts, F.col("host") == F.col("named"), "left")
    failed, host_failed = F.col("fails_words") | F.col("fails_repeats"), F.coalesce("host_failed", F.lit(False))
    return joined.select(
        F.col("id").alias(key), *_COUNTS, failed.alias("base_failed"), F.col("rate").alias("host_rate"), host_failed.alias("host_failed"), (~failed & ~host_failed).alias("kept")
    )
