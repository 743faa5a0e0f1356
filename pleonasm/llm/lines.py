"""Removal of lines that many prompts share, with two Bloom filters in front of the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pleonasm.llm.batches import SPACES
from pleonasm.session import cut_lineage

SEGMENTS = 64  # parts of a filter that different tasks build
PROBES = 3


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(SPACES).lower()


def keys_by_line(text: str | None) -> list[bytes]:
    return [line_key(line) for line in (text or "").encode().split(b"\n")]


def _bits(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Positions of each hash inside its segment (the segment comes from the top bits)."""
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    return [((hashes + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def _segment(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(58)).astype(np.int64)


def _test(filter_bits: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _bits(hashes, bits):
        found &= (filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def _set(filter_bits: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    for at in _bits(hashes, bits):
        np.bitwise_or.at(filter_bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def _distinct_keys(text: str | None, shortest: int) -> dict[bytes, list[int]]:
    """Line numbers of each key of a text that is long enough."""
    found: dict[bytes, list[int]] = {}
    for i, key in enumerate(keys_by_line(text)):
        found.setdefault(key, []).append(i)
    if shortest > 1:
        return {k: v for k, v in found.items() if len(k.decode()) >= shortest}
    if shortest == 1:
        found.pop(b"", None)
    return found


def twice_seen(prompts: DataFrame, text: str, shortest: int, bits: int) -> DataFrame:
    """(segment, filter): for each segment of the key space the Bloom filter of keys seen in two or more prompts.

    A task sends the distinct hashes it has met, by segment. The task of a segment reads them once: what is already in
    the once-seen filter goes into the twice-seen one, and everything goes into the once-seen one. Both have a fixed
    size, so memory does not depend on the input.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[int] = []

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.array(waiting, dtype=np.uint64), return_counts=True)
            waiting.clear()
            rows: tuple[list, list, list] = ([], [], [])
            for again in (False, True):
                part = values[(counts > 1) == again]
                cuts = np.searchsorted(_segment(part), np.arange(SEGMENTS + 1))
                for s in range(SEGMENTS):
                    if cuts[s] < cuts[s + 1]:
                        for column, value in zip(rows, (s, again, part[cuts[s] : cuts[s + 1]].tobytes()), strict=True):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.bool_()), pa.array(rows[2], pa.binary())], names=["segment", "again", "hashes"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                waiting.extend(xxhash.xxh3_64_intdigest(k) for k in _distinct_keys(value, shortest))
                if len(waiting) >= 1_000_000:
                    yield flush()
        if waiting:
            yield flush()

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for segment, again, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment not in held:
                    held[segment] = (np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8))
                once, twice = held[segment]
                values = np.frombuffer(blob, np.uint64)
                _set(twice, values if again else values[_test(once, values, bits)], bits)
                _set(once, values, bits)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([t.tobytes() for _, t in held.values()], pa.binary())], names=["segment", "filter"])

    sent = prompts.select(text).mapInArrow(hashes, "segment int, again boolean, hashes binary")
    return sent.repartition(SEGMENTS // 4, "segment").mapInArrow(filters, "segment int, filter binary")


def suspects(prompts: DataFrame, text: str, shortest: int, bits: int, row: Column) -> DataFrame:
    """(row, line_key, lines): keys of a prompt that the twice-seen filter holds, with the numbers of their lines."""
    session = prompts.sparkSession
    parts = twice_seen(prompts, text, shortest, bits).collect()  # SEGMENTS rows of `bits` bits
    shared = session.sparkContext.broadcast({r["segment"]: bytes(r["filter"]) for r in parts})
    source = prompts.select(row.alias("row"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("line_key", T.StringType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s: np.frombuffer(f, np.uint8) for s, f in shared.value.items()}
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                owners, keys, lines, hashes = [], [], [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    for key, numbers in _distinct_keys(value, shortest).items():
                        owners.append(i)
                        keys.append(key)
                        lines.append(numbers)
                        hashes.append(xxhash.xxh3_64_intdigest(key))
                values = np.array(hashes, dtype=np.uint64)
                segments = _segment(values)
                keep = np.zeros(len(values), bool)
                for s in np.unique(segments):
                    mine = segments == s
                    keep[mine] = _test(known[s], values[mine], bits)
                found = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([owners[i] for i in found], pa.int32())), pa.array([keys[i].decode() for i in found], pa.string()), pa.array([lines[i] for i in found], pa.list_(pa.int32()))],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


def _filter_bits(prompts: DataFrame, text: str, most: int) -> int:
    """Bits of a segment's filter: eight or more for each line, a power of two, at most `most` for all segments."""
    lines = prompts.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    return max(1 << 10, min(most, 1 << (8 * lines - 1).bit_length()) // SEGMENTS)


def repeated_lines(found: DataFrame, min_prompts: int) -> DataFrame:
    """(line_key, prompts, first): confirmed keys, in how many prompts they stand, and the smallest (row, line)."""
    counted = found.groupBy("line_key").agg(F.count("*").alias("prompts"), F.min(F.struct("row", F.array_min("lines").alias("line"))).alias("first"))
    return counted.where(F.col("prompts") >= min_prompts)


def drop_repeated_lines(
    prompts: DataFrame,
    key: str = "prompt_id",
    text: str = "text",
    min_prompts: int = 10,
    shortest: int = 1,
    keep_first: bool = False,
    filter_bits: int = 1 << 28,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Removes every line whose key stands in at least `min_prompts` prompts.

    A text is cut at line feeds; the key of a line is the line without white space (space, tab to carriage return) at
    its ends and with A-Z in lower case. Keys of fewer than `shortest` code points are never removed. With
    `keep_first`, the first occurrence (smallest prompt, then smallest line number) stays.

    Method: two Bloom filters, for hashes seen once and seen twice, are built over all lines; only keys the twice-seen
    filter holds are shuffled, to be counted by the key itself. So a wrong guess of a filter costs a shuffled row and
    never a result. `filter_bits` bounds the filter that is sent to every executor (32 MB at the default); a corpus
    with more lines than that serves shuffles more false suspects. A key in a third of all prompts is counted where it
    is read before it is shuffled.

    Returns one row per input row: `key`, text (what is kept; null becomes empty), n_lines, n_dropped, and the columns
    named in `carry`. A null or empty text is one empty line, and an empty line has no key to remove. Repeated rows
    count as prompts of their own, null keys are kept, other columns are not read, an empty table gives no rows.
    """
    row = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h"))
    bits = _filter_bits(prompts, text, filter_bits)
    found = cut_lineage(suspects(prompts, text, shortest, bits, row))  # read twice below
    # Cut off from its aggregation, so that adaptive execution can split a line of very many prompts in the join.
    repeated = cut_lineage(repeated_lines(found, min_prompts))
    dropped = found.join(repeated, "line_key")
    if keep_first:
        stays = (F.col("row") == F.col("first.row")) & F.col("first.row").isNotNull()
        dropped = dropped.withColumn("lines", F.when(stays, F.filter("lines", lambda n: n != F.col("first.line"))).otherwise(F.col("lines")))
    marks = dropped.groupBy(F.col("row").alias("marked")).agg(F.flatten(F.collect_list("lines")).alias("drop"))
    carried = [F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)]
    whole = prompts.select(F.col(key).alias("id"), F.col(text).alias("text"), row.alias("row"), *carried)
    joined = whole.join(marks, F.col("row").eqNullSafe(F.col("marked")), "left")

    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
    def rewrite(column: pa.Array, marked: pa.Array) -> pa.Array:
        texts, before, removed = [], [], []
        for value, numbers in zip(column.to_pylist(), marked.to_pylist(), strict=True):
            lines = value.split("\n")
            drop = set(numbers or ())
            texts.append("\n".join([line for i, line in enumerate(lines) if i not in drop]) if drop else value)
            before.append(len(lines))
            removed.append(len(drop))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(removed, pa.int64())], names=["text", "n_lines", "n_dropped"])

    kept = joined.withColumn("kept", rewrite(F.coalesce("text", F.lit("")), "drop"))
    return kept.select(F.col("id").alias(key), "kept.text", "kept.n_lines", "kept.n_dropped", *[F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)])
