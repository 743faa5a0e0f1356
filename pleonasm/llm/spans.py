"""Removal of passages that stand in the corpus more than once, by Rabin-Karp hashes of all token windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pleonasm.llm.batches import text_bytes, window_hashes, word_hashes, words


class _Block:
    """Words and window hashes of the prompts of a block."""

    def __init__(self, table: pa.Table, window: int, seed: int) -> None:
        column = table.column("text").combine_chunks()
        self.data, self.offsets = text_bytes(column)
        starts, ends, self.first = words(self.data, self.offsets)
        self.n_words = np.diff(self.first)
        hashes = window_hashes(word_hashes(self.data, starts, ends, seed), window)
        # A window must end in the prompt it starts in.
        owner_end = np.repeat(self.first[1:], self.n_words)[: len(hashes)]
        self.at = np.flatnonzero(np.arange(len(hashes)) + window <= owner_end)
        self.hashes = hashes[self.at]


def _bounds(buckets: int) -> np.ndarray:
    """Where each bucket of the hash space ends, but for the last."""
    return np.array([((k << 64) // buckets) for k in range(1, buckets)], dtype=np.uint64)


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart: the upper planes are zeros, which a shuffle compresses away."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0]
    return np.cumsum(steps, dtype=np.uint64)


def _repeated(block: _Block, replies: pa.Table, alive: np.ndarray | None = None) -> np.ndarray:
    """Which windows of a block stand anywhere else: in the block itself, or, by the answers, in another one."""
    hashes = block.hashes if alive is None else block.hashes[alive]
    values, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    again = counts > 1
    if replies.num_rows:
        rows = sorted(zip(replies.column("bucket").to_pylist(), replies.column("count").to_pylist(), replies.column("bits").to_pylist(), strict=True))
        bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in rows])
        again = again | bits.astype(bool)
    found = again[inverse]
    if alive is None:
        return found
    whole = np.zeros(len(block.hashes), bool)
    whole[alive] = found
    return whole


def _sent(hashes: np.ndarray, block: int, bounds: np.ndarray) -> pa.Table:
    values = np.unique(hashes)
    cuts = np.concatenate([[0], np.searchsorted(values, bounds), [len(values)]])
    full = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
    return pa.table({"bucket": pa.array(full, pa.int64()), "block": pa.array([block] * len(full), pa.int64()), "hashes": pa.array([_pack(values[cuts[k] : cuts[k + 1]]) for k in full], pa.binary())})


def _counted(table: pa.Table) -> pa.Table:
    """For the hashes of each block in this bucket, one bit each: does another block have it too?"""
    parts = [_unpack(b) for b in table.column("hashes").to_pylist()]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    shared = values[counts > 1]
    bits = []
    for part in parts:
        at = np.minimum(np.searchsorted(shared, part), max(len(shared) - 1, 0))
        bits.append(np.packbits(shared[at] == part if len(shared) else np.zeros(len(part), bool)).tobytes())
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "count": pa.array([len(p) for p in parts], pa.int64()), "bits": pa.array(bits, pa.binary())})


def _intervals(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


_REPLIES = "block long, bucket long, count long, bits binary"


def remove_repeated_spans(prompts: DataFrame, key: str = "prompt_id", text: str = "text", window: int = 35, block_bytes: int = 8 << 20) -> DataFrame:
    """Removes every word covered by a run of `window` words that starts anywhere else too, in the same prompt or another.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. All windows are judged on the input. Overlapping windows merge into
    maximal intervals of words.

    Method: prompts are dealt into blocks of about `block_bytes`. A block hashes all its windows and sends the distinct
    hashes, sorted, to buckets of the hash space; a bucket counts in how many blocks each stands and answers every block
    with one bit per hash it sent. A block joins the answers with its own counts. So a window costs about six bytes of
    shuffle and an answered bit, no position or text travels with it, and a passage in a third of all prompts is one
    hash per block. Windows found so are counted a second time with another seed, which leaves two different windows
    taken for one with a probability of about 2**-64 each. A group is a block or a bucket, both of bounded size.

    Returns one row per input row: `key`, text (kept words, joined by one space), n_words, n_removed, spans (array of
    start and end of the removed words, counted from 0, end exclusive). A null or empty text has no words; prompts of
    fewer than `window` words keep all. Repeated rows are prompts of their own and so repeat each other. Null keys are
    kept, other columns are not read, an empty table gives no rows.
    """
    total = prompts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    bounds = _bounds(blocks)
    block = F.pmod(F.xxhash64(key, text), F.lit(blocks)).alias("block")
    # Read three times from the same shuffle, which Spark reuses.
    dealt = prompts.select(F.col(key).alias("id"), F.col(text).alias("text"), block).repartition(blocks, "block")

    def first(group: tuple, table: pa.Table) -> pa.Table:
        return _sent(_Block(table, window, 1).hashes, group[0].as_py(), bounds)

    def second(group: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        found = _repeated(_Block(table, window, 1), replies)
        return _sent(_Block(table, window, 2).hashes[found], group[0].as_py(), bounds)

    def last(table: pa.Table, replies: pa.Table, confirmed: pa.Table) -> pa.Table:
        """A window counts if both hashes are repeated."""
        block = _Block(table, window, 1)
        found = _repeated(block, replies)
        if found.any():
            found = _repeated(_Block(table, window, 2), confirmed, found)
        edge = np.zeros(int(block.first[-1]) + window + 1, np.int32)
        np.add.at(edge, block.at[found], 1)
        np.add.at(edge, block.at[found] + window, -1)
        gone = np.cumsum(edge)[: int(block.first[-1])] > 0
        texts, spans, removed = [], [], []
        for i in range(table.num_rows):
            mask = gone[block.first[i] : block.first[i + 1]]
            here = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
            n = int(mask.sum())
            if n:
                here = [w for w, out in zip(here, mask.tolist(), strict=True) if not out]
            texts.append(b" ".join(here).decode())
            spans.append(_intervals(mask) if n else [])
            removed.append(n)
        return pa.table(
            {
                key: table.column("id"),
                "text": pa.array(texts, pa.string()),
                "n_words": pa.array(block.n_words, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    def answer(sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_counted, _REPLIES)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        mine = replies.filter(pc.equal(replies.column("round"), 1))
        return last(table, mine, replies.filter(pc.equal(replies.column("round"), 2)))

    hashed = "bucket long, block long, hashes binary"
    replies = answer(dealt.groupBy("block").applyInArrow(first, hashed))
    confirmed = answer(dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(second, hashed))
    both = replies.withColumn("round", F.lit(1)).unionAll(confirmed.withColumn("round", F.lit(2)))
    schema = T.StructType(
        [
            T.StructField(key, prompts.schema[key].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, schema)
