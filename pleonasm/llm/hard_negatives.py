"""Hard negatives for prompt vectors: pair scores sorted by a shuffle and read as a stream."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pleonasm.llm.scratch import Scratch

#: Products of a chunk of rows with a block of anchors, and pairs held before they are reduced to the best.
CHUNK_PAIRS, HELD_PAIRS = 1 << 21, 1 << 18
_LONG = (1 << 63) - 1
#: (anchor, descending score, positives before negatives, id) as bytes that sort in that order.
_KEY = struct.Struct(">IQBQ")


def pair_key(anchor: int, score: int, negative: bool, row_id: int) -> bytes:
    return _KEY.pack(anchor, _LONG - score, negative, row_id + _LONG + 1)


def open_windows(pairs: Iterable[tuple[bytes, None]], low: int, high: int, most: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) out of pair keys in their order.

    A positive opens a window, and a negative goes to every open window it falls into that has had fewer than `most`.
    Windows of one anchor are all that is held.
    """
    current, windows = None, []
    for key, _ in pairs:
        anchor, falling, negative, shifted = _KEY.unpack(key)
        score, row_id = _LONG - falling, shifted - _LONG - 1
        if anchor != current:
            current, windows = anchor, []
        if not negative:
            windows.append([row_id, score, 0])
            continue
        for window in windows:
            if window[2] < most and low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], row_id, window[1], score


def quantised(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of all components in a row as doubles, and the length of each vector."""
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return values, np.diff(column.offsets.to_numpy())


class Block:
    """Some anchors: their vectors side by side, padded with zeros, with lengths, keys and labels."""

    def __init__(self, table: pa.Table, scale: float) -> None:
        self.ids = table.column("id").to_numpy()
        self.labels = table.column("label").to_pylist()
        self.codes = {v: i for i, v in enumerate(dict.fromkeys(self.labels))}
        self.label_codes = np.array([self.codes[v] for v in self.labels], np.int64)
        values, self.lengths = quantised(table.column("vector").combine_chunks(), scale)
        self.width = int(self.lengths.max())
        self.matrix = self._padded(values, self.lengths)
        self.largest = float(np.abs(self.matrix).max(initial=0))

    def _padded(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        full = np.zeros((len(lengths), self.width))
        full[np.arange(self.width) < lengths[:, None]] = values
        return full

    def scores(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Inner products, anchors by rows; exact, at the ends of 64 bits beyond them."""
        rows = self._padded(values, lengths)
        reach = self.largest * float(np.abs(rows).max(initial=0)) * max(self.width, 1)
        if reach < 2**53:
            return (self.matrix @ rows.T).astype(np.int64)

        def whole(m: np.ndarray) -> np.ndarray:
            return np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)

        exact = whole(self.matrix) @ whole(rows).T
        return np.array([[max(-_LONG, min(_LONG, int(x))) for x in row] for row in exact], np.int64).reshape(exact.shape)


class Best:
    """The first `most` pairs of each group by descending score, then id, kept while pairs stream by."""

    def __init__(self, groups: int, most: int) -> None:
        self.most = most
        self.floor = np.full(groups, -_LONG - 1, np.int64)  # a group that is full needs this score
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, group: np.ndarray, score: np.ndarray, row_id: np.ndarray, row: np.ndarray) -> None:
        if len(group):
            self.held.append((group, score, row_id, row))
            self.waiting += len(group)
            if self.waiting > HELD_PAIRS:
                self.reduce()

    def reduce(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 4
        group, score, row_id, row = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((row, row_id, ~score, group))
        group, score, row_id, row = group[order], score[order], row_id[order], row[order]
        nth = np.arange(len(group)) - np.searchsorted(group, group)
        full = group[nth == self.most - 1]
        self.floor[full] = score[nth == self.most - 1]
        kept = nth < self.most
        self.held = [(group[kept], score[kept], row_id[kept], row[kept])]
        self.waiting = 0
        return self.held[0]


def _chunks(batches: Iterator[pa.RecordBatch], block: Block, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Scores (anchors by rows), whether labels are the same, ids and numbers of rows of each chunk; a pair of vectors
    of unlike length or of one key has label -1 in the second array, neither same nor other."""
    seen, step = 0, max(1, CHUNK_PAIRS // max(len(block.ids), 1))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            ids = part.column(0).to_numpy()
            codes = np.array([block.codes.get(v, -1) for v in part.column(1).to_pylist()], np.int64)
            values, lengths = quantised(part.column(2), scale)
            fits = lengths <= block.width
            scores = block.scores(values[np.repeat(fits, lengths)], np.where(fits, lengths, 0)) if not fits.all() else block.scores(values, lengths)
            kind = (codes == block.label_codes[:, None]).astype(np.int8)
            kind[(lengths != block.lengths[:, None]) | (ids == block.ids[:, None])] = -1
            yield scores, kind, ids, np.arange(seen, seen + len(ids))
            seen += len(ids)


def _pairs(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    anchor, score, row_id = parts[:3]
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(score, pa.int64()), pa.array(row_id, pa.int64())], names=["anchor", "score", "id"])


_PAIRS = "anchor long, score long, id long"


def best_positives(rows: DataFrame, block, scale: float, most: int) -> DataFrame:
    """(anchor, score, id): the first rows of an anchor's own label, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        best = Best(len(anchors.ids), most)
        for scores, kind, ids, numbers in _chunks(batches, anchors, scale):
            a, r = np.nonzero((kind == 1) & (scores >= best.floor[:, None]))
            best.add(a, scores[a, r], ids[r], numbers[r])
        yield _pairs(best.reduce())

    return rows.mapInArrow(run, _PAIRS)


def window_negatives(rows: DataFrame, block, opened, scale: float, low: int, high: int, most: int) -> DataFrame:
    """(anchor, score, id): the first rows of another label in each window of an anchor, of each task; a row once for an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (owners, bounds) = block.value, opened.value  # window w of anchor owners[w]; its least and greatest score
        best = Best(len(owners), most)
        slots = [np.flatnonzero(np.arange(len(owners)) - np.searchsorted(owners, owners) == k) for k in range(int(np.bincount(owners).max(initial=0)))]
        for scores, kind, ids, numbers in _chunks(batches, anchors, scale):
            for slot in slots:  # one window of each anchor at a time
                mine = owners[slot]
                some = scores[mine]
                least = np.maximum(bounds[slot, 0], best.floor[slot])
                w, r = np.nonzero((kind[mine] == 0) & (some >= least[:, None]) & (some <= bounds[slot, 1][:, None]))
                best.add(slot[w], some[w, r], ids[r], numbers[r])
        window, score, row_id, row = best.reduce()
        anchor = owners[window] if len(window) else window
        _, once = np.unique(np.stack([anchor, row]), axis=1, return_index=True)
        yield _pairs((anchor[once], score[once], row_id[once]))

    return rows.mapInArrow(run, _PAIRS)


def _windows(positives: list, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and score bounds of the windows `positives` open, by anchor; one that no score fits is left out."""
    owners, bounds = [], []
    for p in positives:
        least, greatest = -(-low * p["score"] // 100), high * p["score"] // 100
        if least <= greatest:
            owners.append(p["anchor"])
            bounds.append((least, greatest))
    return np.array(owners, np.int64), np.array(bounds, np.int64).reshape(len(owners), 2)


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    key: str = "prompt_id",
    vector: str = "vector",
    label: str = "prompt_type",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    block_anchors: int = 1024,
) -> DataFrame:
    """For prompts named as anchors, the prompts of another type that are most like them without being too like.

    Components become floor(`scale` * x), and the score of two vectors is their inner product. An anchor's positives
    are its first `positives` other prompts of the same type, by descending score, then key. For each positive, the
    first `negatives` prompts of another type are returned whose score is at least `low` and at most `high` percent of
    the positive's.

    Anchors (rows where the column `anchors` holds) are a stated query set and meet all rows in blocks of about
    `block_anchors`. A task keeps the first positives of each anchor it has met; those of all tasks open the windows.
    A second reading keeps, for each task, the first negatives of each window. These pairs are packed into keys
    (anchor, descending score, positives first, id), dealt by anchor and sorted by the shuffle
    (`repartitionAndSortWithinPartitions`); one pass over a partition opens windows and gives out negatives, holding
    nothing but the windows of one anchor. A task sends at most positives * (negatives + 1) pairs an anchor, however
    many rows it reads, so no anchor, label or vector is a hot key.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Keys are whole numbers.
    Rows of a null key, label or vector, or with a null or non-finite component, take no part. Vectors of unlike length
    do not meet; empty ones have score 0. Repeats of an anchor count as one anchor, other repeated rows each for itself;
    a row of the anchor's own key is never its positive or negative. Scores are exact, and stop at the ends of 64 bits.
    Other columns are not read. No anchors, no rows.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    columns = [F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")]
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "rank" else T.LongType()) for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    scratch = Scratch(spark, "negatives")
    chosen = rows.where(anchors).select(*columns).distinct()
    blocks = -(-chosen.count() // block_anchors)
    if not blocks:
        return spark.createDataFrame([], schema)
    scratch.write(chosen.withColumn("block", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks))).repartition(blocks, "block"), "anchors", "block")
    rows = rows.select(*columns)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    for number in range(blocks):
        table = scratch.read("anchors").where(F.col("block") == number).drop("block").orderBy("id", "label", "vector").toArrow()
        if not table.num_rows:
            continue
        block = context.broadcast(Block(table, scale))
        local = best_positives(rows, block, scale, positives)
        nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
        found = local.withColumn("nth", nth).where(F.col("nth") <= positives).collect()  # at most `positives` rows an anchor of the block
        found.sort(key=lambda r: (r["anchor"], r["nth"]))
        opened = context.broadcast(_windows(found, low, high))
        opening = context.parallelize([(pair_key(r["anchor"], r["score"], False, r["id"]), None) for r in found], 1)
        ids = block.value.ids.tolist()
        candidates = window_negatives(rows, block, opened, scale, low, high, negatives)
        packed = candidates.rdd.map(lambda r: (pair_key(r["anchor"], r["score"], True, r["id"]), None))
        ordered = packed.union(opening).repartitionAndSortWithinPartitions(tasks, lambda k: int.from_bytes(k[:4], "big"))
        mined = ordered.mapPartitions(lambda pairs, ids=ids: ((ids[a], *rest) for a, *rest in open_windows(pairs, low, high, negatives)))
        spark.createDataFrame(mined, schema).write.mode("append").parquet(scratch.path("mined"))
    return spark.read.schema(schema).parquet(scratch.path("mined"))
