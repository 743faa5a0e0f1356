"""Near-duplicate prompts by SimHash, linked through an inverted index of fingerprint bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from xxhash import xxh64_intdigest

from pleonasm.llm.linking import components
from pleonasm.session import cut_lineage

SEED = 42
BYTES = 8
MAX_BITS = 3
#: Two fingerprints that differ in at most three bits share at least five of their eight bytes.
MIN_MATCHES = BYTES - MAX_BITS
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; one is set if it is set in over half of the hashes of the text's word shingles, repeats included."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return 0
    if len(found) < shingle:
        return xxh64_intdigest(b" ".join(found), SEED)
    total = np.zeros(64, np.int64)
    count = len(found) - shingle + 1
    for at in range(0, count, _CHUNK):
        part = found[at : at + _CHUNK + shingle - 1]
        hashes = [xxh64_intdigest(b" ".join(words), SEED) for words in zip(*(part[i:] for i in range(shingle)), strict=False)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > count, bitorder="little").tobytes(), "little")


def fingerprints(prompts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp): the fingerprint of each prompt as a signed long."""
    schema = T.StructType([T.StructField(key, prompts.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=schema.names)

    return prompts.select(key, text).mapInArrow(run, schema)


def near(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Pairs that share enough positional bytes, and then, that differ in few enough bits."""
    differ = one ^ other
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    kept = shared >= MIN_MATCHES
    kept[kept] = np.bitwise_count(differ[kept].view(np.uint64)) <= MAX_BITS  # signed numbers would count by absolute value
    return kept


def spanning_links(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what near pairs connect, at most one for each member.

    Those near a member leave the rest when they are reached, so a dense group costs little more than its size.
    """
    rest = np.unique(members)
    links: list[tuple[int, int]] = []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            leader = queue.pop()
            close = near(np.full(len(rest), leader), rest)
            reached = rest[close]
            rest = rest[~close]
            links.extend((int(leader), int(r)) for r in reached)
            queue.extend(reached)
    return links


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def _postings(prints: DataFrame, sets: list[tuple[int, ...]], *more: Column) -> DataFrame:
    """(.., posting, bytes, fp): an entry under its own bytes for each set of positions."""
    entries = F.array(*[F.struct(F.lit(i).alias("posting"), F.col("fp").bitwiseAND(F.lit(_mask(s)).cast("long")).alias("bytes")) for i, s in enumerate(sets)])
    return prints.select(*more, "fp", F.explode(entries).alias("e")).select(*more, "e.posting", "e.bytes", "fp")


#: Three positions of one half. Of five shared positions one half holds three or more, so a linked pair meets.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def _linked(groups: DataFrame) -> DataFrame:
    """(u, v) for the arrays `members`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for members in batch.column(0):
                links.extend(spanning_links(members.values.to_numpy()))
            u, v = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return groups.select("members").mapInArrow(run, "u long, v long")


def fingerprint_links(prints: DataFrame, most: int = 20_000) -> DataFrame:
    """(u, v): links between distinct fingerprints `fp` that connect exactly what differs in three bits or fewer.

    A posting is a choice of three byte positions and the bytes there. Members of a posting are compared where they
    lie, sharing of five positional bytes first. A posting of more than `most` members is dealt anew by two more of the
    positions it does not fix (a linked pair shares five in all), so it holds at most 2**24 different fingerprints.
    """
    posted = _postings(prints, TRIPLES).withColumn("n", F.count("*").over(W.partitionBy("posting", "bytes")))
    usual = posted.where(F.col("n").between(2, most)).groupBy("posting", "bytes").agg(F.collect_list("fp").alias("members"))
    links = _linked(usual)
    large = posted.where(F.col("n") > most).select("posting", "bytes", "fp")
    deeper = []
    for i, triple in enumerate(TRIPLES):
        free = [p for p in range(BYTES) if p not in triple]
        pairs = [tuple(sorted(triple + pair)) for pair in combinations(free, MIN_MATCHES - len(triple))]
        deeper.append(F.when(F.col("posting") == i, F.array(*[F.struct(F.lit(_mask(s)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_mask(s)).cast("long")).alias("bytes")) for s in pairs])))
    again = large.select("fp", F.explode(F.coalesce(*deeper)).alias("e")).groupBy("e.mask", "e.bytes").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return links.unionAll(_linked(again))


def near_duplicate_prompts(prompts: DataFrame, key: str = "prompt_id", text: str = "text") -> DataFrame:
    """Groups prompts whose SimHash fingerprints differ in at most three bits, directly or through others.

    The text is taken with A-Z in lower case, cut at white space (space, tab to carriage return) into 3-word shingles,
    repeats included; fewer than three words are one shingle, and no words give fingerprint zero, which links like any
    other. A shingle's hash is its XXH64 with seed 42.

    Method: an inverted index from byte positions of the fingerprint to fingerprints, count filtering (a linked pair
    shares five of eight bytes), then the exact distance. Prompts with equal fingerprints are one entry, counted
    before the shuffle, and a posting gives at most one link for each member, so a group of copies or of near copies
    never becomes pairs. Components are found with joins; only counts come to the driver.

    Returns one row per input row: `key`, fingerprint (16 lowercase hex digits), component_id (smallest key of the
    group, nulls aside). Null text is empty. Repeated rows share a group, other columns are not read, an empty table
    gives no rows.
    """
    prints = cut_lineage(fingerprints(prompts, key, text))
    distinct = prints.groupBy("fp").agg(F.min(key).alias("first"))
    stars = components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("root"), "first")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(groups, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
