import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import order
from pyspark.sql import functions as F

from pleonasm.llm import radix, resampling
from pleonasm.llm.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute(rows, cases, buckets=10_000, least=20, percent=25, seed=7):
    def counts(texts):
        held = [0] * buckets
        for t in texts:
            for f in features(t)[1]:
                held[zlib.crc32(f.encode()) % buckets] += 1
        return held

    s, t = counts(x for _, x in rows), counts(cases)
    gains = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for key, text in rows:
        words, found = features(text)
        weight = sum(gains[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(eligible[: len(eligible) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_buckets_are_those_of_crc32():
    texts = ["Two words", "", None, "ÉTÉ a-b  x_y 12", "w" * 200 + " " + "v" * 64 + " " + "u" * 65, "one"]
    words, pairs, together, first = resampling.hashed_runs(pa.array(texts), 997)
    named = [features(t)[0] for t in texts]
    flat = [w for ws in named for w in ws]
    assert words.tolist() == [zlib.crc32(w.encode()) % 997 for w in flat]
    assert first.tolist() == np.concatenate([[0], np.cumsum([len(ws) for ws in named])]).tolist()
    inside = [zlib.crc32(f"{a} {b}".encode()) % 997 for ws in named for a, b in zip(ws, ws[1:], strict=False)]
    assert pairs[together].tolist() == inside


def test_edges(edges, edge_rows, spark):
    cases = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "w1 w2 w3 w4")], "case_id int, prompt string")
    found = resampling.resample_prompts(edges, cases, min_words=2, percent=60)
    assert found.columns == ["prompt_id", "n_features", "weight", "score", "rank"]
    assert order(map(tuple, found.collect())) == order(brute(edge_rows, ["alpha beta gamma", None, "w1 w2 w3 w4"], least=2, percent=60))


def test_no_cases_and_empty_table(edges, edge_rows, nothing, spark):
    cases = spark.createDataFrame([], "case_id int, prompt string")
    assert order(map(tuple, resampling.resample_prompts(edges, cases, min_words=1).collect())) == order(brute(edge_rows, [], least=1))
    assert resampling.resample_prompts(nothing, cases).count() == 0
    assert all(r.rank is None for r in resampling.resample_prompts(edges, cases, min_words=10**9).collect())


@pytest.mark.parametrize("block,bits", [(7, 2), (64, 11), (1 << 17, 5)])
def test_radix_order(spark, block, bits):
    rng = random.Random(block)
    rows = [(rng.choice([-5, 0, 3, 3, 9000, -70000, None]), rng.choice([None, 0, rng.randrange(-(2**63), 2**63), rng.randrange(300)]), i) for i in range(2500)]
    frame = spark.createDataFrame(rows, "a long, b long, digit int").repartition(5)
    fields = [radix.Field("a", descending=True), radix.Field("b")]
    found = radix.sorted_positions(frame, fields, Scratch(spark, "test"), block_rows=block, digit_bits=bits).orderBy("position").collect()
    assert [r.position for r in found] == list(range(2500))
    expected = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0))
    assert [(r.a, r.b) for r in found] == [r[:2] for r in expected]
    assert sorted(r.digit for r in found) == list(range(2500))


def test_radix_of_equal_rows_and_of_none(spark):
    same = spark.range(900).select(F.lit(4).alias("a"))
    found = radix.sorted_positions(same, [radix.Field("a")], Scratch(spark, "test"), block_rows=50)
    assert sorted(r.position for r in found.collect()) == list(range(900))
    assert radix.sorted_positions(same.where("false"), [radix.Field("a")], Scratch(spark, "test")).count() == 0


def test_digits_skip_what_all_rows_share(spark):
    rows = spark.range(1000, 1256).withColumn("score", F.lit(-7))
    assert [d.bits for d in radix.digits_of(rows, [radix.Field("score", True), radix.Field("id")], 11)] == [8]
    assert [d.bits for d in radix.digits_of(rows, [radix.Field("id")], 3)] == [3, 3, 2]


def test_passes_leave_no_tables_behind(spark):
    scratch = Scratch(spark, "test")
    radix.sorted_positions(spark.range(50).withColumnRenamed("id", "a"), [radix.Field("a")], scratch, digit_bits=2)
    assert [scratch.exists(f"pass{i}") for i in range(4)] == [False, False, False, True]
