import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pleonasm.llm import hard_negatives as H


def brute(rows, every, positives=5, negatives=10, low=30, high=90, scale=256):
    good = [(k, lab, tuple(math.floor(scale * x) for x in v)) for k, v, lab in rows if k is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({r for r in good if r[0] % every == 0}, key=str):
        scored = [(sum(a * b for a, b in zip(anchor[2], v, strict=True)), k, lab) for k, lab, v in good if k != anchor[0] and len(v) == len(anchor[2])]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, pid, _ in [s for s in scored if s[2] == anchor[1]][:positives]:
            window = [s for s in scored if s[2] != anchor[1] and low * ps <= 100 * s[0] <= high * ps][:negatives]
            out += [(anchor[0], pid, n, nid, ps, ns) for n, (ns, nid, _) in enumerate(window, 1)]
    return sorted(out)


def frame(spark, rows, extra="id long, anchor long, score string, block string, row string"):
    names = [c.split()[0] for c in extra.split(", ")]
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], f"prompt_id long, vector array<double>, prompt_type string, {extra}").repartition(4)


def mined(df, every, **more):
    found = H.mine_hard_negatives(df, F.col("prompt_id") % every == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, [rng.gauss(0.3, 1) for _ in range(6)], rng.choice("abc")) for i in range(400)]
    out += [(1000 + i, [0.5] * 6, rng.choice("ab")) for i in range(150)]  # one common vector: ties
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_against_brute_force(spark, rows, block):
    expected = brute(rows, 20)
    assert mined(frame(spark, rows), 20, block_anchors=block) == expected and len(expected) > 500


def test_other_limits(spark, rows):
    expected = brute(rows, 50, positives=2, negatives=3, low=-50, high=100)
    assert mined(frame(spark, rows), 50, positives=2, negatives=3, low=-50, high=100) == expected and expected


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.5, 0.0], "b"), (3, [0.5, 0.0], "b"), (4, [0.5, 9.0], None), (5, None, "b"),
        (6, [0.6, None], "b"), (7, [0.6, float("nan")], "b"), (8, [float("inf"), 0.0], "b"), (None, [0.6, 0.0], "b"), (9, [0.6, 0.0, 0.0], "b"), (10, [], "a"), (11, [], "b"),
        (20, [], "b"), (12, [0.0, 0.0], "a"), (13, [0.0, 1.0], "b"), (14, [0.9, 0.1], "b"), (30, [0.0, 0.0], "b"), (-10, [-1.0, 0.0], "a"),
    ]
    expected = brute(rows, 10)
    assert mined(frame(spark, rows), 10) == expected
    assert (0, 2, 2, 3, 65536, 32768) in expected and any(r[4] == 0 and r[0] == 20 for r in expected)
    assert mined(frame(spark, rows), 1000) == brute(rows, 1000)
    assert mined(frame(spark, rows).where("prompt_id > 0"), 1000) == []
    assert mined(frame(spark, rows).where("false"), 10) == []


def test_scores_too_long_for_doubles_are_exact():
    table = pa.table({"id": [1], "label": ["a"], "vector": pa.array([[2.0**28, 3.0]], pa.list_(pa.float64()))})
    block = H.Block(table, 1.0)
    assert block.scores(np.array([2.0**30, 5.0, 2.0**60, 0.0]), np.array([2, 2])).tolist() == [[2**58 + 15, 2**63 - 1]]


def test_keys_sort_as_they_should():
    order = [(0, 9, False, 5), (0, 9, True, -3), (0, 9, True, 4), (0, -2, False, 1), (1, 2**63 - 1, True, 0), (1, -(2**63) + 1, True, 0)]
    packed = [H.pair_key(*k) for k in order]
    assert packed == sorted(packed)


def test_stream_holds_windows_of_one_anchor_only():
    pairs = [(H.pair_key(0, 100, False, 1), None)] + [(H.pair_key(0, 90 - i, True, 10 + i), None) for i in range(4)] + [(H.pair_key(1, 50, True, 9), None)]
    assert list(H.open_windows(iter(pairs), 30, 90, 2)) == [(0, 1, 1, 10, 100, 90), (0, 1, 2, 11, 100, 89)]
