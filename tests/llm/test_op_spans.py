import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pleonasm.llm import batches as B
from pleonasm.llm import spans as S

SPLIT = "[^\x20\x09-\x0d]+"


def brute(rows, k):
    words = [re.findall(SPLIT, t or "") for _, t in rows]
    count = {}
    for w in words:
        for i in range(len(w) - k + 1):
            window = tuple(w[i : i + k])
            count[window] = count.get(window, 0) + 1
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((key, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("window,block", [(35, 8 << 20), (35, 4000), (3, 4000), (1, 1 << 20)])
def test_edges(edges, edge_rows, window, block):
    found = S.remove_repeated_spans(edges, window=window, block_bytes=block).select("prompt_id", "text", "n_words", "n_removed").collect()
    assert ordered(map(tuple, found)) == ordered(brute(edge_rows, window))


def test_intervals_are_maximal(spark):
    passage = " ".join(f"p{i}" for i in range(8))
    rows = [(1, f"a b {passage} c"), (2, f"{passage} d {passage}"), (3, "nothing here")]
    found = S.remove_repeated_spans(spark.createDataFrame(rows, "prompt_id long, text string"), window=4)
    spans = {r.prompt_id: [tuple(s) for s in r.spans] for r in found.collect()}
    assert spans == {1: [(2, 10)], 2: [(0, 8), (9, 17)], 3: []}


def test_many_blocks_agree_with_one(spark):
    rng = random.Random(1)
    passages = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(50)) for _ in range(20)]
    rows = [(i, " ".join(rng.choice([rng.choice(passages), f"u{i} v{rng.random()}"]) for _ in range(4))) for i in range(200)]
    prompts = spark.createDataFrame(rows, "prompt_id long, text string").repartition(4)
    found = S.remove_repeated_spans(prompts, window=35, block_bytes=3000).select("prompt_id", "text", "n_words", "n_removed").collect()
    assert ordered(map(tuple, found)) == ordered(brute(rows, 35))


def test_empty_table(nothing):
    assert S.remove_repeated_spans(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1c\x85\xa0aé🤦b", max_size=12)), max_size=6), st.integers(0, 3))
def test_words_of_a_batch(texts, cut):
    column = pa.array(texts, pa.string()).slice(min(cut, len(texts)))
    data, offsets = B.text_bytes(column)
    starts, ends, first = B.words(data, offsets)
    for i, t in enumerate(column.to_pylist()):
        found = [data[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert found == re.findall(SPLIT, t or "")


def test_hashes_depend_on_the_word_alone():
    column = pa.array(["x" * n + " " + "y" * n for n in range(1, 90)] + ["yyy x" + " " + "x" * 80])
    data, offsets = B.text_bytes(column)
    starts, ends, _ = B.words(data, offsets)
    hashes = {}
    for a, b, h in zip(starts, ends, B.word_hashes(data, starts, ends).tolist(), strict=True):
        assert hashes.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(hashes.values())) == len(hashes)


@pytest.mark.parametrize("k", [1, 2, 3, 8, 10, 35])
def test_window_hashes_are_rabin_karp(k):
    values = np.random.default_rng(0).integers(0, 1 << 63, 100, dtype=np.int64).astype(np.uint64)
    plain = [sum(int(h) * pow(B._BASE, k - 1 - j, 1 << 64) for j, h in enumerate(values[i : i + k])) % (1 << 64) for i in range(len(values) - k + 1)]
    assert B.window_hashes(values, k).tolist() == B._mix(np.array(plain, dtype=np.uint64)).tolist()


def test_packed_hashes_come_back():
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    assert (S._unpack(S._pack(values)) == values).all()
