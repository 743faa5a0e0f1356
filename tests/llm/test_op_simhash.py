import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pleonasm.llm import simhash as S


def plain_fingerprint(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints):
    """Smallest member of each component of distance three or less."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = components(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints, strict=True)), key=str)


def test_edges(edges, edge_rows):
    found = S.near_duplicate_prompts(edges).collect()
    assert sorted(map(tuple, found), key=str) == expected(edge_rows)


def test_query_against_all_pairs(spark, duck, folder):
    from pleonasm.llm.catalog import QUERIES

    found = QUERIES["op5_near_duplicate_prompts"](spark, folder).collect()
    assert sorted(map(tuple, found), key=str) == expected(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("most", [20_000, 5])
def test_links_connect_what_pairs_connect(spark, most):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = set()
    for c in centres:
        for _ in range(15):
            p = c
            for _ in range(rng.randrange(6)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    links = S.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), most=most).collect()
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        assert ((u ^ v) & (1 << 64) - 1).bit_count() <= 3
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    groups = {}
    for p in prints:
        groups.setdefault(find(int(np.uint64(p).astype(np.int64))), set()).add(p)
    wanted = {}
    for p, r in components(prints).items():
        wanted.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_a_linked_pair_shares_a_posting(value, flips):
    other = value
    for f in flips:
        other ^= 1 << f
    assert any((value ^ other) & (S._mask(t) & (1 << 64) - 1) == 0 for t in S.TRIPLES)


def test_a_dense_group_gives_few_links():
    members = np.array([1 << i for i in range(62)] + [0], dtype=np.int64)
    assert len(S.spanning_links(members)) == 62


def test_empty_table(nothing):
    assert S.near_duplicate_prompts(nothing).count() == 0
