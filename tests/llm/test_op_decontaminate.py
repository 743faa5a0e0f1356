import random
import re

import pytest

from pleonasm.llm import decontaminate as D

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(WORD, (text or "").translate(lower))


def brute(rows, items, n):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, 1)):
            if w:
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (window := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[window]
        out.append((str(key), len(w), len(hit), tuple(sorted(str(f) for f in found if f is not None))))
    return sorted(out)


def result(found):
    return sorted((str(r.prompt_id), r.n_words, r.n_hit, tuple(r.items)) for r in found.collect())


def frames(spark, rows, items):
    return spark.createDataFrame(rows, "prompt_id long, text string"), spark.createDataFrame(items, "case_id long, prompt string")


def test_random_texts_of_few_words(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("ab") + rng.choice(["", ".", "É", "9"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 6, 9]))) for i in range(12)] + [(50, None), (51, "..."), (None, "zz zz"), (3, "q q q")]
    rows = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    prompts, benchmark = frames(spark, rows, items)
    found = D.find_benchmark_passages(prompts, benchmark, window=6, shingle=3)
    assert result(found) == brute(rows, items, 6)


@pytest.mark.parametrize("block_rows", [200_000, 7])
def test_passages_at_borders_and_overlaps(spark, block_rows):
    item = " ".join(f"w{i}" for i in range(25))
    parts = item.split()
    rows = [
        (1, item), (2, " ".join(parts[:10])), (3, " ".join(parts[-10:])), (4, " ".join(parts[:9])), (5, "x " + " ".join(parts[5:15]) + " y " + " ".join(parts[6:17])),
        (6, "W0, W1; w2. w3 w4 w5 w6 w7 w8 w9"), (7, None), (8, ""), (9, " ".join(parts[:5] + parts[6:12])),
    ]
    items = [(7, item), (8, item), (70, " ".join(parts[3:14]))]
    prompts, benchmark = frames(spark, rows, items)
    found = D.find_benchmark_passages(prompts, benchmark, block_rows=block_rows)
    assert result(found) == brute(rows, items, 10)


def test_edges(spark, edges, edge_rows, nothing):
    items = [(1, " ".join(f"w{i}" for i in range(5, 30))), (2, "refund the order"), (3, "one"), (4, "alpha beta gamma alpha beta")]
    _, benchmark = frames(spark, [(1, "")], items)
    found = D.find_benchmark_passages(edges, benchmark)
    assert result(found) == brute(edge_rows, items, 10)
    assert D.find_benchmark_passages(nothing, benchmark).count() == 0
    assert result(D.find_benchmark_passages(edges, benchmark.where("false"))) == brute(edge_rows, [], 10)


def test_no_python_in_the_plan(spark):
    prompts, benchmark = frames(spark, [(1, "a b")], [(1, "a b")])
    plan = D.find_benchmark_passages(prompts, benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|ArrowEval|Pandas", plan)
