"""Where work is done: by all tasks, once, and in as many steps as the input has rows."""

import re

import pytest
from pyspark.sql import functions as F

from pleonasm.catalog import load
from pleonasm.operators import dedupe, features, similarity


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["scored_candidates", "repeated_ngrams", "candidate_gate", "prompt_features"])
def test_no_text_is_searched_by_the_tasks_that_read_the_file(spark, folder, name):
    plan = plan_of(load()[name].build(spark, folder))
    below = re.findall(r"RoundRobinPartitioning.*?(?:FileScan|ReusedExchange)", plan, re.S)
    assert below and not any("regexp" in part for part in below)


def test_ngrams_of_all_sizes_take_a_text_apart_once(spark, folder):
    plan = plan_of(load()["repeated_ngrams"].build(spark, folder))
    assert plan.count("FileScan") == 1


def test_ngrams_of_all_sizes_are_those_of_each_size(spark):
    texts = ["a b c a b c a b c d", "x x x x x x", "one", "", None, "a b. a b, c a b c", "had had __PROTECTED_1__ a __PROTECTED_1__ a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    rows = lambda found: sorted(tuple(r) for r in found.select("k", "n", "ngram", "first_pos", "times").collect())
    each = [r for n in range(2, 11) for r in rows(dedupe.repeated_ngrams(df, ["k"], n).withColumn("n", F.lit(n)))]
    assert rows(dedupe.repeated_ngrams_of_sizes(df, ["k"], 2, 10)) == sorted(each) != []


def test_a_prompt_is_turned_to_lower_case_once(spark):
    df = spark.createDataFrame([("Refund for Order ID 7 now",)], "text string")
    found = features.with_prompt_features(df)
    assert plan_of(found).count("lower(text") == 1
    assert "_low" not in found.columns


def test_neighbours_are_found_by_products_of_matrices(spark):
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(60)] + [(60, None), (61, [1.0, None])], "id long, v array<double>")
    found = similarity.nearest_neighbours(vectors, vectors.filter("id % 20 = 0"), "id", "v", 3, block_rows=2)
    assert "NestedLoop" not in plan_of(found)
    # Equal vectors come by their key, the query itself is left out.
    assert sorted(tuple(r) for r in found.collect()) == [(q, n, 1.0, p) for q, near in ((0, (5, 10, 15)), (20, (0, 5, 10)), (40, (0, 5, 10))) for p, n in enumerate(near, 1)]


@pytest.mark.parametrize("name", ["cluster_pairs", "sentence_clusters", "related_sentences"])
def test_joins_of_sentences_read_written_sets(spark, folder, name):
    # All uses of the texts are behind the written sets.
    plan = plan_of(load()[name].build(spark, folder))
    assert "FileScan" not in plan and "ExistingRDD" in plan


@pytest.mark.parametrize("name", ["scored_candidates", "budgeted_selection"])
def test_candidates_are_worked_out_once(spark, folder, name):
    # Each operator of a plan stands on a line of its own; the search for tokens is in one of them only.
    plan = plan_of(load()[name].build(spark, folder))
    operators = re.split(r"\n[ :]*(?:[+:]- )?(?=\*?\(?\d*\)? ?(?:Project|Filter|Generate|Exchange|ArrowEvalPython))", plan)
    assert sum("repeated_paragraph, candidate_type" in part or "candidate_type, repeated_paragraph" in part for part in operators) == 1


def test_long_sentences_are_read_from_their_ends(monkeypatch):
    from pleonasm.operators import selection

    words = ["word"] * 8000
    text, read, stands = " ".join(["We", *words, "end."]), [], selection.sentence_stands
    monkeypatch.setattr(selection, "sentence_stands", lambda s: read.append(len(s)) or stands(s))
    cuts = [{"start": 8 + 5 * i, "end": 12 + 5 * i, "tokens_saved": 1, "utility": 1.0} for i in range(0, 7990, 10)]
    picked, left = selection.chosen_cuts(text, cuts, 1000)
    assert len(picked) == len(cuts) and sum(read) < 3 * len(text) * 8


def test_ends_of_a_sentence_tell_as_much_as_all_of_it(spark):
    import random

    from pleonasm.operators import selection

    rng = random.Random(3)
    pool = ["the", "of", "and", "Please", "word", "do", "not", "12%", "__PROTECTED_7__", "x:", "-", "İ", "K", "it's", "must", "Notes:", " ", "é,", "by", "to"]
    for n in range(3000):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", ", ", "  ", ","]) for _ in range(rng.choice([5, 150, 400])))
        spots = sorted(rng.sample(range(len(text) + 1), 2 * rng.randrange(0, min(8, len(text) // 2))))
        cut = list(zip(spots[::2], spots[1::2]))
        a, b = sorted(rng.sample(range(len(text) + 1), 2))
        lo = next((i for i, c in enumerate(cut) if c[1] > a), len(cut))
        left = "".join(text[i] for i in range(a, b) if not any(s <= i < e for s, e in cut))
        assert selection._stands_by_its_ends(text, a, b, cut, lo) == selection.sentence_stands(left), (text, a, b, cut)


@pytest.mark.parametrize("name", ["fact_duplicates", "theme_lines", "fused_warnings"])
def test_what_several_joins_read_is_written_once(spark, folder, name):
    plan = plan_of(load()[name].build(spark, folder))
    assert "FileScan" not in plan and "ExistingRDD" in plan
