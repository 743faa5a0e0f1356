import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pleonasm.llm import quality as Q


def corpus(n):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdklmnprst" for b in "aeiou" for c in "nrstl"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        if not good:
            text = [rng.choice([w + "$$$", w.upper() + "!!", w]) for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(good)))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark):
    rows, labels = corpus(600)
    return spark.createDataFrame(rows, "prompt_id long, text string").repartition(4), spark.createDataFrame(labels + [(None, 1), (7, None), (10**9, 1)], "prompt_id long, quality int"), dict(labels)


def test_held_out_rows_are_told_apart(frames):
    prompts, labels, truth = frames
    found = Q.score_quality(prompts, labels).collect()
    assert len(found) == 600
    held = [r for r in found if r.held_out]
    assert {r.prompt_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.prompt_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_labels_of_held_out_rows_do_not_matter(spark, frames):
    prompts, labels, truth = frames
    turned = [(i, v if zlib.crc32(str(i).encode()) % 5 else 1 - v) for i, v in truth.items()]
    other = Q.learn_quality(prompts, spark.createDataFrame(turned, "prompt_id long, quality int"))
    same = Q.learn_quality(prompts.repartition(2), labels)
    assert (other.weights == same.weights).all() and other.bias == same.bias


def test_the_solver_reaches_the_optimum_of_the_dual():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(40)]
    labels = np.array([1 if 3 in s else 0 for s in sets])
    w, bias = Q.fit_svm(sets, labels, np.ones(12), cost=1.0, epochs=2000)

    def loss(w, bias):
        sides = np.where(labels > 0, 1, -1)
        weight = np.where(labels > 0, 40 / (2 * labels.sum()), 40 / (2 * (labels == 0).sum()))
        margins = np.array([w[s].sum() / 2 + bias for s in sets])
        return 0.5 * (w @ w + bias * bias) + (weight * np.maximum(0, 1 - sides * margins)).sum()

    best = loss(w, bias)
    for _ in range(300):
        step = rng.normal(size=13) * 0.02
        assert loss(w + step[:12], bias + step[12]) > best - 1e-3


def test_log_count_ratio_leans_to_the_class():
    ratio = Q.log_count_ratio(np.array([9.0, 0, 3]), np.array([0.0, 9, 3]))
    assert ratio[0] > 0 > ratio[1] and abs(ratio[2]) < 0.3


def test_runs_of_a_word():
    sets = list(Q.ngram_sets(pa.array(["a b c d", "a a b", "x " * 9, None, ""])))
    runs = [[int(g) - (2 << Q.BITS) for g in s if g >= 2 << Q.BITS] for s in sets]
    assert runs == [[], [0], [0, 1, 2], [], []] and len(sets[3]) == 0


def test_edges(frames, edges, nothing, edge_rows):
    _, labels, _ = frames
    found = Q.score_quality(edges, labels.withColumnRenamed("quality", "good"), label="good").collect()
    assert len(found) == len(edge_rows) and all(r.score is not None for r in found)
    assert len({r.score for r in found if r.prompt_id in (1, 2)}) == 1
    assert [r.held_out for r in found if r.prompt_id is None] == [False, False]
    assert Q.score_quality(nothing, labels).count() == 0
    assert len({r.score for r in Q.score_quality(edges, labels.where("false")).collect()}) == 1


def test_query_on_held_out_documents(spark, duck):
    from pleonasm.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op10_score_quality"](spark, folder).collect()}
    truth = dict(duck.execute(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    held = [i for i in truth if found[i].held_out]
    assert {i for i in found if found[i].held_out} == {i for i in found if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([found[i].predicted == truth[i] for i in held]) > 0.93
    good = [i for i in held if truth[i]]
    assert np.mean([found[i].predicted for i in good]) > 0.95
