"""Invariants of the corpus job: nothing grows, nothing is lost, no prompt sees another."""

import pytest
from pyspark.sql import functions as F

from pleonasm.operators import facts
from pleonasm.operators import frames
from pleonasm.plans.compress import compress_corpus, restatements
from pleonasm.sources.tables import Tables

RESTATED = "The ACT is easier than the SAT. The SAT is harder than the ACT."
OPPOSED = "The ACT is easier than the SAT. The SAT is easier than the ACT."


@pytest.fixture(scope="module")
def done(spark, folder):
    t = Tables(spark, folder)
    support = t.derived("support_prompts").filter("prompt_id < 60").select(F.concat(F.lit("s"), "prompt_id").alias("id"), "text")
    chunked = t.derived("chunk_prompts").filter("prompt_id < 40").select(F.concat(F.lit("c"), "prompt_id").alias("id"), "text")
    single = spark.createDataFrame([("restated", RESTATED), ("restated-again", RESTATED), ("opposed", OPPOSED)], "id string, text string")
    prompts = support.unionByName(chunked).unionByName(single)
    return compress_corpus(prompts, "id").join(prompts, "id").cache()


def test_every_prompt_comes_back_once(done):
    assert done.count() == done.select("id").distinct().count() == 103


def test_tokens_never_grow(done):
    assert done.filter("optimized_tokens > original_tokens").count() == 0
    assert done.filter("accepted AND optimized_tokens >= original_tokens").count() == 0


def test_rejected_prompts_keep_their_text(done):
    assert done.filter("NOT accepted AND final_text <> text").count() == 0


def test_no_fact_is_lost(done):
    lost = facts.missing_facts(facts.sensitive_facts(F.col("text")), facts.sensitive_facts(F.col("final_text")), F.col("final_text"))
    assert done.filter(F.size(lost) > 0).count() == 0


def test_support_prompts_shrink(done):
    totals = done.filter("stage = 'support'").agg(F.sum("original_tokens").alias("a"), F.sum("optimized_tokens").alias("b")).first()
    assert totals.b < totals.a


def test_claims_restated_and_opposed(done):
    texts = {row.id: row.final_text for row in done.filter("id IN ('restated', 'restated-again', 'opposed')").collect()}
    assert texts["opposed"] == OPPOSED
    # A copy under another id changes nothing for the first one.
    assert texts["restated"] == texts["restated-again"]


CHAIN = [
    "The nightly import copies invoices ledgers receipts refunds quickly.",
    "The nightly import copies ledgers receipts refunds vouchers quickly.",
    "The nightly import copies receipts refunds vouchers contracts quickly.",
    "The nightly import copies refunds vouchers contracts statements quickly.",
    "The nightly import copies vouchers contracts statements orders quickly.",
]
SAME_WORDS = ["The planner sorts open tasks.", "The planner really sorts the open tasks.", "The planner is sorting open tasks."]
OTHER = ["Probe P-7 is active.", "Probe P-7 is not active.", "Nothing else matters in this paragraph today."]


@pytest.fixture(scope="module")
def notes(spark, folder):
    own = [("chain", i, s) for i, s in enumerate(CHAIN)] + [("same", i, s) for i, s in enumerate(SAME_WORDS)] + [("other", i, s) for i, s in enumerate(OTHER)]
    rows = spark.createDataFrame(own, "prompt_id string, pos int, sentence string")
    t = Tables(spark, folder)
    for name in ("claim_notes", "status_notes", "frame_notes"):
        part = t.derived(name).filter("prompt_id < 40").select(F.concat(F.lit(name), "prompt_id").alias("prompt_id"), F.col("pos").cast("int").alias("pos"), "sentence")
        rows = rows.unionByName(part)
    return rows.cache()


@pytest.fixture(scope="module")
def found(notes):
    return restatements(notes, ["prompt_id"]).cache()


@pytest.fixture(scope="module")
def left(notes, found):
    """What `drop_restatements` leaves, from removals that were computed once."""
    return notes.join(found.select("prompt_id", "pos").distinct(), ["prompt_id", "pos"], "left_anti").cache()


def test_each_removed_sentence_has_one_that_stays_and_loses_nothing(notes, found, left):
    assert found.count() > 0
    kept = found.join(left.select("prompt_id", F.col("pos").alias("kept_pos"), F.col("sentence").alias("keeper")), ["prompt_id", "kept_pos"])
    assert kept.count() == found.count()
    judged = kept.join(notes, ["prompt_id", "pos"]).select(frames.signature(F.col("sentence")).alias("a"), frames.signature(F.col("keeper")).alias("b"))
    assert judged.filter(F.size(frames.removal_reasons(F.col("a"), F.col("b"))) > 0).count() == 0


def test_a_chain_of_near_copies_does_not_collapse(left):
    left = {(r.prompt_id, r.sentence) for r in left.collect()}
    chain = [s for s in CHAIN if ("chain", s) in left]
    words = {w for s in chain for w in s.rstrip(".").split()}
    assert len(chain) >= 2 and {"invoices", "orders"} <= words
    assert [s for s in SAME_WORDS if ("same", s) in left] == SAME_WORDS[:1]
    assert all(("other", s) in left for s in OTHER)
