"""Searches that are left out where they can find nothing, and forms made without replacing."""

import random

from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions import signals, text as T
from pleonasm.operators import dedupe, facts, features, gates

WORDS = (
    "six sixteen twenty-eight hundred percent PERCENT 83% $1,200.50 dollars 12 ms 28 Milliseconds 5 MINUTES 2024-01-02 Sept 3, 1998 10/12/2024 9:30 PM nine thirty am "
    "ORD-17 us-east-1 a_b x@y.com HTTPS://a.b/c cusip 0378 10-K T+2 bb+ baa2 A/R X-chromosome tnf-alpha __PROTECTED_0__ Clause 4.2 sk-aaaaaaaaaaaaaaaaaaaa {a} [b] <b> </b> ` ``` \" ' = y "
    "was migrated successfully İ K ſ the and . ! ? : \n"
).split(" ")


def texts(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "", ", ", "-"]) for _ in range(rng.choice([1, 3, 9, 25]))) for _ in range(3000)]
    return spark.createDataFrame([(t,) for t in [*rows, "", " ", None]], "text string")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_pattern_needs_what_every_match_of_it_holds(spark):
    text, low = F.col("text"), F.lower("text")
    every = [*zip(L.LIGHT_FACT_PATTERNS, L.LIGHT_FACT_NEEDS, strict=True), *zip([p for _, p in L.FACT_PATTERNS], L.FACT_NEEDS, strict=True)]
    left_out = [F.count_if(text.rlike(f"(?i){p}") & ~T.holds(text, low, needed)) for p, needed in every]
    found = [F.count_if(text.rlike(f"(?i){p}")) for p, _ in every]
    got = texts(spark).agg(F.array(*left_out), F.array(*found)).first()
    assert not any(got[0]) and sum(n > 0 for n in got[1]) > 30


def test_facts_are_searched_for_where_they_can_be(spark):
    df = texts(spark)
    for found in (signals.light_facts(F.col("text")), facts.sensitive_facts(F.col("text"))):
        plan = plan_of(df.select(found.alias("f")))
        assert plan.lower().count("contains(") > 10
    direct = F.flatten(F.array(*[T.find_all(F.col("text"), f"(?i){p}") for p in L.LIGHT_FACT_PATTERNS]))
    both = df.select(direct.alias("direct"), F.flatten(T.find_all_of(F.col("text"), L.LIGHT_FACT_PATTERNS, L.LIGHT_FACT_NEEDS)).alias("found"))
    assert both.filter(~F.col("direct").eqNullSafe(F.col("found"))).count() == 0


def test_normal_forms_are_put_together_from_words(spark):
    df, text = texts(spark), F.col("text")
    forms = {
        "squeeze": (T.squeeze(text), T.strip(F.regexp_replace(F.lower(text), r"\s+", " "))),
        "bare": (T.bare_words(text), F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9$%]+", " "))),
        "key": (dedupe.KEYS["bare"](text), T.strip(F.regexp_replace(F.lower(text), r"[^a-z0-9$%_]+", " "))),
    }
    for new, old in forms.values():
        assert df.filter(~new.eqNullSafe(old)).count() == 0
        assert "regexp_replace" not in plan_of(df.select(new))
    assert "[^a-z0-9$%]+" not in plan_of(features.with_prompt_features(df))


def test_runs_of_words_are_taken_by_their_place(spark):
    df = spark.createDataFrame([("a b c d a b c",), ("a b",), ("a",), ("",)], "text string")
    assert "slice(" not in plan_of(df.select(gates.similarity(F.col("text"), F.lit("a b c x")).alias("s")))
    runs = [r[0] for r in df.select(T.word_runs(T.find_all(F.col("text"), r"\S+"), 3)).collect()]
    assert runs == [["a b c", "b c d", "c d a", "d a b"], ["a b"], ["a"], []]
