"""Round trips, idempotence, skew and the few patterns the other engine cannot run."""

from pyspark.sql import functions as F

from pleonasm.operators import analytics, dedupe, facts, features, rows, selection, similarity
from pleonasm.sources import messages
from pleonasm.sources.tables import Tables


def test_mask_and_restore_round_trip(spark, folder):
    texts = [
        "Use `x = 1` and ```python\nprint('SUP-44891')\n``` on 2026-06-25.",
        '{"id":"ORD-900184","amount":"$749"} costs $749 or 20% of $10,000.',
        "Visit https://example.com or email ops@example.com, Clause 4.2 applies to BW-HIPAA-7741.",
        "Keep y = x^2 - x - 23 unchanged. \"Take one tablet daily\" must remain.",
        "<root><id>SUP-44891</id></root> said $x + y$ twice.",
        "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    masked = facts.with_masked_text(df)
    back = masked.select("text", "masked", facts.restored(F.col("masked"), F.col("regions")).alias("back")).collect()
    assert all(r.back == r.text for r in back)
    assert all("SUP-44891" not in r.masked and "ORD-900184" not in r.masked for r in back)
    documents = facts.with_masked_text(Tables(spark, folder).documents)
    assert documents.filter(facts.restored(F.col("masked"), F.col("regions")) != F.col("text")).count() == 0


def test_fact_kinds_that_need_their_own_engine(spark):
    df = spark.createDataFrame([("a", "Rule $x + y$ and y = x + 2 must hold.")], "id string, text string")
    kinds = {r.kind: r.value for r in facts.typed_facts(df, ["id"]).collect()}
    assert kinds["latex"] == "$x + y$"
    assert kinds["equation"] == "y = x + 2"


def test_keep_first_is_idempotent(spark, folder):
    once = dedupe.with_kept_sentences(Tables(spark, folder).documents.select("doc_id", "text"))
    twice = dedupe.with_kept_sentences(once.select("doc_id", F.col("kept_text").alias("text")))
    assert once.filter("dropped_sentences > 0").count() > 0
    assert twice.filter("dropped_sentences > 0").count() == 0


def test_scope_does_not_leak(spark):
    text = "One line here. Another line here."
    df = spark.createDataFrame([(1, text), (2, text)], "id int, text string")
    assert {r.kept_text for r in dedupe.with_kept_sentences(df).collect()} == {text}


def test_hot_key_ordinals_match_a_plain_count(spark):
    rows_ = spark.range(3000).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"),
    )
    done = analytics.hit_ordinals(rows_, "key", "ts", "request_id").filter("key = 'hot'")
    assert [r.hits_so_far for r in done.orderBy("ts").collect()] == list(range(1000))
    assert done.filter("gap_us IS NULL").count() == 1
    assert done.filter("gap_us <> 3 * 97 * 1000000").count() == 0


def test_similar_sets_match_brute_force(spark):
    words = spark.range(120).select(
        F.lit("t").alias("scope"),
        F.col("id").cast("int").alias("pos"),
        F.array_sort(
            F.array_distinct(F.array(*[F.concat(F.lit("w"), (F.col("id") * a + b) % m) for a, b, m in ((1, 0, 5), (3, 1, 7), (1, 2, 4), (5, 3, 9), (2, 1, 6))]))
        ).alias("tokens"),
    )
    sets = similarity.distinct_sets(words, ["scope"], "tokens", ["pos"])
    found = similarity.similar_sets(sets, ["scope"], "tokens", ["pos"], 0.6, similarity.set_score() >= 0.6)
    pairs = {(r.a.pos, r.b.pos) for r in found.collect()}
    local = [(r.pos, set(r.tokens)) for r in sets.collect()]
    expected = set()
    for p, a in local:
        for q, b in local:
            if p < q:
                both = len(a & b)
                if max(0.82 * both / min(len(a), len(b)), both / len(a | b)) >= 0.6:
                    expected.add((p, q))
    assert pairs == expected and expected


def test_greedy_spans_match_a_loop(spark):
    data = [(k, s, s + 5 + (s * 7) % 11, (s * 13) % 17) for k in range(3) for s in range(0, 60, 4)]
    df = spark.createDataFrame(data, "k int, start int, end int, rank int")
    got = {(r.k, r.start, r.end) for r in selection.greedy_spans(df, ["k"], "rank").collect()}
    expected = set()
    for k in range(3):
        chosen = []
        for _, start, end, _rank in sorted((x for x in data if x[0] == k), key=lambda x: (-x[3], x[1], x[2])):
            if all(end <= s or e <= start for s, e in chosen):
                chosen.append((start, end))
        expected |= {(k, s, e) for s, e in chosen}
    assert got == expected


def test_budget_is_respected(spark, folder):
    from pleonasm.catalog import load

    assert load()["budgeted_selection"].build(spark, folder).filter("tokens_saved <= 0").count() == 0


def test_small_model_is_not_priced_as_strong(spark):
    from pleonasm.operators import cost

    df = spark.createDataFrame([("openai", "gpt-4o-mini"), ("openai", "gpt-4o"), ("gemini", None), ("dry-run", "x")], "provider string, model string")
    keys = [r.price_key for r in df.select(cost.price_key(F.col("provider"), F.col("model")).alias("price_key")).collect()]
    assert keys == ["openai-small", "openai-strong", "gemini-flash", "dry-run"]


def test_json_validity(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("```json\n{broken\n```",), ("no block",)], "text string")
    assert [r.ok for r in df.select(features.json_blocks_valid(F.col("text")).alias("ok")).collect()] == [True, False, True]


def test_trace_and_summary_sinks(spark, folder, tmp_path):
    traces = Tables(spark, folder).derived("trace_log")
    messages.write_traces(traces, str(tmp_path / "traces"))
    back = spark.read.parquet(str(tmp_path / "traces"))
    assert back.count() == traces.count() and "day" in back.columns
    report = analytics.robustness_table(traces)
    messages.write_summary(report, str(tmp_path / "summary"))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == report.count()


def test_text_clean_up_steps(spark):
    df = spark.createDataFrame([("Why is it so  , , then",)], "text string")
    row = df.select(rows.planned_cleanup(F.col("text")).alias("p"), rows.break_before_headers(F.lit("Done. Task: go")).alias("h")).first()
    assert row.p.endswith("?") and row.h == "Done.\n\nTask: go"


def test_neighbours_do_not_depend_on_the_block(spark, folder):
    vectors = Tables(spark, folder).embeddings
    queries = vectors.filter("vec_id % 7 = 0")
    one = similarity.nearest_neighbours(vectors, queries, "vec_id", "embedding", 4)
    many = similarity.nearest_neighbours(vectors, queries, "vec_id", "embedding", 4, block_rows=3)
    assert one.count() == 4 * queries.count()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
