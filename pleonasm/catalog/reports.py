"""Queries over prompts as a whole and over trace logs: features, routes, costs, roll-ups."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.catalog import query
from pleonasm.catalog import sqltext as S
from pleonasm.functions import signals, text as T
from pleonasm.operators import analytics, cost, dedupe, features, rows
from pleonasm.plans import reports
from pleonasm.session import shared_folder
from pleonasm.sources import keyed, messages

# --- prompts ----------------------------------------------------------------------------------------


def _prompts(t):
    """Plain documents, prompts with retrieved chunks and support prompts, one below the other."""
    documents = t.documents.select(F.lit("document").alias("origin"), F.col("doc_id").alias("prompt_id"), "text")
    chunked = t.derived("chunk_prompts").select(F.lit("chunked").alias("origin"), "prompt_id", "text")
    support = t.derived("support_prompts").select(F.lit("support").alias("origin"), "prompt_id", "text")
    return documents.unionByName(chunked).unionByName(support)


_PROMPTS = f"""{S.source('chunk_prompts')}, {S.source('support_prompts')}, prompts AS (
  SELECT 'document' AS origin, doc_id AS prompt_id, text FROM documents
  UNION ALL SELECT 'chunked', prompt_id, text FROM chunk_prompts UNION ALL SELECT 'support', prompt_id, text FROM support_prompts)"""


def _has(pattern_words) -> str:
    return f"regexp_matches(lower(text), {S.q(S.word_bound(pattern_words))})"


_FEATURES = rf"""{_PROMPTS}, f AS (SELECT *,
    {_has(['order id', 'ticket id', 'customer email', 'product sku', 'refund amount'])} AS f1,
    regexp_matches(lower(text), '\$\d') OR {_has(['refunds?', 'finance approval'])} AS f2,
    {_has(['clause', 'agreement', 'contract', 'liability', 'indemnif'])} AS f3,
    regexp_matches(text, '```|\{{[\s\S]*?:[\s\S]*?\}}|<[^>]+>') AS f4,
    len(regexp_extract_all(text, '(?im)^(?:Retrieved .*?chunk|Chunk|Source|Document section|Policy excerpt)\s*[A-Z0-9]*:')) AS chunk_count,
    list_transform({S.matched('text', 3)}, lambda s: {S.bare('s')}) AS k,
    {S.tokens('text')} AS input_tokens FROM prompts),
  r AS (SELECT *, CASE WHEN len(k) = 0 THEN 0.0::DOUBLE ELSE round((len(k) - len(list_distinct(k))) / CAST(len(k) AS DOUBLE), 3) END AS repeated_ratio FROM f),
  p AS (SELECT *, CASE
    WHEN f1 AND {_has(['refund', 'support', 'ticket', 'customer-facing'])} THEN 'customer_support'
    WHEN chunk_count >= 2 THEN 'rag_context' WHEN f3 THEN 'legal_compliance'
    WHEN {_has(['policy', 'must', 'should', 'do not', 'agents?'])} AND repeated_ratio > 0.12 THEN 'policy_instruction'
    WHEN regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}_])(?:user|assistant|tool|observation):[\p{{L}}\p{{N}}_]') THEN 'chat_history'
    WHEN {_has(['error', 'trace', 'log', 'tool call', 'stack'])} THEN 'agent_tool_trace'
    WHEN {_has(['product overview', 'user guide', 'faq', 'documentation'])} THEN 'product_docs'
    WHEN {_has(['finance', 'quarterly', 'spending', 'margin', 'revenue', 'cost'])} THEN 'finance_report'
    ELSE 'general_prompt' END AS prompt_type,
    CASE WHEN f3 OR f4 THEN 'high' WHEN f1 OR f2 THEN 'medium' ELSE 'low' END AS risk_level,
    {_has(['today', 'current', 'latest', 'now', 'real-time'])} AS fresh FROM r),
  features AS (SELECT *, CASE WHEN fresh THEN 'low' WHEN prompt_type IN ('customer_support', 'rag_context', 'policy_instruction', 'product_docs') THEN 'high' ELSE 'medium' END AS cacheability,
    array_to_string(list_filter([CASE WHEN f1 THEN 'customer_identifiers' END, CASE WHEN f2 THEN 'money_or_approval' END, CASE WHEN f3 THEN 'legal' END, CASE WHEN f4 THEN 'structured_or_code' END], lambda x: x IS NOT NULL), '|') AS flags FROM p)"""


@query(
    "D1", "J8",
    sql=f"WITH {_FEATURES} SELECT origin, prompt_id, prompt_type, input_tokens, risk_level, repeated_ratio, CAST(chunk_count AS INT) AS chunk_count, cacheability, flags FROM features",
)
def prompt_features(t):
    found = features.with_prompt_features(_prompts(t))
    return found.select(
        "origin", "prompt_id", "prompt_type", "input_tokens", "risk_level", "repeated_ratio", "chunk_count",
        "cacheability", F.array_join("flags", "|").alias("flags"),
    )


_TINY = "(input_tokens < 120 AND repeated_ratio < 0.2)"


@query(
    "D3", "J8",
    sql=f"""WITH {_FEATURES}, plan AS (SELECT origin, prompt_type, risk_level,
      CASE WHEN {_TINY} THEN 'exact_cache|no_change' ELSE 'exact_cache' || CASE WHEN cacheability <> 'low' THEN '|semantic_cache' ELSE '' END
        || CASE prompt_type WHEN 'customer_support' THEN '|customer_support_policy_dedupe|instruction_dedupe' WHEN 'rag_context' THEN '|rag_dedupe|chunk_relevance_pruning'
           WHEN 'policy_instruction' THEN '|instruction_dedupe' WHEN 'chat_history' THEN '|chat_history_compaction' WHEN 'agent_tool_trace' THEN '|tool_trace_cleanup' ELSE '' END
        || CASE risk_level WHEN 'low' THEN '|semantic_compression' WHEN 'high' THEN '|no_generated_summary' ELSE '' END END AS strategies,
      CASE prompt_type WHEN 'customer_support' THEN CASE WHEN input_tokens >= 180 THEN 25.0 ELSE 12.0 END
        WHEN 'rag_context' THEN CASE WHEN chunk_count >= 4 THEN 30.0 ELSE 15.0 END WHEN 'policy_instruction' THEN 18.0
        WHEN 'legal_compliance' THEN 5.0 WHEN 'general_prompt' THEN 5.0 ELSE 10.0 END AS expected,
      CASE WHEN {_TINY} THEN 'tiny' WHEN prompt_type = 'customer_support' THEN 'support' WHEN prompt_type = 'rag_context' THEN 'retrieved'
        WHEN risk_level = 'high' THEN 'high-risk' ELSE 'standard' END AS reason FROM features)
    SELECT origin, prompt_type, risk_level, strategies, CAST(expected AS DOUBLE) AS expected_savings_percent, reason, count(*) AS prompts FROM plan GROUP BY ALL""",
)
def strategy_counts(t):
    planned = reports.prompt_features(_prompts(t), "balanced")
    return planned.groupBy(
        "origin", "prompt_type", "risk_level", F.array_join("strategies", "|").alias("strategies"),
        "expected_savings_percent", F.regexp_extract("reason", r"^[a-z-]+", 0).alias("reason"),
    ).agg(F.count("*").alias("prompts"))


def _provider(key: str):
    return F.element_at(T.literal_array(("gemini", "openai", "dry-run")), (F.col(key) % 3).cast("int") + 1)


_ROUTED = rf"""tested AS (SELECT conv_id, {S.words('text')} AS words,
    regexp_matches(text, '```|`[^`]+`|(?:^|[^\p{{L}}\p{{N}}_])[a-zA-Z]\s*=') AS code,
    regexp_matches(text, {S.q('(?i)' + S.word_bound(['legal', 'contract', 'clause', 'medical', 'finance', 'invoice', 'compliance', 'HIPAA']))}) AS regulated,
    regexp_matches(text, {S.q('(?i)' + S.word_bound(['JSON only', 'strict JSON', 'reason step', 'prove', 'debug', 'root cause']))}) AS strict FROM conversations),
  summed AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'gemini' WHEN 1 THEN 'openai' ELSE 'dry-run' END AS provider,
    array_to_string(list_filter([CASE WHEN sum(words) > 1500 THEN 'long_context' END, CASE WHEN bool_or(code) THEN 'code_or_math' END,
      CASE WHEN bool_or(regulated) THEN 'regulated_domain' END, CASE WHEN bool_or(strict) THEN 'complex_reasoning_or_strict_output' END], lambda x: x IS NOT NULL), ', ') AS risks
    FROM tested GROUP BY conv_id),
  routed AS (SELECT conv_id, provider, CASE WHEN risks = '' THEN 'cheaper_model' ELSE 'stronger_model' END AS route,
    CASE WHEN risks = '' THEN 'short low-risk prompt' ELSE risks END AS reason,
    CASE WHEN provider <> 'openai' THEN 'gemini-2.5-flash' WHEN risks = '' THEN 'gpt-4o-mini' ELSE 'gpt-4o' END AS model FROM summed)"""


@query("D4", sql=f"WITH {_ROUTED} SELECT conv_id, provider, route, reason, model FROM routed")
def conversation_routes(t):
    return features.route_conversations(t.conversations, "conv_id", _provider("conv_id"))


@query(
    "D5",
    sql=f"""SELECT source, count(*) FILTER (WHERE regexp_matches(text, {S.q('(?i)' + S.word_bound(['today', 'now', 'current', 'latest', 'this week', 'this month', 'yesterday', 'tomorrow', 'price', 'weather', 'news']))})) AS time_sensitive,
      count(*) AS texts FROM documents GROUP BY source""",
)
def time_sensitive_texts(t):
    hit = features.is_time_sensitive(F.col("text"))
    return t.documents.groupBy("source").agg(F.count_if(hit).alias("time_sensitive"), F.count("*").alias("texts"))


@query(
    "D7",
    sql=rf"""WITH {S.source('filler_prompts')} SELECT source, count(*) FILTER (WHERE regexp_matches(text, '\s+[,.!?;:]')) AS broken_punctuation,
      count(*) FILTER (WHERE regexp_matches(text, '(?i)\bnot\s+[A-Za-z0-9_-]+\s+or\s+[A-Za-z0-9_-]+\b')) AS ambiguous_not_or,
      count(*) FILTER (WHERE contains(text, 'PREFACE: PREFACE')) AS duplicated_preface_label FROM filler_prompts GROUP BY source""",
)
def surface_issue_counts(t):
    found = t.derived("filler_prompts").select("source", signals.surface_issues(F.col("text")).alias("i"))
    kinds = ("broken_punctuation", "ambiguous_not_or", "duplicated_preface_label")
    return found.groupBy("source").agg(*[F.count_if(F.array_contains("i", k)).alias(k) for k in kinds])


@query(
    "D8",
    sql="""SELECT event_type, count(*) AS texts, count(*) FILTER (WHERE event_id % 5 <> 0) AS valid FROM events GROUP BY event_type""",
)
def fenced_json_validity(t):
    # Every fifth block loses its closing brace.
    body = F.when(F.col("event_id") % 5 == 0, F.regexp_replace("props", r"\}", "")).otherwise(F.col("props"))
    fenced = F.concat(F.lit("Answer:\n```json\n"), body, F.lit("\n```"))
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("texts"), F.count_if(features.json_blocks_valid(fenced)).alias("valid")
    )


# --- sources and sinks --------------------------------------------------------------------------------


@query("A1", sql="SELECT conv_id, turn, i AS part, CASE i WHEN 0 THEN role ELSE 'note' END AS role, CASE i WHEN 0 THEN text ELSE source_text END AS content FROM (SELECT conv_id, turn, role, text, upper(role) AS source_text, unnest([0, 1]) AS i FROM conversations)")
def message_rows(t):
    packed = t.conversations.select(
        "conv_id",
        F.col("turn"),
        F.array(
            F.struct("role", F.col("text").alias("content")),
            F.struct(F.lit("note").alias("role"), F.upper("role").alias("content")),
        ).alias("messages"),
    )
    return messages.explode_messages(packed.withColumnRenamed("turn", "outer_turn"), ["conv_id", "outer_turn"]).select(
        "conv_id", F.col("outer_turn").alias("turn"), F.col("turn").alias("part"), "role", "content"
    )


@query(
    "A2",
    sql="""SELECT conv_id, turn AS request, i AS turn, CASE i WHEN 0 THEN role ELSE 'user' END AS role, CASE i WHEN 0 THEN text ELSE '' END AS content,
      CASE WHEN turn % 2 = 0 THEN 'balanced' ELSE 'safe' END AS compression_level, 'gemini' AS provider, 'live' AS mode, 0.0::DOUBLE AS temperature
      FROM (SELECT *, unnest([0, 1]) AS i FROM conversations)""",
)
def normalised_payloads(t):
    # The second message of each payload has neither role nor content.
    payload = F.to_json(
        F.struct(
            F.array(
                F.struct("role", F.col("text").alias("content")),
                F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content")),
            ).alias("messages"),
            F.when(F.col("turn") % 2 == 0, F.lit("balanced")).alias("compression_level"),
        )
    )
    packed = t.conversations.select("conv_id", F.col("turn").alias("request"), payload.alias("payload"))
    return messages.normalise_payloads(packed, ["conv_id", "request"]).drop("model")


@query(
    "A10",
    sql="SELECT source, count(*) FILTER (WHERE strlen(text) <= 4000) AS accepted, count(*) FILTER (WHERE strlen(text) > 4000) AS rejected FROM documents GROUP BY source",
)
def size_guard(t):
    fits, rejected = features.split_by_size(t.documents, limit=4000)
    both = fits.select("source", F.lit(True).alias("ok")).unionByName(rejected.select("source", F.lit(False).alias("ok")))
    return both.groupBy("source").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


# --- traces -------------------------------------------------------------------------------------------------

_MODEL = "CASE provider WHEN 'openai' THEN CASE WHEN request_id % 4 = 0 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END ELSE 'gemini-2.5-flash' END"
_KEY = f"CASE WHEN provider = 'dry-run' THEN 'dry-run' WHEN provider = 'openai' AND request_id % 4 = 0 THEN 'openai-strong' WHEN provider = 'openai' THEN 'openai-small' ELSE 'gemini-flash' END"
_PRICE_ROWS = ", ".join(f"('{k}', {i!r}::DOUBLE, {o!r}::DOUBLE)" for k, i, o in L.PRICES)


def _six(expression: str) -> str:
    """Half up to six decimals."""
    return f"(floor(({expression}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"


_TRACES = f"""{S.source('trace_log')}, prices AS (SELECT * FROM (VALUES {_PRICE_ROWS}) v(price_key, input_per_1k, output_per_1k)),
  costs AS (SELECT t.*, {_MODEL} AS model, price_key, input_per_1k, output_per_1k FROM (SELECT *, {_KEY} AS price_key FROM trace_log) t JOIN prices USING (price_key)),
  priced0 AS (SELECT *, {_six('original_tokens / 1000.0::DOUBLE * input_per_1k')} AS cost_before, {_six('optimized_tokens / 1000.0::DOUBLE * input_per_1k')} AS cost_after FROM costs),
  priced AS (SELECT *, {_six('greatest(0.0::DOUBLE, cost_before - cost_after)')} AS total_savings FROM priced0)"""


def _traces(t):
    log = t.derived("trace_log")
    strong = F.when(F.col("request_id") % 4 == 0, F.lit("gpt-4o")).otherwise(F.lit("gpt-4o-mini"))
    return cost.with_cost_report(
        log.withColumn("model", F.when(F.col("provider") == "openai", strong).otherwise(F.lit("gemini-2.5-flash")))
    )


@query("A9", "E16", sql=f"WITH {_TRACES} SELECT request_id, model, price_key, cost_before, cost_after, total_savings FROM priced")
def priced_traces(t):
    return _traces(t).select("request_id", "model", "price_key", "cost_before", "cost_after", "total_savings")


@query(
    "F27",
    sql=f"""WITH {_TRACES}, l AS (SELECT provider, model, {_six('original_tokens / 1000.0::DOUBLE * input_per_1k + output_tokens / 1000.0::DOUBLE * output_per_1k')} AS b,
      {_six('optimized_tokens / 1000.0::DOUBLE * input_per_1k + output_tokens / 1000.0::DOUBLE * output_per_1k')} AS a, {_six('output_tokens / 1000.0::DOUBLE * output_per_1k')} AS o FROM priced)
    SELECT provider, model, count(*) AS requests, round(sum(b), 4) AS cost_before, round(sum(a), 4) AS cost_after, round(sum(o), 4) AS output_cost, round(sum(greatest(0, b - a)), 4) AS compression_savings FROM l GROUP BY provider, model""",
)
def live_cost_report(t):
    log = _traces(t).select("provider", "model", "original_tokens", "optimized_tokens", "output_tokens")
    live = cost.with_live_cost_report(log)
    sums = ("cost_before", "cost_after", "output_cost", "compression_savings")
    return live.groupBy("provider", "model").agg(F.count("*").alias("requests"), *[F.round(F.sum(c), 4).alias(c) for c in sums])


@query(
    "F27",
    sql=f"""WITH {_TRACES}, h AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts, request_id) > 1 AS hit FROM priced)
    SELECT provider, price_key, round(sum(cost_before), 4) AS cost_before, round(sum(total_savings), 4) AS compression_savings, round(sum(CASE WHEN hit THEN cost_after ELSE 0 END), 4) AS cache_savings FROM h GROUP BY provider, price_key""",
)
def estimated_cost_report(t):
    hits = analytics.hit_ordinals(t.derived("trace_log"), "cache_key", "ts", "request_id").withColumn("hit", F.col("hits_so_far") > 0)
    strong = F.when(F.col("request_id") % 4 == 0, F.lit("gpt-4o")).otherwise(F.lit("gpt-4o-mini"))
    named = hits.withColumn("model", F.when(F.col("provider") == "openai", strong).otherwise(F.lit("gemini-2.5-flash")))
    sums = ("cost_before", "compression_savings", "cache_savings")
    return cost.with_cost_report(named, cache_hit="hit").groupBy("provider", "price_key").agg(*[F.round(F.sum(c), 4).alias(c) for c in sums])


@query(
    "A3", "G12",
    sql=f"""WITH {S.source('trace_log')} SELECT cache_key, request_id, provider, response FROM trace_log
    QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, request_id DESC) = 1""",
)
def latest_trace_per_key(t):
    log = t.derived("trace_log").select("cache_key", "request_id", "ts", "provider", "response")
    return analytics.latest_per_key(log, "cache_key", ["ts", "request_id"]).select("cache_key", "request_id", "provider", "response")


@query("A4", "H1", sql=f"WITH {S.source('trace_log')} SELECT request_id, provider, original_tokens FROM trace_log ORDER BY ts DESC, request_id DESC LIMIT 50")
def newest_traces(t):
    return analytics.newest(t.derived("trace_log"), 50, ["ts", "request_id"]).select("request_id", "provider", "original_tokens")


@query("A6", "H1", sql=f"WITH {S.source('trace_log')} SELECT request_id, suite, accepted FROM trace_log ORDER BY request_id DESC LIMIT 50")
def newest_evaluations(t):
    return analytics.newest(t.derived("trace_log"), 50, ["request_id"]).select("request_id", "suite", "accepted")


_CACHE = f"""{S.source('trace_log')}, cache AS (SELECT cache_key, arg_max(response, (ts, request_id)) AS response,
  arg_max(greatest(0, original_tokens - optimized_tokens), (ts, request_id)) AS saved_tokens, min(ts) AS created_at, count(*) - 1 AS hits FROM trace_log GROUP BY cache_key)"""


@query("A5", sql=f"WITH {_CACHE} SELECT cache_key, response, saved_tokens, hits FROM cache")
def response_cache(t):
    return analytics.response_cache(t.derived("trace_log")).select("cache_key", "response", "saved_tokens", "hits")


def _halves(t):
    """The log as two batches, the later requests after the earlier ones."""
    log = t.derived("trace_log")
    return [log.filter("request_id % 3 <> 2"), log.filter("request_id % 3 = 2")]


def _merged(t, table, rows):
    for number, part in enumerate(_halves(t)):
        table.merge(rows(part), number)
    return table.read()


@query("A5", "A3", sql=f"WITH {_CACHE} SELECT cache_key, response, saved_tokens, hits, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM cache")
def merged_response_cache(t):
    """The cache after two batches of the log, the second merged into what the first left."""
    table = keyed.response_cache_table(t.spark, f"{shared_folder(t.spark).rstrip('/')}/cache-{uuid4().hex}")
    rows = _merged(t, table, keyed.cache_entries)
    return rows.select("cache_key", "response", "saved_tokens", (F.col("requests") - 1).alias("hits"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("A3", "S6", sql=f"WITH {S.source('trace_log')} SELECT request_id, provider, original_tokens FROM trace_log")
def merged_traces(t):
    """The trace log after two batches, of which the second brings every trace of the first again, older."""
    table = keyed.trace_table(t.spark, f"{shared_folder(t.spark).rstrip('/')}/traces-{uuid4().hex}")
    first, second = (part.select("request_id", "ts", "provider", "original_tokens") for part in _halves(t))
    table.merge(first, 0)
    stale = first.select("request_id", (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("stale").alias("provider"), F.lit(0).cast("long").alias("original_tokens"))
    table.merge(second.unionByName(stale), 1)
    return table.read().select("request_id", "provider", "original_tokens")


@query(
    "F2",
    sql=f"WITH {_CACHE} SELECT count(*) AS entries, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens, round(sum(hits) / CAST(greatest(1, sum(hits) + count(*)) AS DOUBLE) * 100, 2) AS hit_rate FROM cache",
)
def cache_statistics(t):
    return analytics.cache_statistics(analytics.response_cache(t.derived("trace_log")))


@query(
    "G12",
    sql=f"""WITH {S.source('trace_log')} SELECT request_id, cache_key, row_number() OVER o - 1 AS hits_so_far,
      epoch_us(ts) - epoch_us(lag(ts) OVER o) AS gap_us FROM trace_log WINDOW o AS (PARTITION BY cache_key ORDER BY ts, request_id)""",
)
def cache_hit_ordinals(t):
    return analytics.hit_ordinals(t.derived("trace_log"), "cache_key", "ts", "request_id").select(
        "request_id", "cache_key", "hits_so_far", "gap_us"
    )


def _summary_sql(source: str) -> str:
    return f"""SELECT count(*) AS requests, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(optimized_tokens) AS BIGINT) AS optimized_tokens,
      count(*) FILTER (WHERE NOT accepted) AS quality_failures, count(*) FILTER (WHERE NOT facts_kept) AS protected_failures, round(sum(total_savings), 6) AS cost_saved,
      CAST(greatest(0, sum(original_tokens) - sum(optimized_tokens)) AS BIGINT) AS tokens_saved,
      round(greatest(0, sum(original_tokens) - sum(optimized_tokens)) / CAST(greatest(1, sum(original_tokens)) AS DOUBLE) * 100, 2) AS savings_percent FROM {source}"""


@query("F1", sql=f"WITH {_TRACES}, recent AS (SELECT * FROM priced ORDER BY ts DESC, request_id DESC LIMIT 500) {_summary_sql('recent')}")
def recent_trace_summary(t):
    return analytics.trace_summary(_traces(t), horizon=500)


@query("F1", sql=f"WITH {_TRACES} {_summary_sql('priced')}")
def trace_summary(t):
    return analytics.trace_summary(_traces(t))


_SAVED = "CASE WHEN sum(original_tokens) <= 0 THEN 0.0 ELSE round((sum(original_tokens) - sum(optimized_tokens)) / CAST(sum(original_tokens) AS DOUBLE) * 100, 2) END AS savings_percent"
_SUMS = "CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(optimized_tokens) AS BIGINT) AS optimized_tokens"


@query(
    "F3", "F29", "A11",
    sql=f"""WITH {_TRACES} SELECT suite, category, CAST(grouping(suite, category) AS INT) AS level, count(*) AS cases, {_SUMS},
      count(*) FILTER (WHERE NOT facts_kept) AS protected_failures, count(*) FILTER (WHERE similarity < 0.62) AS semantic_failures, round(sum(total_savings), 6) AS cost_saved, {_SAVED}
      FROM priced GROUP BY ROLLUP (suite, category)""",
)
def benchmark_table(t):
    return analytics.benchmark_table(_traces(t))


@query(
    "F29",
    sql=f"WITH {S.source('trace_log')} SELECT provider, level, CAST(grouping(provider, level) AS INT) AS grouping, count(*) AS requests, {_SUMS}, {_SAVED} FROM trace_log GROUP BY CUBE (provider, level)",
)
def savings_cube(t):
    return analytics.savings_cube(t.derived("trace_log"))


@query(
    "F4",
    sql=f"WITH {S.source('trace_log')} SELECT category, count(*) AS runs, {_SUMS}, count(*) FILTER (WHERE accepted) AS accepted_runs, count(*) FILTER (WHERE NOT facts_kept) AS failures, {_SAVED} FROM trace_log GROUP BY category",
)
def robustness_table(t):
    return analytics.robustness_table(t.derived("trace_log"))


@query(
    "F5",
    sql=f"""WITH {S.source('trace_log')} SELECT category, count(*) AS total, count(*) FILTER (WHERE NOT accepted OR NOT facts_kept) AS failures,
      count(*) FILTER (WHERE optimized_tokens >= original_tokens) AS no_reduction,
      round(avg(round((original_tokens - optimized_tokens) / CAST(original_tokens AS DOUBLE) * 100, 2)), 2) AS mean_savings,
      round(count(*) FILTER (WHERE NOT accepted OR NOT facts_kept) / CAST(count(*) AS DOUBLE), 4) AS failure_rate FROM trace_log GROUP BY category""",
)
def outcome_by_category(t):
    return analytics.outcome_by_category(t.derived("trace_log"))


@query(
    "H3",
    sql=f"""WITH {S.source('trace_log')} SELECT category, accepted, request_id FROM trace_log
    QUALIFY row_number() OVER (PARTITION BY category, accepted ORDER BY request_id) <= 10""",
)
def first_examples(t):
    return analytics.first_examples(t.derived("trace_log"), ["category", "accepted"], ["request_id"], 10).select("category", "accepted", "request_id")


_PILOT = f"""{_TRACES}, {_CACHE[_CACHE.index('cache AS'):]},
  totals AS (SELECT count(*) FILTER (WHERE NOT accepted) AS quality_failures, count(*) FILTER (WHERE NOT facts_kept) AS robustness_failures, round(sum(total_savings), 6) AS cost_saved, {_SAVED} FROM priced),
  cs AS (SELECT round(sum(hits) / CAST(greatest(1, sum(hits) + count(*)) AS DOUBLE) * 100, 2) AS hit_rate, count(*) AS entries, CAST(sum(hits) AS BIGINT) AS hits FROM cache),
  recent AS (SELECT count(*) AS recent_requests, count(*) FILTER (WHERE NOT facts_kept) AS recent_protected_failures FROM priced),
  scored AS (SELECT *, CAST(greatest(0, least(85, round(55 + least(20, savings_percent) - quality_failures * 10 - robustness_failures * 4 + least(10, hit_rate / 10)))) AS INT) AS score FROM totals, cs, recent)"""


@query(
    "F6", "F7", "J10",
    sql=f"""WITH {_PILOT} SELECT *, CASE WHEN score >= 90 THEN 'pilot_ready' WHEN score >= 75 THEN 'staging_only' WHEN score >= 50 THEN 'prototype_only' ELSE 'unsafe' END AS recommendation,
      'safe' AS recommended_level, true AS live_test_needed, score >= 75 AS staging_safe, true AS production_blocked FROM scored""",
)
def pilot_report(t):
    return reports.pilot_report(_traces(t))


_CONV_SENT = f"sent AS ({S.rows('conversations', 'conv_id, turn', S.sentences('text'), 'sentence')})"
_MESSAGES = rf"""{_CONV_SENT},
  numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, {S.squeeze('sentence')} ORDER BY pos) AS copy FROM sent),
  kept AS (SELECT conv_id, turn, count(*) FILTER (WHERE copy > 1) AS dropped, string_agg(sentence, ' ' ORDER BY pos) FILTER (WHERE copy = 1) AS kept FROM numbered GROUP BY conv_id, turn),
  vers AS (SELECT conv_id, turn, role, text, coalesce(dropped, 0) AS dropped, CASE WHEN coalesce(dropped, 0) = 0 THEN text ELSE {S.strip("regexp_replace(kept, '[ ]+', ' ', 'g')")} END AS after_text
    FROM conversations LEFT JOIN kept USING (conv_id, turn)),
  msg AS (SELECT *, {S.tokens('role')} + 4 AS overhead, {S.tokens('text')} AS before, {S.tokens('after_text')} AS after FROM vers),
  {S.grammar('vers', 'conv_id, turn', 'after_text')}, {S.similarity('vers', 'conv_id, turn', 'text', 'after_text')},
  gated AS (SELECT msg.*, {S.same_facts('text', 'after_text')} AND coalesce(flags, '') = '' AND after <= before AND after / CAST(greatest(before, 1) AS DOUBLE) >= 0.45 AND (text = after_text OR sim >= 0.72) AS ok,
    CASE WHEN text = after_text THEN 1.0::DOUBLE ELSE sim END AS similarity FROM msg LEFT JOIN grammar USING (conv_id, turn) JOIN scored USING (conv_id, turn)),
  conv AS (SELECT conv_id, bool_and(ok) AS passed, min(similarity) AS min_similarity, CAST(sum(before + overhead) AS BIGINT) AS original_tokens, CAST(sum(after + overhead) AS BIGINT) AS after_tokens,
    array_to_string(list_sort(list(DISTINCT CASE WHEN dropped > 0 THEN 'exact_dedupe' ELSE 'no_change' END)), '|') AS stages FROM gated GROUP BY conv_id),
  done AS (SELECT *, passed AND after_tokens < original_tokens AS accepted, CASE WHEN passed AND after_tokens < original_tokens THEN after_tokens ELSE original_tokens END AS optimized_tokens FROM conv)"""


@query(
    "F25",
    sql=f"""WITH {_MESSAGES} SELECT conv_id, original_tokens, optimized_tokens, accepted, stages, min_similarity,
      round((original_tokens - optimized_tokens) / CAST(original_tokens AS DOUBLE) * 100, 2) AS savings_percent FROM done""",
)
def conversation_acceptance(t):
    return analytics.conversation_acceptance(reports.message_savings(t.conversations, "conv_id"), "conv_id")


@query(
    "J7", "E16", "D4",
    sql=f"""WITH {_MESSAGES}, {_ROUTED}, prices AS (SELECT * FROM (VALUES {_PRICE_ROWS}) v(price_key, input_per_1k, output_per_1k)),
    k AS (SELECT *, CASE WHEN provider = 'dry-run' THEN 'dry-run' WHEN provider <> 'openai' THEN 'gemini-flash' WHEN model = 'gpt-4o' THEN 'openai-strong' ELSE 'openai-small' END AS price_key FROM done JOIN routed USING (conv_id)),
    c AS (SELECT *, {_six('original_tokens / 1000.0::DOUBLE * input_per_1k')} AS b, {_six('optimized_tokens / 1000.0::DOUBLE * input_per_1k')} AS a FROM k JOIN prices USING (price_key))
    SELECT provider, route, model, price_key, count(*) AS conversations, count(*) FILTER (WHERE accepted) AS accepted, {_SUMS}, round(sum({_six('greatest(0.0::DOUBLE, b - a)')}), 6) AS cost_saved, {_SAVED}
    FROM c GROUP BY provider, route, model, price_key""",
)
def savings_report(t):
    return reports.savings_report(t.conversations, "conv_id", _provider("conv_id"))


@query(
    "F26",
    sql=rf"""WITH {S.source('filler_prompts')}, v AS (SELECT prompt_id, source, text AS before, regexp_replace(text, '(?i)\bplease\s+', '', 'g') AS after FROM filler_prompts),
    w AS (SELECT *, list_distinct(regexp_extract_all(lower(before), '\S+')) AS b, list_distinct(regexp_extract_all(lower(after), '\S+')) AS a FROM v),
    s AS (SELECT source, round(len(list_intersect(a, b)) / CAST(greatest(1, len(list_distinct(list_concat(a, b)))) AS DOUBLE), 3) AS sim, length(after) - length(before) AS diff FROM w)
    SELECT source, count(*) AS rewrites, round(avg(sim), 4) AS mean_similarity, count(*) AS numbers_kept, CAST(sum(diff) AS BIGINT) AS length_difference, count(*) AS code_kept FROM s GROUP BY source""",
)
def rewrite_quality(t):
    versions = t.derived("filler_prompts").select(
        "source", F.col("text").alias("before"), F.regexp_replace("text", r"(?i)\bplease\s+", "").alias("after")
    )
    return analytics.quality_rows(versions).groupBy("source").agg(
        F.count("*").alias("rewrites"),
        F.round(F.avg("answer_similarity"), 4).alias("mean_similarity"),
        F.count_if("numbers_kept").alias("numbers_kept"),
        F.sum("length_difference").cast("long").alias("length_difference"),
        F.count_if("code_kept").alias("code_kept"),
    )


# The fixed answer of a dry run.
_DRY_RUN = (
    "[dry-run structural validation only] Request passed through optimization middleware. "
    "No real model inference was performed."
)


@query(
    "U4",
    sql=f"""SELECT conv_id, CAST(sum({S.tokens('role')} + {S.tokens('text')} + 4) AS BIGINT) AS prompt_tokens,
      {S.tokens(S.q(_DRY_RUN))} AS completion_tokens, CAST(sum({S.tokens('role')} + {S.tokens('text')} + 4) AS BIGINT) + {S.tokens(S.q(_DRY_RUN))} AS total_tokens FROM conversations GROUP BY conv_id""",
)
def dry_run_usage(t):
    usage = rows.conversation_tokens(t.conversations, "conv_id").select(
        "conv_id", F.col("tokens").alias("prompt_tokens"), T.count_tokens(F.lit(_DRY_RUN)).alias("completion_tokens")
    )
    return usage.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


@query(
    "E15",
    sql=f"""WITH p AS (SELECT doc_id, sha256(source || '|' || lang || '|' || sha256(text)) AS key FROM documents),
    firsts AS (SELECT key, min(doc_id) AS stored FROM p GROUP BY key)
    SELECT doc_id, stored, stored < doc_id AS hit FROM p JOIN firsts USING (key)""",
)
def exact_cache_lookup(t):
    from pleonasm.operators import cache

    requests = t.documents.select("doc_id", cache.exact_key("source", "lang", "text").alias("key"))
    return cache.exact_lookup(requests, "key", "doc_id")
