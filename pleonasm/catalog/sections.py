"""Queries on sectioned prompts: sections, retrieved chunks, evidence, support roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.catalog import query
from pleonasm.catalog import sqltext as S
from pleonasm.catalog.corpus import _TERMINAL, _kept_sql
from pleonasm.operators import evidence, rows

_KEYS = ["prompt_id"]
_PROMPTS = f"{S.source('chunk_prompts')}"


def _lines(header: str) -> str:
    """Lines of each prompt with a running section number."""
    return rf"""line AS ({S.rows('chunk_prompts', 'prompt_id', "string_split(text, chr(10))", 'line')}),
    flagged AS (SELECT *, regexp_matches(line, {S.q('(?i)^(?:' + header + r'):\s*$')}) AS is_header FROM line),
    numbered AS (SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER (PARTITION BY prompt_id ORDER BY pos) AS n FROM flagged),
    body AS (SELECT prompt_id, n, max(CASE WHEN is_header THEN regexp_replace(line, ':\s*$', '') END) AS label,
      coalesce({S.strip("string_agg(CASE WHEN NOT is_header THEN line END, chr(10) ORDER BY pos)")}, '') AS body FROM numbered GROUP BY prompt_id, n)"""


@query(
    "B6", "G10",
    sql=f"""WITH {_PROMPTS}, {_lines(L.TYPED_HEADER)}, s AS (SELECT prompt_id, n, coalesce(label, 'PREFACE') AS label, body,
      CASE WHEN label IS NULL THEN 'instruction' WHEN regexp_matches(lower(label), 'question|task|ticket|request') THEN 'variable' WHEN regexp_matches(lower(label), 'instructions?|reminder|system') THEN 'instruction' ELSE 'context' END AS kind FROM body WHERE body <> '')
    SELECT prompt_id, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY n) - 1 AS INT) AS section_no, label, kind, body FROM s""",
)
def typed_sections(t):
    return rows.typed_sections(t.derived("chunk_prompts"), _KEYS)


@query(
    "B7", "G10",
    sql=f"""WITH {_PROMPTS}, {_lines(L.GENERIC_HEADER)} SELECT prompt_id, CAST(n - 1 AS INT) AS section_no, label AS header, body FROM body WHERE label IS NOT NULL""",
)
def generic_sections(t):
    return rows.generic_sections(t.derived("chunk_prompts"), _KEYS)


_STOP = "(?i)^(?:(?:" + "|".join(L.NON_EVIDENCE_HEADERS) + r")\s*|__PROTECTED_\d+__\s*)$"
_CHUNKS = rf"""{_PROMPTS}, {_lines(L.CHUNK_HEADER)}, marked AS (SELECT *, min(CASE WHEN regexp_matches(line, {S.q(_STOP)}) THEN pos END) OVER (PARTITION BY prompt_id, n) AS stop FROM numbered),
  chunks AS (SELECT prompt_id, CAST(n AS INT) AS chunk_no, max(CASE WHEN is_header THEN regexp_replace(line, ':\s*$', '') END) AS header,
    coalesce({S.strip("string_agg(CASE WHEN NOT is_header AND (stop IS NULL OR pos < stop) THEN line END, chr(10) ORDER BY pos)")}, '') AS body FROM marked WHERE n > 0 GROUP BY prompt_id, n)"""


@query("B8", "G10", sql=f"WITH {_CHUNKS} SELECT prompt_id, chunk_no, header, body FROM chunks")
def retrieved_chunks(t):
    return rows.chunk_rows(t.derived("chunk_prompts"), _KEYS)


@query("B9", sql="SELECT doc_id AS prompt_id, 'Draft a reply.' AS task, NULL AS question FROM documents")
def named_section_bodies(t):
    return t.derived("chunk_prompts").select(
        "prompt_id", rows.section_body(F.col("text"), "Task").alias("task"), rows.section_body(F.col("text"), "Question").alias("question")
    )


# What each chunk states, from the columns the prompts were built of. The text of a document is unknown evidence;
# chunks 4 and 5 carry the same one unless the fifth reports a latency.
_UNITS = f"""{_TERMINAL}, {_kept_sql(S.squeeze('sentence'), 'sent')}, told AS (SELECT doc_id, coalesce(kept, '') AS body FROM documents LEFT JOIN kept USING (doc_id)),
  units AS (
  SELECT doc_id AS prompt_id, 1 AS chunk_no, 'verification_rule' AS theme, 'Verification rule: agents must verify order ID and customer email.' AS canonical FROM documents
  UNION ALL SELECT doc_id, 2, 'verification_rule', 'Verification rule: agents must verify order ID and purchase date.' FROM documents
  UNION ALL SELECT doc_id, 2, 'refund_approval_rule', 'Refund rule: refunds over $' || CAST(500 + 100 * (doc_id % 3) AS STRING) || ' require Finance approval.' FROM documents
  UNION ALL SELECT doc_id, 3, CASE doc_id % 4 WHEN 0 THEN 'refund_approval_rule' WHEN 1 THEN 'uptime_metric' WHEN 2 THEN 'latency_metric' ELSE 'refund_window_rule' END,
    CASE doc_id % 4 WHEN 0 THEN 'Refund rule: refunds over $500 require Finance approval.' WHEN 1 THEN 'Uptime metric: uptime was 99.9% in March.' WHEN 2 THEN 'Latency metric: latency dropped from 120 ms to 80 ms.'
      ELSE 'Refund window: customers may request a refund within 30 days if usage remains within trial limits.' END FROM documents
  UNION ALL SELECT doc_id, 5, 'latency_metric', 'Latency metric: latency dropped from 120 ms to 95 ms.' FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 4, 'unknown_evidence', 'Evidence: ' || body FROM told
  UNION ALL SELECT doc_id, 5, 'unknown_evidence', 'Evidence: ' || body FROM told WHERE doc_id % 5 <> 0)"""


def _units(t):
    return evidence.unit_rows(rows.chunk_rows(t.derived("chunk_prompts"), _KEYS), _KEYS)


@query("C22", sql=f"WITH {_UNITS} SELECT prompt_id, chunk_no, theme, canonical FROM units")
def evidence_units(t):
    return _units(t).select("prompt_id", "chunk_no", "theme", "canonical")


_SAME_LINE = "doc_id % 5 <> 0"
_EDGES = f"""edges AS (
  SELECT doc_id AS prompt_id, 'verification_rule' AS theme, 1 AS canonical_chunk, 2 AS duplicate_chunk, false AS contradiction FROM documents
  UNION ALL SELECT doc_id, 'refund_approval_rule', 2, 3, doc_id % 3 <> 0 FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'latency_metric', 3, 5, true FROM documents WHERE doc_id % 4 = 2 AND doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'unknown_evidence', 4, 5, false FROM documents WHERE {_SAME_LINE})"""


@query(
    "F22", "E4", "E13", "G13", "J9",
    sql=f"WITH {_EDGES} SELECT *, CASE WHEN contradiction THEN 'preserve_conflict' ELSE 'canonicalize_overlap' END AS decision FROM edges",
)
def duplicate_graph(t):
    return evidence.duplicate_graph(evidence.evidence_groups(t.derived("chunk_prompts"), _KEYS), _KEYS)


@query(
    "E13", "F9", "J9",
    sql=f"""WITH {_UNITS}, {_EDGES} SELECT prompt_id, theme, contradiction, CASE WHEN NOT contradiction THEN arg_min(canonical, (length(canonical), chunk_no)) END AS canonical
      FROM edges JOIN units USING (prompt_id, theme) GROUP BY prompt_id, theme, contradiction""",
)
def evidence_groups(t):
    groups = evidence.evidence_groups(t.derived("chunk_prompts"), _KEYS)
    return groups.select("prompt_id", "theme", "contradiction", "canonical")


@query(
    "F28", "J9",
    sql=f"""WITH {_UNITS}, {_EDGES}, stated AS (SELECT prompt_id, theme FROM edges WHERE NOT contradiction)
    SELECT prompt_id, theme, min(chunk_no) AS chunk_no, canonical FROM units ANTI JOIN stated USING (prompt_id, theme) GROUP BY prompt_id, theme, canonical""",
)
def unique_evidence(t):
    left = evidence.unique_units(t.derived("chunk_prompts"), _KEYS)
    return left.select("prompt_id", "theme", "chunk_no", "canonical")


# The compiled text, block by block: canonical lines, lines no group stands for, chunks kept whole, chunks in conflict.
_PRINTED = """printed AS (
  SELECT doc_id AS prompt_id, 1 AS chunk_no, 'Chunk A' || CAST(doc_id % 10 AS STRING) || ':' || chr(10) || 'Agents must verify the order ID and the customer email.' AS piece FROM documents
  UNION ALL SELECT doc_id, 2, 'Chunk B:' || chr(10) || 'Refunds over $' || CAST(500 + 100 * (doc_id % 3) AS STRING) || ' require Finance approval. Confirm the order ID, purchase date.' FROM documents
  UNION ALL SELECT doc_id, 3, 'Source 3:' || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Finance must review refunds above $500.' WHEN 1 THEN 'Uptime was 99.9% in March.' WHEN 2 THEN 'Latency dropped from 120 ms to 80 ms.' ELSE 'Customers may request a refund within 30 days.' END FROM documents
  UNION ALL SELECT doc_id, 4, 'Policy excerpt:' || chr(10) || body FROM told
  UNION ALL SELECT doc_id, 5, 'Chunk D:' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'Latency dropped from 120 ms to 95 ms.' ELSE body END FROM told)"""
_COMPILED = f"""{_UNITS}, {_EDGES}, {_PRINTED},
  grouped AS (SELECT prompt_id, theme, canonical_chunk AS a, duplicate_chunk AS b, contradiction FROM edges),
  shown AS (SELECT prompt_id, theme, a, b, arg_min(canonical, (length(canonical), chunk_no)) AS canonical FROM grouped JOIN units USING (prompt_id, theme) WHERE NOT contradiction GROUP BY ALL),
  c AS (SELECT prompt_id, string_agg('- ' || canonical, chr(10) ORDER BY a, b, theme) AS part FROM shown GROUP BY prompt_id),
  left_over AS (SELECT prompt_id, chunk_no, theme, canonical FROM units ANTI JOIN shown USING (prompt_id, theme)
    QUALIFY row_number() OVER (PARTITION BY prompt_id, theme, canonical ORDER BY chunk_no) = 1),
  u AS (SELECT prompt_id, string_agg('- ' || canonical, chr(10) ORDER BY chunk_no, theme DESC) AS part FROM left_over GROUP BY prompt_id),
  k AS (SELECT prompt_id, piece AS part FROM printed WHERE chunk_no = 4 AND prompt_id % 5 = 0),
  x AS (SELECT prompt_id, string_agg(piece, chr(10) || chr(10) ORDER BY chunk_no) AS part FROM (SELECT DISTINCT prompt_id, chunk_no, piece FROM printed JOIN grouped USING (prompt_id) WHERE contradiction AND chunk_no IN (a, b)) GROUP BY prompt_id),
  blocks AS (SELECT p.prompt_id, p.text, concat_ws(chr(10) || chr(10), 'Canonical Evidence:' || chr(10) || c.part, 'Unique Evidence:' || chr(10) || u.part, 'Preserved Unique Chunks:' || chr(10) || k.part, 'Contradictory Evidence Preserved:' || chr(10) || x.part) AS block
    FROM chunk_prompts p LEFT JOIN c USING (prompt_id) LEFT JOIN u USING (prompt_id) LEFT JOIN k USING (prompt_id) LEFT JOIN x USING (prompt_id)),
  whole AS (SELECT prompt_id, text, 'You help customers.' || chr(10) || 'System Instructions:' || chr(10) || 'Answer briefly. Never promise approval.' || chr(10) || block || chr(10) || chr(10)
    || 'Customer Ticket:' || chr(10) || 'Ticket ID: SUP-' || CAST(prompt_id AS STRING) || chr(10) || 'Refund amount: $' || CAST(100 + prompt_id % 900 AS STRING) || chr(10) || chr(10) || 'Task:' || chr(10) || 'Draft a reply.' AS compiled FROM blocks)"""


@query(
    "F23", "J9",
    sql=f"""WITH {S.source('chunk_prompts')}, {_COMPILED} SELECT prompt_id, CASE WHEN {S.tokens('compiled')} < {S.tokens('text')} THEN compiled END AS compiled FROM whole""",
)
def canonical_documents(t):
    """The compiled text, or null where it would not be shorter."""
    return evidence.canonical_documents(t.derived("chunk_prompts")).select("prompt_id", "compiled")


_ITEM = "CASE WHEN o_orderkey % 2 = 0 THEN 'purchase date' ELSE 'refund reason' END"
_LIMIT = "'$' || CAST(500 + 50 * (o_orderkey % 4) AS STRING)"


@query(
    "C29", "D12",
    sql=f"""SELECT o_orderkey AS prompt_id, true AS refund_window, 'order ID|customer email|' || {_ITEM} AS items, {_LIMIT} AS policy_threshold,
      o_orderkey % 3 = 0 AS do_not_promise, o_orderkey % 3 <> 2 AS under_review, CASE WHEN o_orderkey % 3 = 2 THEN '$750' END AS reminder_threshold FROM orders""",
)
def support_facts(t):
    facts = evidence.with_support_facts(t.derived("support_prompts"), _KEYS)
    return facts.select(
        "prompt_id", "refund_window", F.array_join("items", "|").alias("items"), "policy_threshold", "do_not_promise", "under_review", "reminder_threshold"
    )


@query(
    "F24",
    sql=f"""WITH s AS (SELECT o_orderkey AS prompt_id, 'You are a support agent.' || chr(10) || chr(10) || 'Support Requirements:' || chr(10) || 'Customers may request a refund within 30 days of purchase if product usage remains within trial limits.' || chr(10)
      || 'Before processing refunds, agents must verify order ID, customer email, and ' || {_ITEM} || '.' || chr(10) || 'Refunds exceeding ' || {_LIMIT} || ' require Finance approval.' || chr(10) || chr(10)
      || 'Customer Ticket:' || chr(10) || 'Order ID: ORD-' || CAST(o_orderkey AS STRING) || chr(10) || 'Refund amount: $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || chr(10) || chr(10)
      || 'Agent Reminder:' || chr(10) || CASE o_orderkey % 3 WHEN 0 THEN 'Do not promise refund approval.' || chr(10) || 'Inform the customer that the request is under review.' WHEN 1 THEN 'Inform the customer that the request is under review.'
        ELSE 'Mention that refunds above $750 require Finance approval.' END || chr(10) || chr(10) || 'Task:' || chr(10) || 'Write a reply.' AS rolled FROM orders), p AS ({S.DERIVED['support_prompts'].sql()})
    SELECT prompt_id, CASE WHEN {S.tokens('rolled')} < {S.tokens('text')} THEN rolled END AS rolled FROM s JOIN p USING (prompt_id)""",
)
def support_rollup(t):
    return evidence.support_rollup(t.derived("support_prompts"), _KEYS).select("prompt_id", "rolled")


@query(
    "B13",
    sql=rf"""WITH {_PROMPTS}, {_lines(L.TYPED_HEADER)}, s AS (SELECT prompt_id, count(*) AS sections, count(*) FILTER (WHERE regexp_matches(lower(label), 'question|task|ticket|request')) AS variable_sections,
      count(*) FILTER (WHERE label IS NULL OR (NOT regexp_matches(lower(label), 'question|task|ticket|request') AND regexp_matches(lower(label), 'instructions?|reminder|system'))) AS instruction_sections FROM body WHERE body <> '' GROUP BY prompt_id)
    SELECT prompt_id, {S.tokens('text')} AS tokens, CAST(len({S.sentences('text')}) AS INT) AS sentences, CAST(sections AS INT) AS sections, CAST(sections - variable_sections - instruction_sections AS INT) AS context_sections,
      CAST(instruction_sections AS INT) AS instruction_sections, CAST(variable_sections AS INT) AS variable_sections FROM chunk_prompts JOIN s USING (prompt_id)""",
)
def text_profiles(t):
    return evidence.with_profile(t.derived("chunk_prompts")).select(
        "prompt_id", "tokens", "sentences", "sections", "context_sections", "instruction_sections", "variable_sections"
    )
