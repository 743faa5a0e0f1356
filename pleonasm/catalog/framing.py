"""Queries on repeated frames, partners, conflicts and blocked items.

As in `extraction`, the check side works from the columns the notes were made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pleonasm.catalog import query
from pleonasm.catalog import sqltext as S
from pleonasm.functions import slots
from pleonasm.operators import conflicts, frames

_K, _C = "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)"
_SCOPE = ["prompt_id"]


def _listing(source: str, keys: str, item: str, extra: str = "") -> str:
    """Ordered distinct items per group with first position and number of sentences."""
    return f"""src AS ({source}), firsts AS (SELECT {keys}, {item} AS item, min(pos) AS item_pos FROM src GROUP BY {keys}, {item}),
    ordered AS (SELECT {keys}, list(item ORDER BY item_pos) AS items FROM firsts GROUP BY {keys}),
    sized AS (SELECT {keys}, min(pos) AS first_pos, count(*) AS sentences{extra} FROM src GROUP BY {keys}),
    g AS (SELECT * FROM ordered JOIN sized USING ({keys}))"""


_VERIFY_ITEMS = (
    "CASE CAST(floor(o_orderkey / 11) AS BIGINT) % 5 WHEN 0 THEN ['order ID'] WHEN 1 THEN ['customer email']"
    " WHEN 2 THEN ['purchase date', 'refund reason'] WHEN 3 THEN ['product SKU'] ELSE ['order ID'] END"
)


@query(
    "F10",
    sql=f"""WITH n AS (SELECT o_custkey AS prompt_id, o_orderkey AS pos, {_VERIFY_ITEMS} AS l FROM orders WHERE o_orderkey % 11 = 0),
    x AS (SELECT prompt_id, pos, unnest(l) AS item, unnest(generate_series(1, len(l))) AS i FROM n),
    f AS (SELECT prompt_id, item, min((pos, i)) AS spot FROM x GROUP BY prompt_id, item),
    o AS (SELECT prompt_id, list(item ORDER BY spot) AS items FROM f GROUP BY prompt_id),
    s AS (SELECT prompt_id, min(pos) AS first_pos, count(*) AS sentences FROM n GROUP BY prompt_id)
    SELECT prompt_id, first_pos, sentences, 'Agents must verify ' || {S.render_list('items')} || '.' AS merged FROM o JOIN s USING (prompt_id) WHERE sentences >= 2 OR len(items) >= 2""",
)
def verify_lists(t):
    return frames.fold_report(t.derived("frame_notes"), _SCOPE, frames.verify_fold())


@query(
    "F11",
    sql=f"""WITH {_listing(f"SELECT o_custkey AS prompt_id, o_orderkey AS pos, 'Job J-' || {_K} AS subject, CASE WHEN o_orderkey % 22 < 11 THEN 'were deleted' ELSE 'were migrated' END AS predicate FROM orders WHERE o_orderkey % 11 = 3", 'prompt_id, predicate', 'subject')}
    SELECT prompt_id, first_pos, sentences, 'Do not claim ' || {S.render_list('items')} || ' ' || predicate || '.' AS merged FROM g WHERE len(items) >= 2""",
)
def do_not_claim_lists(t):
    return frames.fold_report(t.derived("frame_notes"), _SCOPE, frames.do_not_claim_fold())


@query(
    "F12", "C24", "E9",
    sql=f"""WITH {_listing(f"SELECT o_custkey AS prompt_id, o_orderkey AS pos, CASE o_orderkey % 11 WHEN 1 THEN 'Affected cohorts' ELSE 'Healthy biomarkers' END AS frame, CASE o_orderkey % 11 WHEN 1 THEN 'C-' ELSE 'B-' END || {_K} AS id FROM orders WHERE o_orderkey % 11 IN (1, 2)", 'prompt_id, frame', 'id')}
    SELECT prompt_id, first_pos, sentences, frame || ': ' || {S.render_list('items')} || '.' AS merged FROM g WHERE len(items) >= 2""",
)
def item_lists(t):
    return frames.fold_report(t.derived("frame_notes"), _SCOPE, frames.item_fold())


_SLOT_SOURCE = f"""SELECT o_custkey AS prompt_id, o_orderkey AS pos, o_orderkey % 11 AS kind, CASE o_orderkey % 11 WHEN 8 THEN 'P-' || {_K}
  ELSE CAST(o_orderkey % 9 + 1 AS STRING) || CASE WHEN o_orderkey % 22 < 11 THEN ' billing complaints' ELSE ' login complaints' END END AS id FROM orders WHERE o_orderkey % 11 IN (8, 9)"""


@query(
    "F13",
    sql=f"""WITH {_listing(_SLOT_SOURCE, 'prompt_id, kind', 'id')} SELECT prompt_id, first_pos, sentences,
      CASE kind WHEN 8 THEN 'Policies ' || {S.render_list('items')} || ' were reviewed.' ELSE 'Support logged ' || {S.render_list('items')} || '.' END AS merged FROM g WHERE len(items) >= 2""",
)
def slot_lists(t):
    return frames.fold_report(frames.with_slots(t.derived("frame_notes"), _SCOPE), _SCOPE, frames.slot_fold())


@query(
    "F14", "E12",
    sql=f"""WITH {_listing(f"SELECT o_custkey AS prompt_id, o_orderkey AS pos, CASE o_orderkey % 10 WHEN 1 THEN 'is degraded' ELSE 'is not offline' END AS predicate FROM orders WHERE o_orderkey % 10 IN (1, 2)", 'prompt_id', 'predicate')}
    SELECT prompt_id, first_pos, sentences, 'Service CACHE-' || CAST(prompt_id AS STRING) || ' ' || {S.render_list('items')} || '.' AS merged FROM g WHERE len(items) >= 2""",
)
def status_lists(t):
    return frames.fold_report(t.derived("status_notes"), _SCOPE, frames.status_fold())


_NEGATIVE = """SELECT o_custkey AS prompt_id, o_orderkey AS pos, o_orderkey % 10 AS kind, CASE WHEN o_orderkey % 10 = 5 THEN CASE WHEN o_orderkey % 20 < 10 THEN 'deleted' ELSE 'exposed' END
  ELSE CASE WHEN o_orderkey % 20 < 10 THEN 'modified' ELSE 'deleted' END END AS state FROM orders WHERE o_orderkey % 10 IN (5, 6)"""


@query(
    "F15",
    sql=f"""WITH {_listing(_NEGATIVE, 'prompt_id, kind', 'state')} SELECT prompt_id, first_pos, sentences,
      CASE kind WHEN 5 THEN 'No customer records were ' || {S.render_list('items', 'or')} || '.' ELSE 'Backup files were not ' || array_to_string(items, ' and were not ') || '.' END AS merged FROM g WHERE len(items) >= 2""",
)
def negative_lists(t):
    return frames.fold_report(t.derived("status_notes"), _SCOPE, frames.negative_fold())


@query(
    "F16", "D13",
    sql="""WITH n AS (SELECT o_custkey AS prompt_id, count(*) FILTER (WHERE o_orderkey % 11 = 4) AS sentences, min(o_orderkey) FILTER (WHERE o_orderkey % 11 = 4) AS first_pos,
      count(*) FILTER (WHERE o_orderkey % 11 = 5) AS conflicts FROM orders GROUP BY 1)
    SELECT prompt_id, first_pos, sentences, 'Do not merge these conflicts in the ledger.' AS merged FROM n WHERE sentences >= 3 AND conflicts >= 2""",
)
def conflict_warnings(t):
    rows = frames.with_conflict_count(t.derived("frame_notes"), _SCOPE)
    return frames.fold_report(rows, _SCOPE, frames.warning_fold())


@query(
    "D13",
    sql="SELECT o_custkey AS prompt_id, count(*) AS sentences, count(*) FILTER (WHERE o_orderkey % 11 = 5) AS conflict_sentences FROM orders GROUP BY 1",
)
def conflict_context(t):
    rows = frames.with_conflict_count(t.derived("frame_notes"), _SCOPE)
    return rows.groupBy("prompt_id").agg(F.count("*").alias("sentences"), F.max("_conflicts").alias("conflict_sentences"))


@query(
    "E6", "J5",
    sql=f"""WITH p AS (SELECT o_custkey AS prompt_id FROM orders WHERE o_orderkey % 11 = 6 AND o_orderkey % 22 >= 11 GROUP BY 1)
    SELECT prompt_id, o_orderkey AS pos, 'Formula y = x + ' || {_C} || ' must be preserved exactly.' AS kept FROM orders JOIN p ON prompt_id = o_custkey WHERE o_orderkey % 11 = 6 AND o_orderkey % 22 < 11""",
)
def superfluous_formula_notes(t):
    return frames.formula_notes(t.derived("frame_notes"), _SCOPE).filter("kept IS NOT NULL").select("prompt_id", "pos", "kept")


@query(
    "E7", "J5",
    sql=f"""WITH p AS (SELECT o_custkey AS prompt_id FROM orders WHERE o_orderkey % 11 = 7 AND o_orderkey % 22 >= 11 GROUP BY 1)
    SELECT prompt_id, o_orderkey AS pos, 'Server N-' || {_C} || ' failed over because the disk was full.' AS kept FROM orders JOIN p ON prompt_id = o_custkey WHERE o_orderkey % 11 = 7 AND o_orderkey % 22 < 11""",
)
def because_clauses(t):
    return frames.because_clauses(t.derived("frame_notes"), _SCOPE).filter("kept IS NOT NULL").select("prompt_id", "pos", "kept")


@query(
    "E5",
    sql=f"""WITH w AS (SELECT o_custkey, 2 * o_orderkey + 1 AS warning_pos, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS k FROM orders)
    SELECT o.o_custkey AS prompt_id, 2 * o_orderkey AS fact_pos, min(warning_pos) AS warning_pos, 'Order ORD-' || {_K} || ' was not deleted; do not claim it was deleted.' AS fused
    FROM orders o JOIN w ON w.o_custkey = o.o_custkey AND w.k = o_orderkey GROUP BY o.o_custkey, o_orderkey""",
)
def fused_warnings(t):
    notes = t.derived("warning_notes")
    rows = notes.select("prompt_id", F.col("fact_pos").alias("pos"), F.col("fact").alias("sentence")).unionByName(
        notes.select("prompt_id", F.col("warning_pos").alias("pos"), F.col("warning").alias("sentence"))
    )
    return frames.fused_warnings(rows, _SCOPE)


@query(
    "E8",
    sql="""SELECT CAST(floor(o_orderkey / 3) AS BIGINT) AS prompt_id, o_orderkey AS pos FROM orders a WHERE o_orderkey % 3 = 2 AND EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey - 1)
    UNION ALL SELECT CAST(floor(o_orderkey / 3) AS BIGINT), o_orderkey FROM orders a WHERE o_orderkey % 3 = 0 AND (o_orderkey + 1) % 2 = 0 AND EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey + 1)""",
)
def sentences_listed_already(t):
    return frames.listed_already(t.derived("list_notes"), _SCOPE).filter("covered").select("prompt_id", "pos")


@query(
    "E9",
    sql="""WITH b AS (SELECT o_custkey AS prompt_id, true AS hit FROM orders WHERE o_orderkey % 4 = 2 GROUP BY 1)
    SELECT o_custkey AS prompt_id, o_orderkey AS pos, o_orderkey % 4 = 0 AND coalesce(hit, false) AS blocked FROM orders LEFT JOIN b ON prompt_id = o_custkey WHERE o_orderkey % 4 IN (0, 1)""",
)
def blocked_items(t):
    item = slots.slot(F.col("sentence"))["entity_id"]
    marked = frames.with_blocked_items(t.derived("mention_notes"), _SCOPE, item)
    return marked.filter(item.isNotNull()).select("prompt_id", "pos", F.col("_blocked").alias("blocked"))


@query(
    "E10",
    sql=f"""WITH s AS (SELECT o_custkey AS prompt_id, count(*) FILTER (WHERE o_orderkey % 10 = 3) AS a, count(*) FILTER (WHERE o_orderkey % 10 = 4) AS i,
      count(*) FILTER (WHERE o_orderkey % 20 = 8) AS m, count(*) FILTER (WHERE o_orderkey % 20 = 18) AS n FROM orders GROUP BY 1)
    SELECT prompt_id, 'region:r-' || CAST(prompt_id AS STRING) AS subject, 'active' AS "left", 'inactive' AS "right" FROM s WHERE a > 0 AND i > 0
    UNION ALL SELECT prompt_id, 'shard s-' || CAST(prompt_id AS STRING), 'migrated', 'not_migrated' FROM s WHERE m > 0 AND n > 0""",
)
def contradicting_events(t):
    return conflicts.contradicting_events(t.derived("status_notes"), _SCOPE)


@query(
    "E12",
    sql="""SELECT o_custkey AS prompt_id, 'shard s-' || CAST(o_custkey AS STRING) AS subject, 'was migrated' AS "left", 'was not migrated' AS "right" FROM orders WHERE o_orderkey % 10 = 8
    GROUP BY o_custkey HAVING bool_or(o_orderkey % 20 = 8) AND bool_or(o_orderkey % 20 = 18)""",
)
def conflicting_statuses(t):
    return conflicts.conflicting_statuses(t.derived("status_notes"), _SCOPE)


@query(
    "E14",
    sql=rf"""WITH {S.source('theme_notes')}, m AS (SELECT prompt_id, lower(sentence) AS s FROM theme_notes)
    SELECT prompt_id, count(*) AS sentences,
      bool_or(regexp_matches(s, '\b(?:costs?|spending|expenses|expenditures)\s+(?:decreased|reduced|lowered)')) AND bool_or(regexp_matches(s, '\b(?:costs?|spending|expenses|expenditures)\s+(?:increased|raised|rose)')) AS cost_conflict,
      bool_or(regexp_matches(s, '\bdecreased\b')) AND bool_or(regexp_matches(s, '\bincreased\b')) AS direction_conflict,
      bool_or(regexp_matches(s, '\b(?:no|not|never|cannot|without)\b')) AND bool_or(NOT regexp_matches(s, '\b(?:no|not|never|cannot|without)\b')) AS polarity_mix FROM m GROUP BY prompt_id""",
)
def mixed_themes(t):
    return conflicts.mixed_groups(t.derived("theme_notes"), _SCOPE)


@query(
    "E14",
    sql="""WITH s AS (SELECT o_custkey AS prompt_id, bool_or(o_orderkey % 9 = 2) AS f, bool_or(o_orderkey % 9 = 3) AS r FROM orders GROUP BY 1) SELECT 0::BIGINT AS reversed_pairs, count(*) AS prompts FROM s""",
)
def reversed_comparisons(t):
    notes = t.derived("claim_notes")
    found = conflicts.reversed_comparisons(notes, _SCOPE).agg(F.count("*").alias("reversed_pairs"))
    # Every note of a prompt compares its two names in one direction, so none may be found.
    return found.crossJoin(F.broadcast(notes.agg(F.count_distinct("prompt_id").alias("prompts"))))
