"""Queries that pull facts, states, events and tags out of sentences.

The notes are built from order columns, so the check side states the expected finding of each kind
of note directly from those columns instead of searching the text again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.catalog import query
from pleonasm.catalog import sqltext as S
from pleonasm.functions import events, numbers, signals, slots, text as T
from pleonasm.functions import arrays as A
from pleonasm.operators import facts, rows
from pleonasm.sources.derived import DERIVED

_ID = "o_custkey AS prompt_id, o_orderkey AS pos"
_K, _C = "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)"
_P = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_D = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_W = "strftime(o_orderdate, '%B %-d, %Y')"


def _cases(selector: str, *branches: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches))
    return f"CASE {selector} {whens} END"


def _joined(column) -> F.Column:
    return F.array_join(F.array_sort(column), "|")


def _note(t, name: str, **columns):
    return t.derived(name).select("prompt_id", "pos", *[c.alias(n) for n, c in columns.items()])


def _sentence() -> F.Column:
    return F.col("sentence")

# --- facts ----------------------------------------------------------------------------------------------

_WORDS_1000 = "(o_orderkey % 1000)"


def _fact_rows(*branches: str) -> str:
    """Rows from a list of [kind, value, canon] triples per note."""
    return f"""SELECT {_ID}, f[1] AS kind, f[2] AS value, f[3] AS canon FROM (
      SELECT *, unnest({_cases('o_orderkey % 8', *branches)}) AS f FROM orders)"""


def _words(n: str) -> str:
    from pleonasm.sources.derived import number_words

    return number_words(n)


_HALF = "o_orderkey % 16 < 8"


@query(
    "C1", "C5",
    sql=_fact_rows(
        f"[['date', {_D}, {_D}], ['date', {_W}, {_D}], ['money', '$' || {_P}, {_P}], ['id', 'ORD-' || {_K}, 'ORD-' || {_K}]]",
        f"[['percentage', CASE WHEN {_HALF} THEN '83%' ELSE 'eighty-three percent' END, '83']]",
        "CAST([] AS VARCHAR[][])",
        f"[['email', 'ops' || {_C} || '@example.com', 'ops' || {_C} || '@example.com'], ['legal_clause', 'Clause 4.2', 'Clause 4.2']]",
        "[['time', '9:30 PM', '09:30:pm'], ['time', 'ten thirty PM', '10:30:pm']]",
        f"[['money', {_words('(o_orderkey % 1000)')} || ' dollars', CAST(o_orderkey % 1000 AS STRING)]]",
        f"[['date', {_D}, {_D}]]",
        f"[['url', 'https://example.com/orders/' || {_K}, 'https://example.com/orders/' || {_K}]]",
    ),
)
def typed_facts(t):
    return facts.typed_facts(t.derived("fact_notes"), ["prompt_id", "pos"], "sentence")


def _masked_counts() -> str:
    """Counts per kind with the same order of kinds."""
    steps, text = [], "text"
    for kind, pattern in L.FACT_PATTERNS:
        if kind == "equation":  # last of all kinds, so what stands behind it may be read with it
            steps.append((kind, r"(?i)(\b[a-zA-Z]\s*(?:\([a-zA-Z]\))?\s*=\s*[-+*/^(). 0-9a-zA-Z]*?)(?:\s+(?:appears|must)\b|[.,;:]|\n?\z)"))
            continue
        if kind == "json_block":
            pattern = r"(?s)(?:\{(?:[^{}]|(?:\{[^{}]*\}))*\}|\[(?:[^\[\]]|(?:\[[^\[\]]*\]))*\])"
        steps.append((kind, f"(?i){pattern}"))
    ctes, previous = [], "documents"
    columns = []
    for i, (kind, pattern) in enumerate(steps):
        ctes.append(
            f"m{i} AS (SELECT * REPLACE (regexp_replace(text, {S.q(pattern)}, '__PROTECTED_0__', 'g') AS text),"
            f" list_filter(regexp_extract_all(text, {S.q(pattern)}, {int(kind == 'equation')}), lambda v: NOT starts_with(v, '__PROTECTED_')) AS c{i} FROM {previous})"
        )
        previous = f"m{i}"
        columns.append(f"SELECT source, '{kind}' AS kind, unnest(c{i}) AS value FROM {{last}}")
    union = " UNION ALL ".join(c.format(last=previous) for c in columns)
    return f"WITH {', '.join(ctes)} SELECT source, kind, count(*) AS facts, count(DISTINCT value) AS distinct_facts FROM ({union}) GROUP BY source, kind"


@query("C1", sql=_masked_counts())
def fact_counts_by_source(t):
    found = facts.typed_facts(t.documents, ["source"])
    return found.groupBy("source", "kind").agg(F.count("*").alias("facts"), F.count_distinct("value").alias("distinct_facts"))


@query(
    "C2",
    sql=f"""SELECT {_ID}, {_cases('o_orderkey % 8',
      "'Order __PROTECTED_2__ closed at __PROTECTED_1__ on __PROTECTED_0__ and again on __PROTECTED_0__.'",
      "'The rollout paused at __PROTECTED_0__ for region us-east-1.'",
      "'Write latency increased from 12 ms to ' || CASE WHEN o_orderkey % 16 < 8 THEN '28 ms' ELSE 'twenty-eight ms' END || '.'",
      f"'Contact __PROTECTED_0__ about __PROTECTED_1__ of policy_' || {_C} || '_main.'",
      "'The call starts at __PROTECTED_0__ and ends at __PROTECTED_1__.'",
      f"'The fee was __PROTECTED_0__ and took ' || {_words('(o_orderkey % 60)')} || ' minutes.'",
      f"'Scan of node N-' || {_C} || ' started on __PROTECTED_0__ and took 5 minutes.'",
      f"'See __PROTECTED_0__ for CUSIP 0378' || {_C} || '.'")} AS masked,
      CAST({_cases('o_orderkey % 8', '3', '1', '0', '2', '2', '1', '1', '1')} AS INT) AS regions, o_orderkey % 8 <> 0 AS restored_exactly FROM orders""",
)
def masked_texts(t):
    masked = facts.with_masked_text(t.derived("fact_notes"), "sentence")
    back = facts.restored(F.col("masked"), F.col("regions"))
    # A date written twice in two ways shares one placeholder and comes back in its first form.
    return masked.select(
        "prompt_id", "pos", "masked", F.size("regions").alias("regions"), (back == _sentence()).alias("restored_exactly")
    )


_SENSITIVE = _cases(
    "o_orderkey % 8",
    f"['date=' || {_D}, 'date=' || {_W}, 'id=ORD-' || {_K}, 'money=$' || {_P}, 'number=' || {_K}, 'number=' || {_P}]",
    f"CASE WHEN {_HALF} THEN ['number=1', 'number=83', 'percentage=83%'] ELSE ['number=1', 'percentage=eighty-three percent'] END",
    f"CASE WHEN {_HALF} THEN ['number=12', 'number=28'] ELSE ['number=12'] END",
    f"['email=ops' || {_C} || '@example.com', 'legal_clause=Clause 4.2', 'number=4.2']",
    "['number=30', 'number=9', 'time=9:30 PM', 'time=ten thirty PM']",
    f"['money=' || {_words(_WORDS_1000)} || ' dollars']",
    f"['date=' || {_D}, 'number=' || {_C}, 'number=5']",
    f"['number=' || {_K}, 'number=0378' || {_C}, 'url=https://example.com/orders/' || {_K}]",
)


@query("C4", "I3", sql=f"SELECT {_ID}, array_to_string(list_sort(list_distinct({_SENSITIVE})), '|') AS facts FROM orders")
def sensitive_facts(t):
    pairs = F.transform(facts.sensitive_facts(_sentence()), lambda f: F.concat_ws("=", f["kind"], f["value"]))
    return _note(t, "fact_notes", facts=_joined(pairs))


@query("C6", sql="SELECT event_id, event_id % 1000 AS number FROM events")
def number_words(t):
    return t.derived("number_phrases").select("event_id", numbers.number_value(F.col("phrase")).alias("number"))


_LIGHT = _cases(
    "o_orderkey % 8",
    f"['raw:ORD-' || {_K}, 'raw:$' || {_P}, 'raw:' || {_D}]",
    "['percent:83', 'raw:us-east-1']",
    "['measure:12:ms', 'measure:28:ms']",
    f"['raw:ops' || {_C} || '@example.com', 'raw:policy_' || {_C} || '_main']",
    "['raw:9:30 PM']",
    "['duration:' || CAST(o_orderkey % 60 AS STRING) || ':minute']",
    f"['duration:5:minute', 'raw:N-' || {_C}, 'raw:' || {_D}]",
    f"['raw:CUSIP 0378' || {_C}, 'raw:https://example.com/orders/' || {_K}]",
)


@query(
    "C7", "C8",
    sql=f"""WITH k AS (SELECT *, {_LIGHT} AS keys FROM orders) SELECT {_ID}, array_to_string(list_sort(keys), '|') AS fact_keys,
      array_to_string(list_sort(list_filter(keys, lambda x: starts_with(x, 'raw:'))), '|') AS identity_keys FROM k""",
)
def light_fact_keys(t):
    keyed = _note(t, "fact_notes", k=signals.light_fact_keys(_sentence()))
    return keyed.select(
        "prompt_id", "pos", _joined(F.col("k")).alias("fact_keys"), _joined(signals.identity_keys(F.col("k"))).alias("identity_keys")
    )


# --- states, risks, events ------------------------------------------------------------------------------------

_LOW_HALF = "o_orderkey % 20 < 10"
_STATES = _cases(
    "o_orderkey % 10", "''", "'degraded'", "'not_offline'", "''", "'inactive'",
    f"CASE WHEN {_LOW_HALF} THEN 'deleted|not_deleted' ELSE 'not_exposed' END",
    f"CASE WHEN {_LOW_HALF} THEN 'not_modified' ELSE 'not_deleted' END",
    "'pending'", f"CASE WHEN {_LOW_HALF} THEN '' ELSE 'not_migrated' END", "'not_approved'",
)
_RISKS = _cases(
    "o_orderkey % 10", "''", "'degraded'", "'not|offline'", "''", "'inactive'", "'no'", "'not'", "'pending'",
    f"CASE WHEN {_LOW_HALF} THEN '' ELSE 'not' END", "'however|not'",
)
_ROLES = _cases(
    "o_orderkey % 10", "'other'", "'factual_state'", "'factual_state'", "'factual_state'", "'factual_state'",
    "'factual_state'", "'factual_state'", "'factual_state'", "'factual_state'", "'other'",
)


@query("C9", "C14", "C18", sql=f"SELECT {_ID}, {_STATES} AS states, {_RISKS} AS risks, {_ROLES} AS role FROM orders")
def states_and_risks(t):
    return _note(
        t, "status_notes", states=_joined(signals.state_signatures(_sentence())), risks=_joined(signals.risk_markers(_sentence())),
        role=signals.sentence_role(_sentence()),
    )


STATUS_EVENTS = _cases(
    "o_orderkey % 10",
    f"'event::order ord-' || {_K} || '::reviewed'",
    f"'event::service:cache-' || {_C} || '::degraded'",
    f"'event::service:cache-' || {_C} || '::not_offline'",
    f"'event::region:r-' || {_C} || '::active'",
    f"'event::region:r-' || {_C} || '::inactive'",
    "''",
    f"CASE WHEN {_LOW_HALF} THEN '' ELSE 'event::backup files::not_deleted' END",
    f"'event::order ord-' || {_K} || '::pending'",
    f"'event::shard s-' || {_C} || CASE WHEN {_LOW_HALF} THEN '::migrated' ELSE '::not_migrated' END",
    "''",
)


@query("C10", "C12", sql=f"SELECT {_ID}, {STATUS_EVENTS} AS events FROM orders")
def status_events(t):
    return _note(t, "status_notes", events=_joined(events.event_signatures(_sentence())))


@query(
    "C10", "C13",
    sql=f"""SELECT {_ID}, {_cases('o_orderkey % 8', "''", "'event::rollout::paused::percent:83'",
      "'event::write latency::increased::measure:12:ms->measure:28:ms'", "''", "''", "''",
      f"'event::scan of node n-' || {_C} || '::started::duration:5:minute|event::scan of node n-' || {_C} || '::started::raw:' || {_D}", "''")} AS events,
      {_cases('o_orderkey % 8', f"'raw:' || {_D}", "'percent:83'", "'measure:12:ms|measure:28:ms'", "''", "''",
      "'duration:' || CAST(o_orderkey % 60 AS STRING) || ':minute'", f"'raw:' || {_D} || '|duration:5:minute'", "''")} AS event_values FROM orders""",
)
def measured_events(t):
    return _note(
        t, "fact_notes", events=_joined(events.event_signatures(_sentence())),
        event_values=F.array_join(signals.event_values(_sentence()), "|"),
    )


@query(
    "C11",
    sql=f"""SELECT {_ID}, {_cases('o_orderkey % 6', f"'event::cohort:c-' || {_K} || '::affected|event::cohort:d1::affected'",
      f"'event::policy:p-' || {_K} || '::reviewed|event::policy:q-7::reviewed'", f"'event::flight:f-' || {_K} || '::operational'",
      f"'event::routing_table:zone a1::migrated|event::routing_table:zone-' || {_K} || '::migrated|event::zone a1 and zone-' || {_K} || ' routing tables::migrated'",
      f"'event::note_pool:pool {_K}::excluded'".replace(_K, "' || " + _K + " || '"), f"'event::biomarker:b-' || {_K} || '::healthy'")} AS events FROM orders""",
)
def list_events(t):
    k = F.col("o_orderkey").cast("string")
    forms = [
        F.concat(F.lit("Affected cohorts: C-"), k, F.lit(" and D1.")),
        F.concat(F.lit("Policies P-"), k, F.lit(" and Q-7 were reviewed.")),
        F.concat(F.lit("Flight F-"), k, F.lit(" is operational.")),
        F.concat(F.lit("Zone-A1 and Zone-"), k, F.lit(" routing tables were migrated.")),
        F.concat(F.lit("The Pool "), k, F.lit(" note pool is excluded from migration.")),
        F.concat(F.lit("Biomarker B-"), k, F.lit(" is healthy.")),
    ]
    sentence = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6).cast("int") + 1)
    return t.orders.select(
        F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").alias("pos"), _joined(events.event_signatures(sentence)).alias("events")
    )


@query(
    "C23",
    sql=f"""SELECT {_ID}, {_cases('o_orderkey % 11', "NULL", f"'slot::cohort::c-' || {_K} || '::::were affected::affected::positive::other'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL",
      f"'slot::policy::p-' || {_K} || '::::were reviewed::reviewed::positive::other'",
      "'logged::support::' || CAST(o_orderkey % 9 + 1 AS STRING) || CASE WHEN o_orderkey % 22 < 11 THEN '::billing' ELSE '::login' END || '::other'", "NULL")} AS signature FROM orders""",
)
def list_slots(t):
    return _note(t, "frame_notes", signature=A.let(slots.slot(_sentence()), lambda s: F.when(s.isNotNull(), slots.signature(s))))


# --- tags and fingerprints --------------------------------------------------------------------------------------


def _b(words) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def _m(column: str, words) -> str:
    return f"regexp_matches(lower({column}), {S.q(_b(words))})"


_NOTES = f"{S.source('status_notes')}, {S.source('theme_notes')}, notes AS (SELECT 'status' AS origin, * FROM status_notes UNION ALL SELECT 'theme', * FROM theme_notes)"


def _notes(t):
    named = lambda origin, name: t.derived(name).select(F.lit(origin).alias("origin"), "prompt_id", "pos", "sentence")
    return named("status", "status_notes").unionByName(named("theme", "theme_notes"))


@query(
    "C16", "C17",
    sql=f"""WITH {_NOTES}, tags AS (SELECT origin,
      CASE WHEN {_m('sentence', ['not', 'never', 'cannot', "can't", 'must not', 'prohibited', 'denied', 'unreliable', 'harder', 'worse', 'slower'])} THEN 'negative' ELSE 'positive' END AS polarity,
      CASE WHEN {_m('sentence', ['will', 'must', 'shall', 'definitely', 'certainly'])} THEN 'certain' WHEN {_m('sentence', ['might', 'may', 'could', 'possible', 'possibly', 'potentially'])} THEN 'uncertain' ELSE 'neutral' END AS cluster_modality,
      CASE WHEN {_m('sentence', ['might', 'may', 'could', 'possible', 'possibly', 'uncertain', 'potentially'])} THEN 'uncertain' WHEN {_m('sentence', ['will', 'must', 'shall', 'definitely', 'certainly'])} THEN 'certain' ELSE 'neutral' END AS family_modality,
      CASE WHEN {_m('sentence', ['must', 'shall', 'required', 'need to', 'needs to'])} THEN 'must' WHEN {_m('sentence', ['should'])} THEN 'should' WHEN {_m('sentence', ['might', 'may', 'could', 'possible', 'possibly'])} THEN 'uncertain' WHEN {_m('sentence', ['will', 'definitely', 'certainly'])} THEN 'certain' ELSE 'neutral' END AS proposition_modality,
      regexp_matches(sentence, '(?i)^\\s*(?:however|but|although|though|nevertheless)\\b') AS contrast,
      {_m('sentence', ['no', 'not', 'never', 'cannot', "can't", "won't", 'unable', 'without', 'should not', 'must not'])} AS negated,
      {_m('sentence', ['may', 'might', 'could', 'possibly', 'probably', 'generally', 'often', 'usually', 'sometimes'])} AS uncertain,
      CASE WHEN {_m('sentence', ['verify', 'confirm', 'check', 'validate'])} THEN 'verify' WHEN {_m('sentence', ['apologize', 'apology'])} THEN 'apology' WHEN {_m('sentence', ['built', 'build', 'created', 'made'])} THEN 'build' WHEN {_m('sentence', ['tested', 'test', 'validated'])} THEN 'test' ELSE 'generic' END AS action,
      CASE WHEN {_m('sentence', ['what can i do', 'can i do', 'need help', 'help me', 'what should i'])} THEN 'user_intent' ELSE 'none' END AS intent,
      CASE WHEN {_m('sentence', ['hallucinations?', 'errors?', 'quality loss', 'reduce response quality', 'accuracy loss'])} THEN 'quality_risk' WHEN {_m('sentence', ['costs?', 'expenses?', 'spending', 'token costs?'])} THEN 'cost' ELSE 'other' END AS effect FROM notes)
    SELECT *, count(*) AS sentences FROM tags GROUP BY ALL""",
)
def tag_counts(t):
    s = _sentence()
    tags = {
        "polarity": signals.cluster_polarity(s), "cluster_modality": signals.cluster_modality(s),
        "family_modality": signals.family_modality(s), "proposition_modality": signals.proposition_modality(s),
        "contrast": signals.starts_with_contrast(s), "negated": signals.family_negated(s), "uncertain": signals.has_uncertainty(s),
        "action": signals.action_tag(s), "intent": signals.intent_tag(s), "effect": signals.effect_tag(s),
    }
    tagged = _notes(t).select("origin", *[c.alias(n) for n, c in tags.items()])
    return tagged.groupBy("origin", *tags).agg(F.count("*").alias("sentences"))


_SENTENCES = f"sent AS ({S.rows('documents', 'doc_id', S.sentences('text'), 'sentence')})"
# The check engine takes only ASCII letters for words. So every character that is no word character is doubled around a
# mark, which lets one of the pair end a match and the other begin the next, and is taken back out of what was found.
_GAP = r"[^\p{L}\p{Nd}_\p{Mn}]"
_SPREAD = lambda text: f"regexp_replace({text}, '({_GAP})', '\\1' || chr(1) || '\\1', 'g')"
_BLANKS = r"(?:\s\x01\s)+"


def _bounded(text: str, word: str) -> str:
    """All matches of `word` between borders of words, for a text that was spread."""
    return rf"list_transform(regexp_extract_all({text}, '(?:^|{_GAP})({word})(?:$|{_GAP})', 1), lambda v: regexp_replace(v, '(?s)\x01.', '', 'g'))"


def _entity_sql(expression: str) -> str:
    return f"array_to_string(list_sort({expression}), '|')"


_NAMES = _bounded(_SPREAD("sentence"), rf"[A-Z][a-z]+(?:{_BLANKS}[A-Z][a-z]+)*")
_TOLD = rf"list_transform(regexp_extract_all({_SPREAD('sentence')}, '(?i)(?:^|{_GAP})my \x01 name \x01 is{_BLANKS}([a-z](?:[a-z]|''\x01''|-\x01-){{2,}})(?:$|{_GAP})', 1), lambda v: regexp_replace(v, '(?s)\x01.', '', 'g'))"
_CLUSTER_NAMES = _bounded(_SPREAD(r"regexp_replace(sentence, '(?m)^\s*[A-Z][A-Za-z &/-]{1,50}:\s*', ' ', 'g')"), rf"[A-Z][A-Za-z0-9]*(?:{_BLANKS}[A-Z][A-Za-z0-9]*){{0,3}}")


@query(
    "C15", "I3",
    sql=f"""WITH {_SENTENCES} SELECT doc_id, pos, {_entity_sql(f"list_distinct(list_concat({_NAMES}, {_TOLD}))")} AS entities,
      {_entity_sql(f"list_filter({_CLUSTER_NAMES}, lambda v: NOT v IN {S.values(L.CLUSTER_ENTITY_STOP)})")} AS cluster_entities FROM sent""",
)
def sentence_entities(t):
    return _entities(rows.sentence_rows(t.documents, ["doc_id"]))


def _entities(sentences):
    return sentences.select(
        "doc_id", "pos", F.array_join(signals.named_entities(_sentence()), "|").alias("entities"),
        F.array_join(signals.cluster_entities(_sentence()), "|").alias("cluster_entities"),
    )


def _stem_sql(word: str, ing: int, ed: int) -> str:
    return (
        f"CASE WHEN {word} LIKE '%ing' AND length({word}) > {ing} THEN {word}[:-4] WHEN {word} LIKE '%ed' AND length({word}) > {ed} THEN {word}[:-3]"
        f" WHEN {word} LIKE '%s' AND length({word}) > 4 THEN {word}[:-2] ELSE {word} END"
    )


def _map_sql(word: str, table: dict[str, str]) -> str:
    return f"coalesce(MAP {{{', '.join(f'{S.q(k)}: {S.q(v)}' for k, v in table.items())}}}[{word}], {word})"


CLUSTER_PRINT = (
    r"list_sort(list_distinct(list_transform(list_transform(list_filter(regexp_extract_all(lower(regexp_replace(sentence, '(?m)^\s*[A-Z][A-Za-z &/-]{1,50}:\s*', ' ', 'g')), '[A-Za-z0-9''-]+'),"
    f" lambda w: NOT w IN {S.values(L.CLUSTER_STOP)}), lambda w: {_map_sql('w', L.CLUSTER_SYNONYMS)}), lambda w: {_stem_sql('w', 5, 4)})))"
)
FAMILY_PRINT = (
    r"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(regexp_replace(sentence, '(?m)^\s*[A-Z][A-Za-z &/-]{1,50}:\s*', ' ', 'g')), '[A-Za-z][A-Za-z''-]+'),"
    f" lambda w: NOT w IN {S.values(L.FAMILY_STOP)}), lambda w: CASE WHEN w IN {S.values(L.FAMILY_SYNONYMS)} THEN {_map_sql('w', L.FAMILY_SYNONYMS)} ELSE {_stem_sql('w', 6, 5)} END)))"
)


@query(
    "C25",
    sql=f"WITH {_NOTES} SELECT origin, prompt_id, pos, array_to_string({CLUSTER_PRINT}, ' ') AS cluster_print, array_to_string({FAMILY_PRINT}, ' ') AS family_print FROM notes",
)
def fingerprints(t):
    return _notes(t).select(
        "origin", "prompt_id", "pos", F.array_join(signals.cluster_fingerprint(_sentence()), " ").alias("cluster_print"),
        F.array_join(signals.family_fingerprint(_sentence()), " ").alias("family_print"),
    )


# A hyphen may end a keyword only before a letter it does not hold.
_KEYWORDS = rf"list_transform(regexp_extract_all({_SPREAD('lower(sentence)')}, '(?:^|{_GAP})([a-z](?:[a-z]|-\x01-){{2,}}(?:[a-z](?:$|{_GAP})|-\x01-[\p{{L}}\p{{Nd}}_\p{{Mn}}]))', 1), lambda v: regexp_extract(regexp_replace(v, '(?s)\x01.', '', 'g'), '^[a-z-]+'))"


@query(
    "C26",
    sql=f"""WITH {_SENTENCES}, w AS (SELECT doc_id, unnest(list_distinct(list_filter({_KEYWORDS}, lambda w: NOT w IN {S.values(L.KEYWORD_STOP)}))) AS keyword FROM sent)
    SELECT keyword, count(*) AS sentences FROM w GROUP BY keyword""",
)
def keyword_counts(t):
    return _keyword_counts(rows.sentence_rows(t.documents, ["doc_id"]))


def _keyword_counts(sentences):
    words = sentences.select(F.explode(signals.keywords(_sentence())).alias("keyword"))
    return words.groupBy("keyword").agg(F.count("*").alias("sentences"))


@query(
    "C28",
    sql="""SELECT o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 500 AS DOUBLE) WHEN 1 THEN CAST((o_orderkey % 9) * 1000 AS DOUBLE)
      WHEN 2 THEN 100.0::DOUBLE WHEN 3 THEN CASE WHEN o_orderkey % 20 <= 5 THEN 100.0::DOUBLE END END AS latency_ms FROM orders""",
)
def latency_values(t):
    from pleonasm.functions.families import latency_ms

    k = F.col("o_orderkey")
    forms = [
        F.concat(F.lit("Requests completed in under "), (k % 500).cast("string"), F.lit(" ms.")),
        F.concat(F.lit("Latency stayed below "), (k % 9).cast("string"), F.lit(" seconds.")),
        F.lit("The server responded in less than one tenth of a second."),
        F.concat(F.lit("It was under 100 ms and below "), (F.lit(100) + k % 20).cast("string"), F.lit(" ms.")),
    ]
    sentence = F.element_at(F.array(*forms), (k % 4).cast("int") + 1)
    return t.orders.select(k.alias("pos"), latency_ms(sentence).alias("latency_ms"))


# --- comparing two versions -----------------------------------------------------------------------------------


_LOST_AFTER = r"regexp_replace(sentence, '\s(?:at|on|about|for|to) .*$', '.')"


def _rewritten(t, name: str):
    """Notes and a shorter version that loses what follows a preposition."""
    after = F.regexp_replace(_sentence(), r"\s(?:at|on|about|for|to) .*$", ".")
    return t.derived(name).select("prompt_id", "pos", _sentence().alias("before"), after.alias("after"))


@query(
    "E17",
    sql=f"""SELECT {_ID}, {_cases('o_orderkey % 8',
      f"array_to_string(list_sort(list_distinct(['date=' || {_D}, 'date=' || {_W}, 'money=$' || {_P}, 'number=' || {_P}])), '|')",
      f"CASE WHEN {_HALF} THEN 'number=1|number=83|percentage=83%' ELSE 'number=1|percentage=eighty-three percent' END",
      f"CASE WHEN {_HALF} THEN 'number=28' ELSE '' END",
      "'legal_clause=Clause 4.2|number=4.2'", "'number=30|number=9|time=9:30 PM|time=ten thirty PM'", "''",
      f"CASE WHEN o_custkey = 5 THEN 'date=' || {_D} ELSE 'date=' || {_D} || '|number=5' END", f"'number=0378' || {_C}")} AS missing FROM orders""",
)
def missing_facts(t):
    versions = _rewritten(t, "fact_notes").select(
        "prompt_id", "pos", "after", facts.sensitive_facts(F.col("before")).alias("b"), facts.sensitive_facts(F.col("after")).alias("a")
    )
    lost = facts.missing_facts(F.col("b"), F.col("a"), F.col("after"))
    return versions.select("prompt_id", "pos", _joined(F.transform(lost, lambda f: F.concat_ws("=", f["kind"], f["value"]))).alias("missing"))


@query(
    "I2",
    sql=f"""WITH k AS (SELECT o_custkey, array_to_string(list_sort(list_distinct(list_filter({_SENSITIVE}, lambda f: NOT (starts_with(f, 'time=') OR starts_with(f, 'legal_clause='))))), '|') AS facts FROM orders)
    SELECT o_custkey AS prompt_id, facts, count(*) AS notes FROM k GROUP BY ALL HAVING count(*) > 1""",
)
def equal_fact_sets(t):
    keyed = _note(t, "fact_notes", facts=_joined(F.transform(facts.cache_facts(_sentence()), lambda f: F.concat_ws("=", f["kind"], f["value"]))))
    return keyed.groupBy("prompt_id", "facts").agg(F.count("*").alias("notes")).filter("notes > 1")


@query(
    "I1",
    sql=f"""WITH s AS (SELECT {_ID}, string_split({_STATES}, '|') AS states, string_split({_RISKS}, '|') AS risks FROM orders),
    p AS (SELECT prompt_id, pos, states, risks, lead(states) OVER w AS next_states, lead(risks) OVER w AS next_risks FROM s WINDOW w AS (PARTITION BY prompt_id ORDER BY pos))
    SELECT prompt_id, pos, list_has_all(list_concat(next_states, ['']), states) AS states_covered, list_has_all(list_concat(next_risks, ['']), risks) AS risks_covered FROM p WHERE next_states IS NOT NULL""",
)
def covered_by_next(t):
    from pyspark.sql import Window

    order = Window.partitionBy("prompt_id").orderBy("pos")
    marked = _note(t, "status_notes", states=signals.state_signatures(_sentence()), risks=signals.risk_markers(_sentence()))
    paired = marked.withColumn("ns", F.lead("states").over(order)).withColumn("nr", F.lead("risks").over(order))
    subset = lambda small, large: F.size(F.array_except(small, large)) == 0
    return paired.filter(F.col("ns").isNotNull()).select(
        "prompt_id", "pos", subset("states", "ns").alias("states_covered"), subset("risks", "nr").alias("risks_covered")
    )


@query(
    "E22",
    sql=rf"""WITH {S.source('status_notes')}, v AS (SELECT prompt_id, pos, list_distinct(regexp_extract_all(sentence, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')) AS e, lower(sentence[1:1]) || sentence[2:] AS after FROM status_notes),
    m AS (SELECT *, list_filter(e, lambda x: NOT contains(after, x)) AS missing FROM v)
    SELECT prompt_id, pos, CASE WHEN len(e) = 0 THEN 1.0::DOUBLE ELSE round((len(e) - len(missing)) / CAST(len(e) AS DOUBLE), 3) END AS score, array_to_string(list_sort(missing), '|') AS missing FROM m""",
)
def entity_preservation(t):
    after = F.concat(F.lower(F.substring(_sentence(), 1, 1)), F.substring(_sentence(), 2, 1 << 30))
    checked = t.derived("status_notes").select("prompt_id", "pos", facts.entity_preservation(_sentence(), after).alias("p"))
    return checked.select("prompt_id", "pos", "p.score", F.array_join("p.missing", "|").alias("missing"))


@query(
    "E23", "B12",
    sql=f"""SELECT {_ID}, {_cases('o_orderkey % 8', "'__PROTECTED_0__|__PROTECTED_1__'", "'__PROTECTED_0__'", "''", "'__PROTECTED_1__'", "'__PROTECTED_0__|__PROTECTED_1__'", "''", "'__PROTECTED_0__'", "''")} AS missing, '' AS added,
      CAST({_cases('o_orderkey % 8', '9', '3', '1', '5', '5', '3', '3', '3')} AS INT) AS segments FROM orders""",
)
def placeholder_changes(t):
    masked = facts.with_masked_text(t.derived("fact_notes"), "sentence").select("prompt_id", F.col("pos").alias("note"), "masked")
    after = F.regexp_replace("masked", r"\s(?:at|on|about|for|to) .*$", ".")
    pieces = rows.segment_rows(masked, ["prompt_id", "note", "masked"], "masked")
    counted = pieces.groupBy("prompt_id", "note", "masked").agg(F.count("*").cast("int").alias("segments"))
    diff = counted.withColumn("d", facts.placeholder_diff(F.col("masked"), after))
    return diff.select("prompt_id", F.col("note").alias("pos"), F.array_join("d.missing", "|").alias("missing"), F.array_join("d.added", "|").alias("added"), "segments")
