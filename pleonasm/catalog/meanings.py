"""Queries on themes, propositions and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from pleonasm.catalog import query
from pleonasm.catalog import sqltext as S
from pleonasm.catalog.extraction import _cases
from pleonasm import lexicons as L
from pleonasm.functions import families, themes
from pleonasm.operators import meaning

_SCOPE = ["prompt_id"]
_ID = "o_custkey AS prompt_id, o_orderkey AS pos"
_P = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_NOTE = "o_orderkey % 15"
_NONE = "NULL"

_THEME = _cases(
    _NOTE, "'reliability_constraint'", "'reliability_constraint'", "'support_verification'", "'support_verification'", "'product_benefit'",
    "'product_benefit'", "'security_constraint'", "'security_constraint'", "'cloud_cost_optimization'", "'business_outcome'", "'business_outcome'",
    _NONE, _NONE, _NONE, _NONE,
)
_CONCEPTS = _cases(
    _NOTE, "['reliability']", "['availability', 'customer experience']", "['order ID', 'customer email']", "['purchase date', 'product SKU']",
    "['saves time', 'reduces manual work']", "['improves reporting accuracy']", "['API keys', 'secrets']", "['access tokens', 'credentials']",
    "['cloud infrastructure costs', 'compute optimization']", "['cloud spending', 'operating margins', 'financial performance']", "['cloud spending']",
)


@query("C19", sql=f"SELECT {_ID}, {_THEME} AS theme, array_to_string({_CONCEPTS}, '|') AS concepts FROM orders WHERE {_NOTE} <= 10")
def sentence_themes(t):
    return meaning.theme_rows(t.derived("theme_notes"), _SCOPE).select("prompt_id", "pos", "theme", F.array_join("concepts", "|").alias("concepts"))


@query(
    "F18",
    sql=f"""WITH {S.source('theme_notes')}, n AS (SELECT {_ID}, {_THEME} AS theme, {_CONCEPTS} AS l FROM orders WHERE {_NOTE} < 10),
    z AS (SELECT prompt_id, theme, count(*) AS units, CAST(sum({S.tokens('sentence')}) AS BIGINT) AS tokens FROM n JOIN theme_notes USING (prompt_id, pos) GROUP BY prompt_id, theme),
    x AS (SELECT prompt_id, theme, pos, unnest(l) AS concept, unnest(generate_series(1, len(l))) AS i FROM n), f AS (SELECT prompt_id, theme, concept, min((pos, i)) AS spot FROM x GROUP BY ALL),
    o AS (SELECT prompt_id, theme, list(concept ORDER BY spot) AS concepts FROM f GROUP BY ALL)
    SELECT prompt_id, theme, units, tokens, {S.render_list('concepts')} AS concept_list FROM z JOIN o USING (prompt_id, theme)""",
)
def theme_rollup(t):
    return meaning.theme_rollup(meaning.theme_rows(t.derived("theme_notes"), _SCOPE), _SCOPE).drop("concepts")


_PROPOSITION = {
    "theme": _cases(
        _NOTE, "'reliability_constraint'", "'reliability_constraint'", "'support_verification'", "'support_verification'", "'product_benefit'", "'product_benefit'",
        "'security_constraint'", "'security_constraint'", "'business_outcome'", "'business_outcome'", "'business_outcome'", "'access_constraint'", "'deadline_requirement'", "'protected_fact'", _NONE,
    ),
    "subject": _cases(
        _NOTE, "'Reliability'", "'The migration'", "'Agents'", "'Agents'", "'The platform'", "'The product'", "'sensitive information'", "'sensitive information'", "'The company'",
        "'Lower cloud spending'", "'However, cloud costs increased and efficiency'", "'trial users'", "'The team'", "'Invoice total'", _NONE,
    ),
    "relation": _cases(
        _NOTE, "'preserve'", "'must_not_compromise'", "'verify'", "'verify'", "'benefit'", "'benefit'", "'must_not_reveal'", "'must_not_reveal'", "'reduced'", "'improved'", "'reduced'",
        "'cannot_access'", "'submit_by_deadline'", "'states'", _NONE,
    ),
    "modality": _cases(
        _NOTE, "'must'", "'should'", "'must'", "'should'", "'neutral'", "'neutral'", "'must'", "'must'", "'neutral'", "'neutral'", "'neutral'", "'neutral'", "'must'", "'neutral'", _NONE,
    ),
    "polarity": _cases(
        _NOTE, "'positive'", "'negative'", "'positive'", "'positive'", "'positive'", "'positive'", "'negative'", "'negative'", "'positive'", "'positive'", "'positive'", "'negative'", "'positive'", "'positive'", _NONE,
    ),
    "concepts": _cases(
        _NOTE, "'reliability'", "'availability|customer experience'", "'order ID|customer email'", "'purchase date|product SKU'", "'saves time|reduces manual work'", "'improves reporting accuracy'",
        "'API keys|secrets'", "'access tokens|credentials'", "'cloud infrastructure costs|compute optimization|cloud spending'", "'cloud infrastructure costs|cloud spending|operating margins|financial performance'",
        "'cloud infrastructure costs|efficiency improvements|cloud spending'", "'trial users|feature'", "'report|Friday'", "''", _NONE,
    ),
    "quantities": _cases(_NOTE, *["''"] * 9, "'12'", "''", "''", "''", f"'$' || {_P}", _NONE),
    "risk": _cases(_NOTE, "'high'", "'high'", *["'normal'"] * 4, "'high'", "'high'", *["'normal'"] * 3, "'high'", "'normal'", "'high'", _NONE),
    "importance": f"CAST({_cases(_NOTE, '0.95', '0.95', '0.9', '0.9', '0.75', '0.75', '1.0', '1.0', '0.85', '0.85', '0.85', '0.95', '0.85', '1.0', _NONE)} AS DOUBLE)",
}


@query("C20", "C16", sql=f"SELECT {_ID}, {', '.join(f'{e} AS {n}' for n, e in _PROPOSITION.items())} FROM orders WHERE {_NOTE} <> 14")
def propositions(t):
    found = meaning.proposition_rows(t.derived("theme_notes"), _SCOPE)
    return found.select(
        "prompt_id", "pos", "theme", "subject", "relation", "modality", "polarity", F.array_join("concepts", "|").alias("concepts"),
        F.array_join("quantities", "|").alias("quantities"), "risk", "importance",
    )


@query(
    "F17", "E14",
    sql=f"""WITH n AS (SELECT {_ID}, CASE WHEN {_NOTE} IN (8, 9, 10) THEN 'operational_business_outcome' ELSE {_PROPOSITION['theme']} END AS theme, {_PROPOSITION['polarity']} AS polarity, {_NOTE} AS kind FROM orders WHERE {_NOTE} < 13)
    SELECT prompt_id, theme, count(*) AS units FROM n GROUP BY prompt_id, theme HAVING count(*) >= 2 AND (count(DISTINCT polarity) = 1 OR theme = 'reliability_constraint')""",
)
def theme_clusters(t):
    found = meaning.proposition_rows(t.derived("theme_notes"), _SCOPE)
    return meaning.theme_clusters(found, _SCOPE).select("prompt_id", "theme", "units")


_ALIAS_SQL = " OR ".join(f"(item = {S.q(name)} AND regexp_matches({{text}}, {S.q(pattern)}))" for name, pattern in themes._ALIASES.items())
_REWRITE = "Keep reliability, check the order ID, watch cloud spending for trial users by Friday."


@query(
    "F19",
    sql=f"""WITH n AS (SELECT {_ID}, {_PROPOSITION['concepts']} AS concepts, {_PROPOSITION['quantities']} AS quantities FROM orders WHERE {_NOTE} <> 14),
    x AS (SELECT prompt_id, unnest(list_filter(string_split(concepts, '|'), lambda c: c <> '')) AS item, true AS concept FROM n
      UNION ALL SELECT prompt_id, unnest(list_filter(string_split(quantities, '|'), lambda c: c <> '')), false FROM n),
    w AS (SELECT prompt_id, count(*) AS items, count(*) FILTER (CASE WHEN concept THEN contains(lower({S.q(_REWRITE)}), lower(item)) OR {_ALIAS_SQL.format(text='lower(' + S.q(_REWRITE) + ')')} ELSE contains({S.q(_REWRITE)}, item) END) AS held FROM x GROUP BY prompt_id),
    r AS (SELECT prompt_id, items, round(held / CAST(items AS DOUBLE), 3) AS recall FROM w)
    SELECT prompt_id, items, recall, recall >= 0.98 AS enough FROM r""",
)
def information_recall(t):
    """What one rewrite keeps of the notes of every prompt, and whether that is enough to take it."""
    notes = t.derived("theme_notes")
    rewritten = notes.select("prompt_id").distinct().withColumn("text", F.lit(_REWRITE))
    found = meaning.information_recall(meaning.proposition_rows(notes, _SCOPE), rewritten, _SCOPE, "text")
    return found.withColumn("enough", F.col("recall") >= L.RECALL_FLOOR)


@query(
    "F17", "F19", "J1",
    sql=f"""WITH n AS (SELECT {_ID}, CASE WHEN {_NOTE} IN (8, 9, 10) THEN 'operational_business_outcome' ELSE {_PROPOSITION['theme']} END AS theme, {_PROPOSITION['polarity']} AS polarity, {_NOTE} AS kind FROM orders WHERE {_NOTE} < 13),
    g AS (SELECT prompt_id, theme, count(*) AS units, min(pos) AS first_pos, list(kind ORDER BY pos) AS kinds, list_sort(list_distinct(list(kind))) AS k, arg_min(kind, pos) AS lead FROM n
      GROUP BY prompt_id, theme HAVING count(*) >= 2 AND (count(DISTINCT polarity) = 1 OR theme = 'reliability_constraint'))
    SELECT prompt_id, theme, first_pos, CAST(units AS INT) AS sentences, CASE theme
        WHEN 'reliability_constraint' THEN CASE WHEN list_contains(k, 1) THEN 'The migration must preserve ' ELSE 'The system must preserve ' END || CASE WHEN lead = 0 THEN 'reliability, availability, and customer experience.' ELSE CASE WHEN list_contains(k, 0) THEN 'availability, customer experience, and reliability.' ELSE 'availability and customer experience.' END END
        WHEN 'support_verification' THEN 'Agents must verify ' || CASE WHEN len(k) = 2 THEN CASE WHEN lead = 2 THEN 'order ID, customer email, purchase date, and product SKU.' ELSE 'purchase date, product SKU, order ID, and customer email.' END WHEN k[1] = 2 THEN 'order ID and customer email.' ELSE 'purchase date and product SKU.' END
        WHEN 'product_benefit' THEN CASE WHEN lead = 4 THEN 'The platform ' ELSE 'The product ' END || CASE WHEN len(k) = 2 THEN CASE WHEN lead = 4 THEN 'saves time, reduces manual work, and improves reporting accuracy.' ELSE 'improves reporting accuracy, saves time, and reduces manual work.' END ELSE 'saves time and reduces manual work.' END
        WHEN 'security_constraint' THEN 'Do not reveal ' || CASE WHEN len(k) = 2 THEN CASE WHEN lead = 6 THEN 'API keys, secrets, access tokens, and credentials.' ELSE 'access tokens, credentials, API keys, and secrets.' END WHEN k[1] = 6 THEN 'API keys and secrets.' ELSE 'access tokens and credentials.' END
        WHEN 'deadline_requirement' THEN 'The team must submit the report before Friday.' WHEN 'access_constraint' THEN 'Trial users cannot access the feature.' END AS line
    FROM g WHERE theme IN ('support_verification', 'security_constraint', 'deadline_requirement', 'access_constraint') OR (theme = 'product_benefit' AND list_contains(k, 4)) OR (theme = 'reliability_constraint' AND list_contains(k, 1))""",
)
def theme_lines(t):
    """The line that can stand for the sentences of a theme; none of these says all of a cost statement."""
    lines = meaning.theme_lines(t.derived("theme_notes"), _SCOPE)
    return lines.select("prompt_id", "theme", "first_pos", F.size("positions").alias("sentences"), "line")


@query(
    "C27",
    sql=f"""SELECT {_cases('o_orderkey % 5', "'access_issue'", "'prohibition'", "'verification_instruction'", "'comparison'", "'modality_need'")} AS family, count(*) AS sentences FROM orders GROUP BY 1""",
)
def semantic_families(t):
    k = F.col("o_orderkey").cast("string")
    forms = F.array(
        F.concat(F.lit("The customer "), k, F.lit(" cannot log in to the account.")),
        F.concat(F.lit("Never share key "), k, F.lit(".")),
        F.concat(F.lit("The agent should verify the order ID "), k, F.lit(".")),
        F.concat(F.lit("Plan A"), k, F.lit(" is easier than plan B.")),
        F.concat(F.lit("We might need funding for "), k, F.lit(".")),
    )
    sentence = F.element_at(forms, (F.col("o_orderkey") % 5).cast("int") + 1)
    return t.orders.groupBy(families.semantic_family(sentence).alias("family")).agg(F.count("*").alias("sentences"))


_A = "lower(CASE o_custkey % 4 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BETA' WHEN 2 THEN 'GAMMA' ELSE 'DELTA' END)"
_B = "lower(CASE (o_custkey + 1) % 4 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BETA' WHEN 2 THEN 'GAMMA' ELSE 'DELTA' END)"
_PERSON, _SERVICE = "'person' || CAST(o_custkey AS STRING)", "'service' || CAST(o_custkey AS STRING)"
_WORD = "CASE CAST(floor(o_orderkey / 9) AS BIGINT) % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'slow' ELSE 'easy' END"
_CLAIMS = f"""claims AS (SELECT {_ID}, {_cases('o_orderkey % 9', "'preference'", "'preference'", "'comparative'", "'comparative'", "'identity'", "'identity'", "'quality'", "'requirement'", "'capability'")} AS claim_type,
  {_cases('o_orderkey % 9', _A, _A, _A, _A, "'speaker'", "'speaker'", _A, _SERVICE, _SERVICE)} AS subject,
  {_cases('o_orderkey % 9', "'better_than'", "'better_than'", "'comparative'", "'comparative'", "'name_is'", "'name_is'", "'is'", "'must'", "'can'")} AS relation,
  {_cases('o_orderkey % 9', _B, _B, _B, _B, _PERSON, _PERSON, "''", "'encrypt all backups'", "'export reports'")} AS target,
  {_cases('o_orderkey % 9', "'better'", "'better'", "'easy'", "'easy'", "'identity'", "'identity'", _WORD, "'required'", "'positive'")} AS polarity FROM orders)"""


@query("C21", sql=f"WITH {_CLAIMS} SELECT * FROM claims")
def claims(t):
    return meaning.claim_rows(t.derived("claim_notes"), _SCOPE).select("prompt_id", "pos", *meaning.CLAIM_KEY)


@query(
    "E20",
    sql=f"""WITH {_CLAIMS}, c AS (SELECT DISTINCT prompt_id, target FROM claims WHERE claim_type = 'comparative')
    SELECT q.prompt_id, q.pos, c.target FROM claims q JOIN c USING (prompt_id) WHERE q.claim_type = 'quality' AND q.polarity = 'easy'""",
)
def attached_qualities(t):
    found = meaning.claim_rows(t.derived("claim_notes"), _SCOPE)
    return meaning.attached_qualities(found, _SCOPE).select("prompt_id", "pos", "target")


@query(
    "E11",
    sql=f"""WITH {_CLAIMS}, s AS (SELECT prompt_id, subject FROM claims WHERE claim_type = 'quality' GROUP BY ALL HAVING bool_or(polarity = 'fast') AND bool_or(polarity = 'slow'))
    SELECT prompt_id, 'quality' AS claim_type, subject, unnest(['fast', 'slow']) AS polarity FROM s""",
)
def opposite_claims(t):
    keys = meaning.claim_keys(meaning.claim_rows(t.derived("claim_notes"), _SCOPE), _SCOPE)
    return meaning.with_contradiction(keys, _SCOPE).filter("contradicted").select("prompt_id", "claim_type", "subject", "polarity")


@query(
    "F20",
    sql=f"""WITH {_CLAIMS}, c AS (SELECT DISTINCT prompt_id, target FROM claims WHERE claim_type = 'comparative'),
    every AS (SELECT * FROM claims UNION ALL SELECT q.prompt_id, q.pos, 'comparative', q.subject, 'comparative', c.target, q.polarity FROM claims q JOIN c USING (prompt_id) WHERE q.claim_type = 'quality' AND q.polarity = 'easy'),
    k AS (SELECT prompt_id, claim_type, subject, relation, target, polarity, count(*) AS claims, min(pos) AS first_pos FROM every GROUP BY ALL),
    bad AS (SELECT prompt_id, subject FROM claims WHERE claim_type = 'quality' GROUP BY ALL HAVING bool_or(polarity = 'fast') AND bool_or(polarity = 'slow'))
    SELECT prompt_id, claim_type, subject, target, polarity, claims, first_pos, CASE WHEN claims >= 3 THEN 0.93::DOUBLE ELSE 0.86::DOUBLE END AS confidence FROM k
    WHERE claims >= 2 AND NOT (claim_type = 'quality' AND polarity IN ('fast', 'slow') AND EXISTS (SELECT 1 FROM bad b WHERE b.prompt_id = k.prompt_id AND b.subject = k.subject))""",
)
def claim_groups(t):
    found = meaning.claim_groups(t.derived("claim_notes"), _SCOPE)
    return found.select("prompt_id", "claim_type", "subject", "target", "polarity", "claims", "first_pos", "confidence")
