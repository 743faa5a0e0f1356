"""Queries on near-duplicates, related rows, canonical forms, vectors and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.catalog import query
from pleonasm.catalog import sqltext as S
from pleonasm.catalog.extraction import CLUSTER_PRINT
from pleonasm.functions import text as T
from pleonasm.operators import dedupe, rows, selection, similarity

_SENT = f"sent AS ({S.rows('documents', 'doc_id', S.matched('text', 4), 'sentence')})"
# Distinct token sets per text and, from shared tokens, the exact overlap of every pair that shares any.
_PAIRS = f"""sets AS (SELECT doc_id, tokens, min(pos) AS pos, count(*) AS copies FROM (SELECT doc_id, pos, {CLUSTER_PRINT} AS tokens FROM sent) WHERE len(tokens) > 0 GROUP BY doc_id, tokens),
  tok AS (SELECT doc_id, pos, len(tokens) AS n, unnest(tokens) AS w FROM sets),
  shared AS (SELECT a.doc_id, a.pos AS pos_a, b.pos AS pos_b, a.n AS na, b.n AS nb, count(*) AS c FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.w = b.w AND a.pos < b.pos GROUP BY ALL),
  scored AS (SELECT doc_id, pos_a, pos_b, greatest(0.82::DOUBLE * c / least(na, nb), c / CAST(na + nb - c AS DOUBLE)) AS score FROM shared),
  pairs AS (SELECT * FROM scored WHERE score >= 0.68::DOUBLE)"""


def _long_sentences(t):
    return rows.matched_sentence_rows(t.documents, ["doc_id"], min_words=4)


@query("E2", sql=f"WITH {_SENT}, {_PAIRS} SELECT doc_id, pos_a, pos_b, round(score, 6) AS score FROM pairs")
def cluster_pairs(t):
    return similarity.cluster_pairs(_long_sentences(t), ["doc_id"])


@query(
    "E2", "H2",
    sql=f"""WITH {_SENT}, {_PAIRS}, led AS (SELECT doc_id, s.pos, copies, coalesce((SELECT min(pos_a) FROM pairs p WHERE p.doc_id = s.doc_id AND p.pos_b = s.pos), s.pos) AS leader FROM sets s)
    SELECT doc_id, leader, count(*) AS forms, CAST(sum(copies) AS BIGINT) AS sentences FROM led GROUP BY doc_id, leader HAVING count(*) > 1 ORDER BY sentences DESC, doc_id, leader""",
)
def sentence_clusters(t):
    led = similarity.cluster_leaders(_long_sentences(t), ["doc_id"])
    groups = led.groupBy("doc_id", "leader").agg(F.count("*").alias("forms"), F.sum("copies").alias("sentences"))
    return groups.filter("forms > 1").orderBy(F.desc("sentences"), "doc_id", "leader")


@query(
    "E3", "C27",
    sql="""WITH n AS (SELECT o_custkey AS prompt_id, o_orderkey % 4 AS form, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 4 IN (0, 1) GROUP BY ALL)
    SELECT prompt_id, min(pos) AS pos_a, max(pos) AS pos_b, round(3 / 7.0::DOUBLE, 6) AS jaccard FROM n GROUP BY prompt_id HAVING count(*) = 2""",
)
def related_sentences(t):
    forms = F.when(F.col("o_orderkey") % 4 == 0, F.lit("Please export quarterly numbers quickly.")).when(
        F.col("o_orderkey") % 4 == 1, F.lit("Please export monthly numbers slowly.")
    ).when(F.col("o_orderkey") % 4 == 2, F.lit("Nobody must export quarterly numbers.")).otherwise(F.lit("What should i do about numbers today?"))
    notes = t.orders.select(F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").alias("pos"), forms.alias("sentence"))
    return similarity.related_pairs(notes, ["prompt_id"])


@query(
    "E1", "J5",
    sql="""WITH n AS (SELECT o_custkey AS prompt_id, o_orderkey AS pos, o_orderkey % 3 AS form, CASE WHEN o_orderkey % 3 = 2 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS size FROM orders WHERE o_orderkey % 3 <> 2),
    b AS (SELECT prompt_id, min((size, pos)) AS best FROM n GROUP BY prompt_id)
    SELECT n.prompt_id, n.pos, best[2] AS kept_pos FROM n JOIN b USING (prompt_id) WHERE (size, pos) > best""",
)
def fact_duplicates(t):
    # Two forms of one fact; the third kind of note carries another fact and must stay.
    c = F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 3
    forms = (
        F.when(k == 0, F.concat(F.lit("Latency of NODE-"), c, F.lit(" rose to 12 ms.")))
        .when(k == 1, F.concat(F.lit("The latency of NODE-"), c, F.lit(" rose again to twelve ms.")))
        .otherwise(F.concat(F.lit("Uptime of UNIT-"), F.col("o_orderkey").cast("string"), F.lit(" rose.")))
    )
    notes = t.orders.select(F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").alias("pos"), forms.alias("sentence"))
    return similarity.fact_duplicates(notes, ["prompt_id"])


_ALL = f"sent AS ({S.rows('documents', 'doc_id', S.sentences('text'), 'sentence')})"


@query(
    "F9",
    sql=f"""WITH {_ALL}, c AS (SELECT {S.squeeze('sentence')} AS key, sentence, count(*) AS n, min((doc_id, pos)) AS o FROM sent GROUP BY ALL)
    SELECT key, arg_min(sentence, (-n, length(sentence), o)) AS canonical, CAST(sum(n) AS BIGINT) AS members, count(*) AS forms FROM c GROUP BY key HAVING sum(n) > 1""",
)
def canonical_sentences(t):
    sentences = rows.sentence_rows(t.documents, ["doc_id"]).withColumn("key", T.squeeze(F.col("sentence")))
    return similarity.canonical_texts(sentences, ["key"], "sentence", ["doc_id", "pos"]).filter("members > 1")


@query(
    "H4",
    sql=f"""WITH {S.source('filler_prompts')}, v AS (SELECT prompt_id, unnest([text, regexp_replace(text, '(?i)\\bplease\\s+', '', 'g'), regexp_replace(text, '\\s+', ' ', 'g')]) AS text FROM filler_prompts)
    SELECT prompt_id, min({S.tokens('text')}) AS tokens FROM v GROUP BY prompt_id""",
)
def shortest_rewrites(t):
    versions = F.array("text", F.regexp_replace("text", r"(?i)\bplease\s+", ""), F.regexp_replace("text", r"\s+", " "))
    candidates = t.derived("filler_prompts").select("prompt_id", F.explode(versions).alias("text"), F.lit(True).alias("accepted"))
    return similarity.shortest_rewrite(candidates, ["prompt_id"], "text").select("prompt_id", "tokens")


@query(
    "E19",
    sql="""WITH d AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i, embedding, vec_id FROM embeddings),
    m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM d GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS centroid FROM m GROUP BY label),
    s AS (SELECT e.label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 6) AS similarity FROM embeddings e JOIN c USING (label))
    SELECT label, vec_id, similarity, CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS INT) AS place FROM s QUALIFY place <= 5""",
)
def nearest_vectors(t):
    return similarity.nearest_to_centroid(t.embeddings, "label", "embedding", "vec_id", 5)


@query(
    "E19",
    sql="""WITH s AS (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
      FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query, vec_id, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS INT) AS place FROM s QUALIFY place <= 10""",
)
def nearest_neighbours(t):
    """Every fiftieth vector is a query."""
    return similarity.nearest_neighbours(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query(
    "E18",
    sql=f"""WITH d AS (SELECT doc_id, list_sort(list_distinct({S.norms('text')})) AS tokens, text FROM documents
      WHERE NOT regexp_matches(text, {S.q('(?i)' + S.word_bound(['today', 'now', 'current', 'latest', 'this week', 'this month', 'yesterday', 'tomorrow', 'price', 'weather', 'news']))})),
    f AS (SELECT doc_id, tokens, len(tokens) AS n, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, {S.q(r'(?i)https?://[^\s)>"]+')}), regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b'), regexp_extract_all(text, '\\b[A-Z]{{2,}}(?:-[A-Z0-9]+)+\\b'), regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\b'), regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?%'), regexp_extract_all(text, '\\$\\d[\\d,]*(?:\\.\\d+)?\\b')))), '|') AS facts FROM d WHERE len(tokens) > 0),
    p AS (SELECT b.doc_id, a.doc_id AS stored, round(len(list_intersect(a.tokens, b.tokens)) / CAST(a.n + b.n - len(list_intersect(a.tokens, b.tokens)) AS DOUBLE), 6) AS similarity
      FROM f a JOIN f b ON a.facts = b.facts AND a.doc_id < b.doc_id AND a.n >= 0.92 * b.n - 0.001 AND b.n >= 0.92 * a.n - 0.001)
    SELECT doc_id, stored, similarity FROM p WHERE similarity >= 0.92 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, stored) = 1""",
)
def safe_cache_matches(t):
    return similarity.safe_cache_matches(t.documents, "doc_id").select("doc_id", "stored", "similarity")


_SPANS = """spans AS (SELECT o_custkey AS prompt_id, CAST(o_orderkey % 1000 AS BIGINT) AS start, CAST(o_orderkey % 1000 + 20 + o_custkey % 300 AS BIGINT) AS "end", CAST(o_totalprice AS BIGINT) AS rank FROM orders)"""


def _spans(t):
    return t.orders.selectExpr(
        "o_custkey AS prompt_id", "CAST(o_orderkey % 1000 AS BIGINT) AS start", "CAST(o_orderkey % 1000 + 20 + o_custkey % 300 AS BIGINT) AS end",
        "CAST(round(o_totalprice) AS BIGINT) AS rank",
    )


@query(
    "E21",
    sql=f"""WITH {_SPANS}, d AS (SELECT DISTINCT prompt_id, start, "end" FROM spans) SELECT a.prompt_id, a.start AS start_a, a."end" AS end_a, b.start AS start_b, b."end" AS end_b FROM d a JOIN d b
      ON a.prompt_id = b.prompt_id AND a.start < b."end" AND b.start < a."end" AND (a.start, a."end") < (b.start, b."end")""",
)
def overlapping_spans(t):
    """The pairs themselves, for spans of short texts; `span_overlaps` counts them without forming one."""
    return selection.overlapping_spans(_spans(t).select("prompt_id", "start", "end").distinct(), ["prompt_id"])


@query(
    "E21",
    sql=f"""WITH {_SPANS}, d AS (SELECT prompt_id, start, "end", count(*) AS copies FROM spans GROUP BY ALL)
    SELECT a.prompt_id, a.start, a."end", a.copies, count(b.start) AS overlaps FROM d a LEFT JOIN d b
      ON a.prompt_id = b.prompt_id AND a.start < b."end" AND b.start < a."end" AND (a.start <> b.start OR a."end" <> b."end") GROUP BY ALL""",
)
def span_overlaps(t):
    return selection.span_overlaps(_spans(t), ["prompt_id"])


@query(
    "G9",
    sql=f"""WITH RECURSIVE {_SPANS}, numbered AS (SELECT prompt_id, start, "end", row_number() OVER (PARTITION BY prompt_id ORDER BY rank DESC, start, "end") AS n
        FROM (SELECT prompt_id, start, "end", max(rank) AS rank FROM spans GROUP BY ALL)),
      taken AS (SELECT prompt_id, n, [(start, "end")] AS held FROM numbered WHERE n = 1
        UNION ALL SELECT t.prompt_id, s.n, CASE WHEN len(list_filter(t.held, lambda h: h[1] < s."end" AND s.start < h[2])) = 0 THEN list_append(t.held, (s.start, s."end")) ELSE t.held END
        FROM taken t JOIN numbered s ON t.prompt_id = s.prompt_id AND s.n = t.n + 1),
      last AS (SELECT prompt_id, arg_max(held, n) AS held FROM taken GROUP BY prompt_id)
    SELECT prompt_id, h[1] AS start, h[2] AS "end" FROM (SELECT prompt_id, unnest(held) AS h FROM last)""",
)
def greedy_spans(t):
    return selection.greedy_spans(_spans(t), ["prompt_id"], "rank")


def _candidates(t):
    """Repeated sentences of each text with the copy that stays."""
    found = dedupe.repeated_sentences(t.documents, ["doc_id"])
    return found.select("doc_id", "pos", "span", F.col("span").alias("kept"), "candidate_type")


_FLAGS = rf"""[CASE WHEN regexp_matches(span, '__PROTECTED_\d+__') THEN 'protected_placeholder' END,
      CASE WHEN regexp_matches(span, 'https?://|[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{{2,}}\b') THEN 'url_or_email' END,
      CASE WHEN regexp_matches(span, '(?:^|[^\p{{L}}\p{{N}}_])\d+(?:$|[^\p{{L}}\p{{N}}_])|\$\d') THEN 'number_date_money' END, CASE WHEN regexp_matches(span, '\b[A-Z]{{2,}}(?:-[A-Z0-9]+)+\b') THEN 'id_or_legal_clause' END,
      CASE WHEN regexp_matches(span, '(?s)```|`[^`]+`|\{{.*\}}|\[.*\]|<[^>]+>') THEN 'code_or_structured_data' END,
      CASE WHEN regexp_matches(span, '[a-zA-Z]\s*=\s*[-+*/^(). 0-9a-zA-Z]+') THEN 'math' END, CASE WHEN regexp_matches(span, '"[^"]+"|''[^'']+''') THEN 'quoted_exact_text' END"""


@query(
    "D9",
    sql=f"""WITH item AS ({S.rows('documents', 'doc_id', S.matched('text', 1), 'span')}), keyed AS (SELECT *, array_to_string({S.norms('span')}, ' ') AS key FROM item),
    linked AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, key) AS first FROM keyed), c AS (SELECT * FROM linked WHERE pos > first AND len(string_split(key, ' ')) >= 3),
    f AS (SELECT doc_id, pos, array_to_string(list_filter({_FLAGS}], lambda x: x IS NOT NULL), '|') AS flags FROM c)
    SELECT doc_id, pos, flags FROM f""",
)
def removal_risks(t):
    flagged = selection.with_risk_flags(_candidates(t))
    return flagged.select("doc_id", "pos", F.array_join("risk_flags", "|").alias("flags"))


# One case for each flag: what stands before the span, the span, what stands after it, what is kept, its type, and the flags it gets.
_RISK_CASES = (
    ("Note ", "__PROTECTED_4__", ".", "__PROTECTED_4__", "repeated_sentence", "protected_placeholder"),
    ("See ", "https://example.com/a", " now.", "https://example.com/a", "repeated_sentence", "url_or_email"),
    ("Paid ", "12 coins", ".", "12 coins", "repeated_sentence", "number_date_money"),
    ("By ", "clause AB-X", ".", "clause AB-X", "repeated_sentence", "id_or_legal_clause"),
    ("Run ", "`make`", ".", "`make`", "repeated_sentence", "code_or_structured_data"),
    ("Let ", "a = b", ".", "a = b", "repeated_sentence", "math"),
    ("He said ", '"go on"', ".", '"go on"', "repeated_sentence", "quoted_exact_text"),
    ("They ", "had", " it.", "had", "repeated_token", "domain_term"),
    ("", "my name is marta", " today.", "the caller", "repeated_phrase", "named_entity_without_identical_retained_copy"),
    ("Entry is ", "prohibited here", ".", "no entry", "repeated_sentence", "contradiction_sensitive"),
    ("It is ", "better than", " that.", "better than", "repeated_phrase", "semantic_relation_phrase"),
    ("We went ", "to town", " again.", "to town", "repeated_ngram", "relation_bearing_partial_span"),
    ("There ", "green Blue Red", " go.", "green Blue Red", "repeated_ngram", "grammar_sensitive_partial_span"),
    ("We built ", "the red barn", " there.", "the red barn", "repeated_ngram", "relation_bearing_partial_span|required_object_phrase"),
    ("Agents confirm every ", "red barn", " here.", "red barn", "repeated_ngram", "object_after_relation_phrase"),
    ("Old ", "green hills", " roll.", "green hills", "repeated_ngram", ""),
)


def _risk_case_columns() -> dict[str, str]:
    quoted = lambda i: [S.q(case[i]) for case in _RISK_CASES]
    pick = lambda i: "CASE o_orderkey % 16 " + " ".join(f"WHEN {n} THEN {text}" for n, text in enumerate(quoted(i))) + " END"
    lead = "'Order ' || CAST(o_orderkey AS STRING) || ' came! ' || " + pick(0)
    return {"prompt_id": "o_orderkey", "lead": lead, "span": pick(1), "rest": pick(2), "kept": pick(3), "candidate_type": pick(4)}


@query("D9", sql="SELECT o_orderkey AS prompt_id, CASE o_orderkey % 16 " + " ".join(f"WHEN {n} THEN {S.q(case[5])}" for n, case in enumerate(_RISK_CASES)) + " END AS flags FROM orders")
def risk_flag_cases(t):
    """Every flag with a span that gets it, in a text that differs by order."""
    cases = t.orders.selectExpr(*[f"{sql} AS {name}" for name, sql in _risk_case_columns().items()])
    placed = cases.selectExpr("*", "concat(lead, span, rest) AS text", "length(lead) AS start", "length(lead) + length(span) AS end")
    return selection.with_risk_flags(placed, text="text").select("prompt_id", F.array_join("risk_flags", "|").alias("flags"))


_ROUND = lambda x: f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 20)), 3) AS DOUBLE)"
# Tokens, sentences and paragraphs with their places: pieces and the gaps before them, summed up.
_CANDIDATE_SQL = rf"""tokenised AS (SELECT doc_id, regexp_extract_all(text, {S.q(L.WORD_TOKEN)}) AS w, string_split_regex(text, {S.q(L.WORD_TOKEN)}) AS g FROM documents),
    token_rows AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS span, unnest(g[:len(w)]) AS gap FROM tokenised),
    tokens AS (SELECT doc_id, i, span, array_to_string({S.norms('span')}, ' ') AS norm, sum(length(gap) + length(span)) OVER (PARTITION BY doc_id ORDER BY i) AS "end" FROM token_rows),
    pairs AS (SELECT doc_id, i, span || ' ' || lead(span) OVER o AS span, norm || ' ' || lead(norm) OVER o AS norm, "end" - length(span) AS start, lead("end") OVER o AS "end" FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    marked AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\n$', ''), '([.!?])(\s)', '\1' || chr(31) || '\2', 'g'), chr(31)) AS p FROM documents),
    piece_rows AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS piece FROM marked),
    placed AS (SELECT doc_id, i, regexp_extract(piece, '[^\n]*$') AS line, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM piece_rows),
    sentences AS (SELECT doc_id, i, {S.strip('line')} AS span, stop - length(regexp_replace(line, '^\s+', '')) AS start FROM placed),
    blocks AS (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS p, list_concat([''], regexp_extract_all(text, '\n\s*\n')) AS g FROM documents),
    block_rows AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, unnest(p) AS span, unnest(g) AS gap FROM blocks),
    paragraphs AS (SELECT doc_id, i, span, sum(length(gap) + length(span)) OVER (PARTITION BY doc_id ORDER BY i) - length(span) AS start FROM block_rows),
    found AS (
      SELECT doc_id, "end" - length(span) AS start, "end", span, norm, 'repeated_token' AS candidate_type FROM tokens QUALIFY lag(norm) OVER (PARTITION BY doc_id ORDER BY i) = norm
      UNION ALL SELECT doc_id, "end" - length(span), "end", span, norm, 'low_information_filler' FROM tokens WHERE norm IN {S.values(L.DISCOURSE_WORDS)} QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY i) > 1
      UNION ALL SELECT doc_id, start, "end", span, norm, 'repeated_ngram' FROM pairs WHERE norm IN {S.values(L.RELATION_PAIRS)} QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY i) > 1
      UNION ALL SELECT doc_id, "end" - length(span), "end", span, norm, 'trailing_low_information' FROM tokens WHERE norm IN {S.values(L.DISCOURSE_WORDS)} QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY i) > 1 AND (doc_id, i) IN (SELECT (doc_id, max(i)) FROM tokens GROUP BY doc_id)
      UNION ALL SELECT doc_id, start, start + length(span), span, norm, 'repeated_sentence' FROM (SELECT *, array_to_string({S.norms('span')}, ' ') AS norm FROM sentences WHERE span <> '') WHERE len(string_split(norm, ' ')) >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY i) > 1
      UNION ALL SELECT doc_id, start, start + length(span), span, norm, 'repeated_paragraph' FROM (SELECT *, array_to_string({S.norms('span')}, ' ') AS norm FROM paragraphs WHERE {S.strip('span')} <> '') WHERE len(string_split(norm, ' ')) >= 6 QUALIFY row_number() OVER (PARTITION BY doc_id, norm ORDER BY i) > 1),
    flagged AS (SELECT *, list_filter({_FLAGS},
      CASE WHEN norm IN {S.values(L.DOMAIN_PHRASES)} OR norm || ' ' || norm IN {S.values(L.DOMAIN_PHRASES)} THEN 'domain_term' END, CASE WHEN candidate_type = 'repeated_ngram' THEN 'semantic_relation_phrase' END], lambda x: x IS NOT NULL) AS flags,
      list_filter(list_distinct(string_split(norm, ' ')), lambda w: w <> '') AS words, {S.tokens('span')} AS saved FROM found),
    dense AS (SELECT f.*, len(list_filter(words, lambda w: w NOT IN {S.values(L.DISCOURSE_WORDS)})) / greatest(len(words), 1)::DOUBLE AS density, length(d.text) AS n FROM flagged f JOIN documents d USING (doc_id)),
    based AS (SELECT *, 0.22::DOUBLE * len(flags) AS penalty, 0.2::DOUBLE * (CASE WHEN candidate_type IN ('repeated_token', 'trailing_low_information') THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END) + 0.23::DOUBLE + 0.18::DOUBLE
      + 0.14::DOUBLE * (1 - density) + 0.12::DOUBLE * least(1.0::DOUBLE, saved / 8.0::DOUBLE) + 0.08::DOUBLE * (1 - (CASE WHEN density < 0.5 THEN 0.25::DOUBLE ELSE 0.6::DOUBLE END))
      + 0.05::DOUBLE * (1 - (CASE WHEN start < greatest(1.0::DOUBLE, n * 0.15::DOUBLE) THEN 0.8::DOUBLE ELSE 0.35::DOUBLE END))
      + (CASE WHEN candidate_type IN ('repeated_ngram', 'repeated_sentence', 'repeated_paragraph') THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END) AS base FROM dense),
    sure AS (SELECT *, {_ROUND('greatest(0.0::DOUBLE, least(0.99::DOUBLE, base - penalty))')} AS confidence FROM based),
    scored AS (SELECT doc_id, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", span, candidate_type, flags, saved, confidence, {_ROUND('confidence * saved - penalty')} AS utility FROM sure)"""


@query(
    "D14", "D9",
    sql=f"""WITH {_CANDIDATE_SQL} SELECT doc_id, start, "end", candidate_type, array_to_string(flags, '|') AS flags, saved AS tokens_saved, confidence, utility FROM scored""",
)
def scored_candidates(t):
    """Candidates of all kinds with their places in the text."""
    found = selection.candidate_rows(t.documents, ["doc_id"])
    return found.select("doc_id", "start", "end", "candidate_type", F.array_join("risk_flags", "|").alias("flags"), "tokens_saved", "confidence", "utility")


@query("D14", "G8")
def budgeted_selection(t):
    return selection.budgeted_selection(t.documents, ["doc_id"], "balanced")
