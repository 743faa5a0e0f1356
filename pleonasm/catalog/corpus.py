"""Queries over whole texts: rows, counts, repeats, clean-up, set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.catalog import query
from pleonasm.catalog import sqltext as S
from pleonasm.functions import text as T
from pleonasm.operators import dedupe, rows, similarity, sketches
from pleonasm.plans.savings import keep_first_savings

_SENT = f"sent AS ({S.rows('documents', 'doc_id', S.sentences('text'), 'sentence')})"
_TERMINAL = f"sent AS ({S.rows('documents', 'doc_id', S.sentences('text', lines=False), 'sentence')})"
_MATCHED = f"sent AS ({S.rows('documents', 'doc_id', S.matched('text', 3), 'sentence')})"


def _kept_sql(key: str, source: str) -> str:
    return f"""numbered AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, {key} ORDER BY pos) AS copy FROM {source}),
    kept AS (SELECT doc_id, count(*) FILTER (WHERE copy > 1) AS dropped,
      string_agg(sentence, ' ' ORDER BY pos) FILTER (WHERE copy = 1) AS kept FROM numbered GROUP BY doc_id)"""


_NORMAL_SPACE = S.strip(r"regexp_replace(regexp_replace(kept, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(
    "B4", "G1", "B1", "D15",
    sql=f"""WITH {_SENT}, {_kept_sql(S.squeeze('sentence'), 'sent')},
    sized AS (SELECT source, {S.tokens('text')} AS before,
      CASE WHEN coalesce(dropped, 0) = 0 THEN {S.tokens('text')} ELSE {S.tokens(_NORMAL_SPACE)} END AS after,
      coalesce(dropped, 0) AS dropped FROM documents LEFT JOIN kept USING (doc_id))
    SELECT source, count(*) AS texts, CAST(sum(dropped) AS BIGINT) AS dropped_sentences, CAST(sum(before) AS BIGINT) AS original_tokens,
      CAST(sum(after) AS BIGINT) AS optimized_tokens,
      CASE WHEN sum(before) <= 0 THEN 0.0::DOUBLE ELSE round((sum(before) - sum(after)) / CAST(sum(before) AS DOUBLE) * 100, 2) END AS savings_percent
    FROM sized GROUP BY source""",
)
def keep_first_savings_by_source(t):
    return keep_first_savings(t.documents, ["source"])


@query(
    "B1",
    sql=f"""SELECT source, lang, count(*) AS texts, CAST(sum({S.pieces('text')}) AS BIGINT) AS pieces,
      CAST(sum({S.tokens('text')}) AS BIGINT) AS tokens, max({S.tokens('text')}) AS max_tokens FROM documents GROUP BY source, lang""",
)
def token_statistics(t):
    return rows.token_statistics(t.documents, "text", ["source", "lang"])


@query(
    "B2",
    sql=f"""SELECT conv_id, CAST(sum({S.tokens('role')} + {S.tokens('text')} + 4) AS BIGINT) AS tokens, count(*) AS messages
      FROM conversations GROUP BY conv_id""",
)
def conversation_tokens(t):
    return rows.conversation_tokens(t.conversations, "conv_id")


@query("B3", sql=f"WITH {_TERMINAL} SELECT doc_id, pos, sentence FROM sent")
def sentences_by_end_mark(t):
    return rows.sentence_rows(t.documents, ["doc_id"], pattern=T.SPLIT_TERMINAL)


@query("B4", sql=f"WITH {_SENT} SELECT doc_id, pos, sentence FROM sent")
def sentences_by_end_mark_or_line(t):
    return rows.sentence_rows(t.documents, ["doc_id"])


@query("B5", sql=f"WITH {_MATCHED} SELECT doc_id, pos, sentence FROM sent")
def complete_sentences(t):
    return rows.matched_sentence_rows(t.documents, ["doc_id"], min_words=3)


@query("B5", sql=f"WITH sent AS ({S.rows('conversations', 'conv_id, turn', S.matched('text', 4), 'sentence')}) SELECT conv_id, turn, pos, sentence FROM sent")
def complete_long_sentences(t):
    return rows.matched_sentence_rows(t.conversations, ["conv_id", "turn"], min_words=4)


@query(
    "B10",
    sql=f"""WITH w AS ({S.rows('conversations', 'conv_id, turn', f"regexp_extract_all(text, {S.q(L.WORD_TOKEN)})", 'token')})
    SELECT conv_id, turn, pos, token, regexp_replace(lower(token), {S.q("'+$")}, '') AS norm FROM w""",
)
def word_tokens(t):
    return rows.word_rows(t.conversations, ["conv_id", "turn"])


_PARAGRAPHS = rf"list_filter(string_split(regexp_replace(text, '\n\s*\n', chr(30), 'g'), chr(30)), lambda p: {S.strip('p')} <> '')"


@query("B11", sql=f"WITH p AS ({S.rows('documents', 'doc_id', _PARAGRAPHS, 'paragraph')}) SELECT doc_id, pos, paragraph FROM p")
def paragraphs(t):
    return rows.paragraph_rows(t.documents, ["doc_id"])


def _cleanup_sql(text: str) -> str:
    out = text
    for word in L.LOW_INFORMATION_WORDS:
        out = rf"regexp_replace({out}, '(?i)\b({word})(?:\s+{word}\b)+', '\1', 'g')"
    out = rf"regexp_replace({out}, '(?i)\bPlease\s+kindly\s+(\w)', 'Please \1', 'g')"
    out = rf"regexp_replace({out}, '[ \t]{{2,}}', ' ', 'g')"
    return rf"regexp_replace({out}, '\s+([.,;:!?])', '\1', 'g')"


@query(
    "B14",
    sql=f"""WITH {S.source('filler_prompts')}, c AS (SELECT source, text, {_cleanup_sql('text')} AS cleaned FROM filler_prompts)
    SELECT source, count(*) AS texts, count(*) FILTER (WHERE text <> cleaned) AS changed,
      CAST(sum(length(text) - length(cleaned)) AS BIGINT) AS chars_dropped FROM c GROUP BY source""",
)
def cleanup_report(t):
    return rows.cleanup_report(t.derived("filler_prompts"), "text", ["source"])


@query(
    "B14", "G3",
    sql=f"WITH {S.source('filler_prompts')} SELECT prompt_id, {_cleanup_sql('text')} AS cleaned FROM filler_prompts",
)
def cleaned_texts(t):
    return t.derived("filler_prompts").select("prompt_id", rows.token_cleanup(F.col("text")).alias("cleaned"))


# --- repeats ---------------------------------------------------------------------------------------


@query(
    "G1",
    sql=f"""WITH {_TERMINAL}, {_kept_sql(S.squeeze('sentence'), 'sent')}
    SELECT doc_id, CAST(coalesce(dropped, 0) AS INT) AS dropped_sentences, CASE WHEN coalesce(dropped, 0) = 0 THEN text ELSE {_NORMAL_SPACE} END AS kept_text
    FROM documents LEFT JOIN kept USING (doc_id)""",
)
def keep_first_sentences(t):
    kept = dedupe.with_kept_sentences(t.documents, key="squeezed")
    return kept.select("doc_id", "dropped_sentences", "kept_text")


_LINE_KEY = r"trim(regexp_replace(lower(s), '[^a-z0-9$%_]+', ' ', 'g'))"


@query(
    "G1",
    sql=f"""WITH line AS ({S.rows('documents', 'doc_id', "string_split(text, chr(10))", 'line')}),
    named AS (SELECT doc_id, pos, line, {S.strip('line')} AS s FROM line),
    keyed AS (SELECT *, CASE WHEN s = '' OR s LIKE '%:' OR s LIKE '- %' OR {S.words('s')} < 3 THEN chr(1) || pos ELSE {_LINE_KEY} END AS key FROM named),
    kept AS (SELECT doc_id, pos, line FROM keyed QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) = 1)
    SELECT doc_id, {S.strip(chr(10).join(["regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\\n{3,}', chr(10) || chr(10), 'g')"]))} AS kept_text
    FROM kept GROUP BY doc_id""",
)
def keep_first_lines(t):
    return t.documents.select("doc_id", dedupe.keep_first_lines(F.col("text")).alias("kept_text"))


@query(
    "G1", "G13",
    sql=f"""WITH {_SENT}, keyed AS (SELECT *, {S.squeeze('sentence')} AS key FROM sent)
    SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE copy = 1) AS first_here FROM (
      SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS copy FROM keyed) GROUP BY doc_id""",
)
def corpus_first_sentences(t):
    flagged = dedupe.keep_first_across(rows.sentence_rows(t.documents, ["doc_id"]), ["doc_id", "pos"], key="squeezed")
    return flagged.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if("first").alias("first_here"))


def _later_sql(list_sql: str, min_words: int, kind: str, table: str = "documents") -> str:
    return f"""WITH {S.source('paragraph_prompts')}, item AS ({S.rows(table, 'doc_id', list_sql, 'span')}),
    keyed AS (SELECT *, array_to_string({S.norms('span')}, ' ') AS key FROM item),
    linked AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, key) AS kept_pos FROM keyed)
    SELECT doc_id, pos, kept_pos, span, '{kind}' AS candidate_type FROM linked
    WHERE pos > kept_pos AND len(string_split(key, ' ')) >= {min_words}"""


@query("G2", sql=_later_sql(S.matched("text", 1), 3, "repeated_sentence"))
def repeated_sentences(t):
    return dedupe.repeated_sentences(t.documents, ["doc_id"])


@query("G2", sql=_later_sql(_PARAGRAPHS, 6, "repeated_paragraph", "paragraph_prompts"))
def repeated_paragraphs(t):
    return dedupe.repeated_paragraphs(t.derived("paragraph_prompts"), ["doc_id"])


def _norm_rows(table: str, keys: str) -> str:
    return f"w AS ({S.rows(table, keys, S.norms('text'), 'norm')})"


@query(
    "G3",
    sql=f"""WITH {_norm_rows('documents', 'doc_id')}
    SELECT doc_id, pos, norm FROM w QUALIFY lag(norm) OVER (PARTITION BY doc_id ORDER BY pos) = norm""",
)
def repeated_tokens(t):
    return dedupe.repeated_tokens(t.documents, ["doc_id"])


_FILLER = S.source("filler_prompts")


@query(
    "G3",
    sql=f"""WITH {_FILLER}, {_norm_rows('filler_prompts', 'prompt_id')}, run AS (
      SELECT * FROM w QUALIFY lag(norm) OVER (PARTITION BY prompt_id ORDER BY pos) = norm)
    SELECT prompt_id, pos, norm FROM run WHERE norm IN {S.values(L.LOW_INFORMATION_WORDS)}""",
)
def repeated_low_information_tokens(t):
    return dedupe.repeated_tokens(t.derived("filler_prompts"), ["prompt_id"], only=L.LOW_INFORMATION_WORDS)


@query(
    "G4",
    sql=f"""WITH {_FILLER}, {_norm_rows('filler_prompts', 'prompt_id')}
    SELECT prompt_id, pos, norm FROM w WHERE norm IN {S.values(L.DISCOURSE_WORDS)}
    QUALIFY row_number() OVER (PARTITION BY prompt_id, norm ORDER BY pos) > 1""",
)
def repeated_filler(t):
    return dedupe.repeated_filler(t.derived("filler_prompts"), ["prompt_id"])


@query(
    "G5",
    sql=f"""WITH {_FILLER}, {_norm_rows('filler_prompts', 'prompt_id')},
    last AS (SELECT prompt_id, max(pos) AS pos FROM w GROUP BY prompt_id)
    SELECT prompt_id, pos, norm FROM w JOIN last USING (prompt_id, pos) WHERE norm IN {S.values(L.DISCOURSE_WORDS)}
      AND EXISTS (SELECT 1 FROM w e WHERE e.prompt_id = w.prompt_id AND e.norm = w.norm AND e.pos < w.pos)""",
)
def trailing_filler(t):
    return dedupe.trailing_filler(t.derived("filler_prompts"), ["prompt_id"])


@query(
    "G6",
    sql=f"""WITH {_norm_rows('documents', 'doc_id')}, g AS (
      SELECT doc_id, pos, norm || ' ' || lead(norm, 1) OVER o || ' ' || lead(norm, 2) OVER o AS ngram FROM w
      WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, ngram) AS first_pos FROM g WHERE ngram IS NOT NULL)
    SELECT doc_id, ngram, min(first_pos) AS first_pos, count(*) AS times FROM f
    WHERE pos >= first_pos + 3 AND ngram NOT LIKE '%\\_\\_protected\\_%' ESCAPE '\\'
      AND NOT (list_contains(string_split(ngram, ' '), 'dup') AND list_contains(string_split(ngram, ' '), 'chunk'))
    GROUP BY doc_id, ngram""",
)
def repeated_trigrams(t):
    return dedupe.repeated_ngrams(t.documents, ["doc_id"], 3)


@query(
    "G6",
    sql=f"""WITH {_norm_rows('documents', 'doc_id')}, n1 AS (SELECT doc_id, pos, norm, {', '.join(f'lead(norm, {i}) OVER o AS l{i}' for i in range(1, 10))} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT * FROM (SELECT doc_id, pos, unnest(range(2, 11)) AS n, unnest([{', '.join(" || ' ' || ".join(['norm', *[f'l{i}' for i in range(1, n)]]) for n in range(2, 11))}]) AS ngram FROM n1) WHERE ngram IS NOT NULL),
    f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, n, ngram) AS first_pos FROM g)
    SELECT doc_id, CAST(n AS INT) AS n, count(DISTINCT ngram) AS ngrams, count(*) AS times, CAST(sum(first_pos) AS BIGINT) AS first_positions FROM f
    WHERE pos >= first_pos + n AND ngram NOT LIKE '%\\_\\_protected\\_%' ESCAPE '\\' AND NOT ngram IN {S.values(L.DOMAIN_PHRASES)} AND NOT ngram || ' ' || ngram IN {S.values(L.DOMAIN_PHRASES)}
      AND NOT (list_contains(string_split(ngram, ' '), 'dup') AND list_contains(string_split(ngram, ' '), 'chunk'))
    GROUP BY doc_id, n""",
)
def repeated_ngrams(t):
    """All lengths from two to ten, summed up per text and length."""
    return dedupe.repeated_ngrams_of_sizes(t.documents, ["doc_id"], 2, 10).groupBy("doc_id", "n").agg(
        F.count("*").alias("ngrams"), F.sum("times").alias("times"), F.sum(F.col("first_pos") * F.col("times")).cast("long").alias("first_positions")
    )


@query(
    "G7",
    sql=f"""WITH {_FILLER}, {_norm_rows('filler_prompts', 'prompt_id')}, p AS (
      SELECT prompt_id, pos, norm || ' ' || lead(norm) OVER (PARTITION BY prompt_id ORDER BY pos) AS phrase FROM w)
    SELECT prompt_id, pos, phrase FROM p WHERE phrase IN {S.values(L.RELATION_PAIRS)}
    QUALIFY row_number() OVER (PARTITION BY prompt_id, phrase ORDER BY pos) > 1""",
)
def repeated_comparisons(t):
    return dedupe.repeated_comparisons(t.derived("filler_prompts"), ["prompt_id"])


@query(
    "G11",
    sql=f"""WITH item AS ({S.rows('documents', 'doc_id', S.sentences('text'), 'span')}),
    c AS (SELECT doc_id, pos // 3 AS start, pos // 3 + 1 AS "end", 'repeated_sentence' AS candidate_type, span FROM item)
    SELECT doc_id, start, "end", candidate_type, arg_max(span, (length(span), span)) AS span FROM c GROUP BY ALL""",
)
def longest_candidates(t):
    spans = rows.sentence_rows(t.documents, ["doc_id"]).select(
        "doc_id",
        F.expr("pos div 3").alias("start"),
        F.expr("pos div 3 + 1").alias("end"),
        F.lit("repeated_sentence").alias("candidate_type"),
        F.col("sentence").alias("span"),
    )
    return dedupe.longest_candidates(spans, ["doc_id"])


@query(
    "F8",
    sql=f"""WITH {_SENT} SELECT {S.squeeze('sentence')} AS key, count(*) AS copies FROM sent GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_sentence_counts(t):
    return dedupe.duplicate_counts(rows.sentence_rows(t.documents, ["doc_id"]))


@query(
    "H5",
    sql=f"""WITH {_SENT} SELECT {S.squeeze('sentence')} AS key, count(*) AS copies FROM sent GROUP BY 1 HAVING count(*) > 1
    ORDER BY copies DESC, key LIMIT 25""",
)
def most_repeated_sentences(t):
    return dedupe.most_repeated(rows.sentence_rows(t.documents, ["doc_id"]), 25)


@query(
    "D2",
    sql=f"""WITH s AS (SELECT doc_id, list_transform({S.matched('text', 3)}, lambda s: {S.bare('s')}) AS k FROM documents)
    SELECT doc_id, CASE WHEN len(k) = 0 THEN 0.0::DOUBLE ELSE round((len(k) - len(list_distinct(k))) / CAST(len(k) AS DOUBLE), 3) END AS repeated_ratio FROM s""",
)
def repeated_sentence_ratio(t):
    return t.documents.select("doc_id", dedupe.repeated_ratio(F.col("text")).alias("repeated_ratio"))


# --- set operations between two versions of a corpus --------------------------------------------------


def _versions(t):
    before = rows.sentence_rows(t.documents, ["doc_id"], pattern=T.SPLIT_TERMINAL)
    after = rows.sentence_rows(
        dedupe.with_kept_sentences(t.documents, key="squeezed"), ["doc_id"], text="kept_text", pattern=T.SPLIT_TERMINAL
    )
    key = T.squeeze(F.col("sentence")).alias("key")
    return before.select("doc_id", key), after.select("doc_id", key)


@query(
    "I5",
    sql=f"""WITH {_TERMINAL}, k AS (SELECT doc_id, {S.squeeze('sentence')} AS key FROM sent)
    SELECT doc_id, count(*) - count(DISTINCT key) AS lost FROM k GROUP BY doc_id HAVING count(*) > count(DISTINCT key)""",
)
def sentences_lost(t):
    before, after = _versions(t)
    return before.exceptAll(after).groupBy("doc_id").agg(F.count("*").alias("lost"))


@query(
    "I5",
    sql=f"""WITH {_TERMINAL}, k AS (SELECT doc_id, {S.squeeze('sentence')} AS key FROM sent)
    SELECT doc_id, count(DISTINCT key) AS shared FROM k GROUP BY doc_id""",
)
def sentences_shared(t):
    before, after = _versions(t)
    return before.intersect(after).groupBy("doc_id").agg(F.count("*").alias("shared"))


@query(
    "I4",
    sql=f"""WITH b AS (SELECT item_id, list_distinct({S.norms('text')}) AS a FROM benchmark), d AS (SELECT doc_id, list_distinct({S.norms('text')}) AS w FROM documents),
    x AS (SELECT item_id, len(a) AS na, unnest(a) AS word FROM b), y AS (SELECT doc_id, len(w) AS nw, unnest(w) AS word FROM d),
    n AS (SELECT item_id, doc_id, na, nw, count(*) AS shared FROM x JOIN y USING (word) GROUP BY ALL)
    SELECT item_id, doc_id, round(shared / CAST(na + nw - shared AS DOUBLE), 6) AS jaccard, round(shared / CAST(least(na, nw) AS DOUBLE), 6) AS overlap FROM n WHERE shared >= 0.6::DOUBLE * na""",
)
def set_similarity(t):
    """Each benchmark text with every document that holds three fifths of its words, whatever their numbers."""
    items = t.benchmark.select("item_id", F.array_distinct(rows.word_norms(F.col("text"))).alias("tokens"))
    documents = t.documents.select("doc_id", F.array_distinct(rows.word_norms(F.col("text"))).alias("tokens"))
    return similarity.held_sets(items, documents, "item_id", "doc_id", 0.6)


@query("F30")
def approximate_corpus_profile(t):
    sentences = rows.sentence_rows(t.documents, ["doc_id", "lang"])
    size = T.count_tokens(F.col("sentence"))
    return sentences.groupBy("lang").agg(
        F.count("*").alias("sentences"),
        F.approx_count_distinct("sentence").alias("about_distinct"),
        F.percentile_approx(size, 0.5).alias("median_tokens"),
        F.percentile_approx(size, 0.95).alias("p95_tokens"),
    )


@query(
    "F30",
    sql=f"""WITH s AS ({S.rows('documents', 'doc_id, lang', S.sentences('text'), 'sentence')}), z AS (SELECT lang, sentence, {S.tokens('sentence')} AS size FROM s),
    t AS (SELECT lang, size, count(*) AS n FROM z GROUP BY ALL), c AS (SELECT lang, size, sum(n) OVER (PARTITION BY lang ORDER BY size) AS upto, sum(n) OVER (PARTITION BY lang) AS total FROM t),
    q AS (SELECT lang, min(size) FILTER (upto >= 0.5 * total) AS tokens_50, min(size) FILTER (upto >= 0.95 * total) AS tokens_95 FROM c GROUP BY lang)
    SELECT lang, count(*) AS sentences, count(DISTINCT sentence) AS distinct_sentences, true AS within_bound, any_value(tokens_50) AS tokens_50, any_value(tokens_95) AS tokens_95 FROM z JOIN q USING (lang) GROUP BY lang""",
)
def sketched_corpus_profile(t):
    """Languages from profiles by language and source, and whether their estimates are near the exact counts."""
    sentences = rows.sentence_rows(t.documents, ["doc_id", "lang", "source"])
    merged = sketches.merged_profiles(sketches.sentence_profiles(sentences, ["lang", "source"]), ["lang"])
    exact = sentences.groupBy("lang").agg(F.count_distinct("sentence").alias("distinct_sentences"))
    near = F.abs(F.col("about_distinct") - F.col("distinct_sentences")) <= sketches.BOUND * F.col("distinct_sentences")
    return merged.join(exact, "lang").select("lang", "sentences", "distinct_sentences", near.alias("within_bound"), "tokens_50", "tokens_95")
