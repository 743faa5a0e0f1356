"""SQL fragments for the check side. They are written for DuckDB and share no code with the jobs."""

from __future__ import annotations

from pleonasm import lexicons as L
from pleonasm.sources.derived import DERIVED


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def array(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def source(name: str) -> str:
    """A derived input as a named query."""
    return f"{name} AS ({DERIVED[name].sql()})"


def pieces(text: str) -> str:
    return f"len(regexp_extract_all({text}, {q(L.TOKEN)}))"


def tokens(text: str) -> str:
    return (
        f"(CASE WHEN coalesce(length({text}), 0) = 0 THEN 0::BIGINT"
        f" ELSE greatest(1, CAST(floor({pieces(text)} * 1.15::DOUBLE) AS BIGINT)) END)"
    )


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def words(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\S+'))"


def sentences(text: str, lines: bool = True) -> str:
    """List of sentences; the end mark is kept and the blanks after it become the separator."""
    marked = rf"regexp_replace({text}, '([.!?])\s+', '\1' || chr(31), 'g')"
    if lines:
        marked = rf"regexp_replace({marked}, '\n+', chr(31), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(31)), lambda s: {strip('s')}), lambda s: s <> '')"
    )


def matched(text: str, min_words: int) -> str:
    """Complete sentences: what stands on the last line before an end mark or before the end of the text."""
    marked = rf"regexp_replace(regexp_replace({text}, '\n$', ''), '([.!?])(\s)', '\1' || chr(31) || '\2', 'g')"
    last = rf"list_transform(string_split({marked}, chr(31)), lambda s: {strip(r'regexp_extract(s, ' + q(r'[^\n]*$') + ')')})"
    return f"list_filter({last}, lambda s: s <> '' AND {words('s')} >= {min_words} AND NOT contains(s, '__PROTECTED_'))"


def squeeze(text: str) -> str:
    return strip(rf"regexp_replace(lower({text}), '\s+', ' ', 'g')")


def bare(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9$%]+', ' ', 'g'))"


def norms(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all({text}, {q(L.WORD_TOKEN)}), lambda t: regexp_replace(lower(t), {q(chr(39) + '+$')}, ''))"
    )


def word_bound(words_) -> str:
    """Pattern that holds when any of `words_` stands alone, letters of any script counting as letters."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(words_) + r")(?:$|[^\p{L}\p{N}_])"


def rows(table: str, keys: str, expression: str, name: str, start: int = 0) -> str:
    """One row per list element with its position."""
    return (
        f"SELECT {keys}, CAST(p - 1 + {start} AS INT) AS pos, l[p] AS {name} FROM (SELECT {keys}, l, unnest(generate_series(1, len(l))) AS p"
        f" FROM (SELECT {keys}, {expression} AS l FROM {table}))"
    )


def grammar(table: str, keys: str, text: str) -> str:
    """Flags per text, from one row per sentence."""
    plain = rf"regexp_replace(regexp_replace({text}, '```[\s\S]*?```', ' ', 'g'), '__PROTECTED_\d+__', 'VALUE', 'g')"
    return rf"""gs AS ({rows(table, keys, sentences(plain), 's')}),
    gw AS (SELECT *, regexp_extract_all(lower(s), '[A-Za-z'']+') AS w FROM gs WHERE NOT (regexp_matches(s, '^[-*•]') OR s LIKE '%:' OR regexp_matches(s, '^[A-Z][A-Za-z ]{{1,40}}:\s+\S+'))),
    gf AS (SELECT {keys}, w[1] AS a, w[2] AS b, w[len(w)] AS z, len(w) AS n, regexp_matches(regexp_extract(s, '([^A-Za-z'']*)$', 1), '[0-9%$]') AS obj FROM gw WHERE len(w) > 0),
    gg AS (SELECT {keys}, unnest([
      CASE WHEN (a IN {values(L.DANGLING_WORDS)} AND NOT (n > 1 AND a = 'by' AND b LIKE '%ing')) OR (z IN {values(L.DANGLING_WORDS)} AND NOT obj) THEN 'dangling_connector_or_preposition' END,
      CASE WHEN n = 1 AND a NOT IN {values(L.FRAGMENT_OK)} THEN 'empty_or_fragment_sentence' END,
      CASE WHEN a IN {values(L.MODAL_STARTERS)} THEN 'missing_subject_before_modal' END,
      CASE WHEN n > 1 AND a IN ('the', 'a', 'an') AND b IN {values(L.ORPHAN_STARTERS)} THEN 'missing_subject_before_verb' END,
      CASE WHEN n > 1 AND z IN {values(L.ORPHAN_ENDERS)} AND NOT obj THEN 'orphan_verb_end' END,
      CASE WHEN a IN {values(L.ORPHAN_STARTERS)} AND NOT (n > 1 AND a = 'do' AND b = 'not') THEN 'orphan_verb_start' END]) AS flag FROM gf
      UNION ALL SELECT {keys}, unnest([CASE WHEN contains({text}, '  ') THEN 'double_spaces' END, CASE WHEN regexp_matches({plain}, '\s+[,.!?;:]') THEN 'broken_punctuation' END]) FROM {table}),
    grammar AS (SELECT {keys}, coalesce(string_agg(DISTINCT flag, '|' ORDER BY flag), '') AS flags FROM gg GROUP BY {keys})"""


def similarity(table: str, keys: str, a: str, b: str) -> str:
    """Named query `scored` (keys, sim): the larger of the Jaccard share of words and 0.85 times the Dice share of runs of three words."""
    words_of = lambda t: f"regexp_extract_all(lower({t}), '[A-Za-z0-9''-]+')"
    runs = lambda w: f"CASE WHEN len({w}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len({w}) - 2, 1) + 1), lambda i: array_to_string({w}[i:i + 2], ' '))) END"
    return f"""split_words AS MATERIALIZED (SELECT {keys}, {words_of(a)} AS wa, {words_of(b)} AS wb FROM {table}),
    word_sets AS MATERIALIZED (SELECT {keys}, list_distinct(wa) AS da, list_distinct(wb) AS db, {runs('wa')} AS ra, {runs('wb')} AS rb FROM split_words),
    shared_sets AS (SELECT *, len(list_intersect(da, db)) AS n_words, len(list_intersect(ra, rb)) AS n_runs FROM word_sets),
    scored AS (SELECT {keys}, round(greatest(n_words / CAST(greatest(1, len(da) + len(db) - n_words) AS DOUBLE), 0.85::DOUBLE * (2.0::DOUBLE * n_runs / greatest(1, len(ra) + len(rb)))), 3) AS sim FROM shared_sets)"""


def same_facts(before: str, after: str) -> str:
    """Numbers, addresses and ids of `before` all stand in `after`."""
    found = lambda t: rf"regexp_extract_all({t}, '(?i)https?://[^\s)>\"]+|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}|[A-Z]{{2,}}(?:-[A-Z0-9]+)+|\d+(?:\.\d+)?')"
    return f"list_has_all(list_concat({found(after)}, ['']), {found(before)})"


def render_list(items: str, word: str = "and") -> str:
    return (
        f"CASE WHEN len({items}) <= 1 THEN array_to_string({items}, '') WHEN len({items}) = 2 THEN array_to_string({items}, ' {word} ')"
        f" ELSE array_to_string({items}[:len({items}) - 1], ', ') || ', {word} ' || {items}[len({items})] END"
    )
