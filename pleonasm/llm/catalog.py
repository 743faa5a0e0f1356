"""The dealt operators as queries over the given tables: columns in, columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pleonasm.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def prompts_of(documents: DataFrame, *more: Column) -> DataFrame:
    """Documents as prompts."""
    return documents.select(F.col("doc_id").alias("prompt_id"), "text", *more)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_pieces(documents: DataFrame) -> DataFrame:
    from pleonasm.llm.packing import pack_prompts

    return pack_prompts(prompts_of(documents), tokenizer=word_tokenizer()).select(
        F.col("prompt_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("prompt_tokens").alias("doc_tokens"), "sequence_id", "offset"
    )


@_query()
def op7_pack_prompts(t: Tables) -> DataFrame:
    return packed_pieces(t.documents)


_LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM {documents}),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, repeated.k IS NOT NULL AS dropped FROM keyed LEFT JOIN repeated USING (k))
"""
LINES_SQL = (
    _LINES_SQL.format(documents="documents")
    + """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""
)


@_query(LINES_SQL)
def op4_drop_repeated_lines(t: Tables) -> DataFrame:
    from pleonasm.llm.lines import drop_repeated_lines

    kept = drop_repeated_lines(prompts_of(t.documents), min_prompts=10)
    return kept.select(F.col("prompt_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# Words are joined by a space in the window, so equal strings are equal word sequences.
SPANS_SQL = """
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35)),
repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (w)),
lists AS (SELECT doc_id, list(p ORDER BY p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs),
texts AS (
  SELECT kept.doc_id, string_agg(word, ' ' ORDER BY kept.p) AS text FROM kept ANTI JOIN gone ON kept.doc_id = gone.doc_id AND kept.p = gone.p GROUP BY kept.doc_id)
SELECT docs.doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(texts.text, '')) AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id) LEFT JOIN texts USING (doc_id)"""


@_query(SPANS_SQL)
def op9_remove_repeated_spans(t: Tables) -> DataFrame:
    from pleonasm.llm.spans import remove_repeated_spans

    kept = remove_repeated_spans(prompts_of(t.documents), window=35)
    return kept.select(F.col("prompt_id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query()
def op5_near_duplicate_prompts(t: Tables) -> DataFrame:
    from pleonasm.llm.simhash import near_duplicate_prompts

    return near_duplicate_prompts(prompts_of(t.documents)).withColumnRenamed("prompt_id", "doc_id")


def _secret_sql() -> str:
    keyword = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    kinds = (
        ("assign", keyword + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
    )
    parts = []
    for k, (name, pattern, group, least) in enumerate(kinds):
        parts.append(
            f"""SELECT doc_id, lang, source, {k} AS k, '{name}' AS kind, value,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS s, length(matches[i]) AS n
FROM (SELECT doc_id, lang, source, matches, gaps, unnest(values) AS value, generate_subscripts(values, 1) AS i
  FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '{pattern}', 0) AS matches, regexp_extract_all(text, '{pattern}', {group}) AS values,
    string_split_regex(text, '{pattern}') AS gaps FROM documents WHERE regexp_matches(text, '{pattern}')))
WHERE length(value) >= {least}"""
        )
    return (
        "WITH found AS ("
        + "\nUNION ALL\n".join(parts)
        + """),
owned AS (SELECT value, count(DISTINCT source) AS owners FROM found GROUP BY value),
judged AS (
  SELECT found.*, CASE WHEN owners >= 3 THEN 'copied' WHEN owners = 1 AND length(value) >= 16 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT regexp_matches(value, '(?i)example|placeholder|changeme|dummy|sample|your|xxxx|\\*\\*\\*') THEN 'live' ELSE 'unclear' END AS verdict
  FROM found JOIN owned USING (value)),
rows_of AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, k) AS spans,
    count(DISTINCT value) FILTER (verdict = 'copied') AS n_copied, count(DISTINCT value) FILTER (verdict = 'live') AS n_live
  FROM judged GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM documents LEFT JOIN rows_of USING (doc_id)"""
    )


@_query(_secret_sql())
def op2_scan_secrets(t: Tables) -> DataFrame:
    """A document's source is taken as its owner, source and language as its repository."""
    from pleonasm.llm.secret_scan import KINDS, scan_secrets, span_names

    found = scan_secrets(prompts_of(t.documents, F.col("lang").alias("repository"), F.col("source").alias("owner")))

    def having(items: Column, field: str, value) -> Column:
        return F.size(F.filter(items, lambda item: item[field] == value)).cast("long")

    counts = [having(F.col("findings"), "kind", k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    verdicts = [having(F.map_values("verdicts"), "verdict", name).alias(f"n_{name}") for name in ("copied", "live")]
    spans = span_names(F.col("findings"))
    return found.select(F.col("prompt_id").alias("doc_id"), *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), *verdicts)


_WORDS_SQL = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
BENCHMARK_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, starts.n, item_id FROM starts JOIN windows ON windows.n = starts.n AND array_to_string(w[i:i + starts.n - 1], ' ') = win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT docs.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def benchmark_cases(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("case_id"), F.col("text").alias("prompt"))


@_query(BENCHMARK_SQL)
def op3_find_benchmark_passages(t: Tables) -> DataFrame:
    from pleonasm.llm.decontaminate import find_benchmark_passages

    found = find_benchmark_passages(prompts_of(t.documents), benchmark_cases(t.benchmark), window=10)
    return found.select(
        F.col("prompt_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def labelled_prompts(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("prompt_id"), "quality")


@_query()
def op10_score_quality(t: Tables) -> DataFrame:
    from pleonasm.llm.quality import score_quality

    return score_quality(prompts_of(t.documents), labelled_prompts(t.labels)).withColumnRenamed("prompt_id", "doc_id")


RULES_SQL = """
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8)),
again AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT windows.doc_id, unnest(range(i, i + 8)) AS p FROM windows JOIN again USING (doc_id, w)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT docs.doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(words) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(words) AS base_failed
  FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
failed AS (SELECT source, unnest(['words', 'repeats', 'symbols', 'lines']) AS rule,
    unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 100 * n_symbols > 30 * n_words, 30 * n_dup_lines > n_words]) AS fails FROM base WHERE source IS NOT NULL),
hosts AS (SELECT source, rule, count(*) AS n, sum(CASE WHEN fails THEN 1 ELSE 0 END) AS f FROM failed GROUP BY source, rule),
moments AS (SELECT rule, least(greatest(avg(f / n), 1e-3), 1 - 1e-3) AS m, var_pop(f / n) AS v FROM hosts GROUP BY rule),
prior AS (SELECT rule, m, least(greatest(m * (1 - m) / greatest(v, 1e-9) - 1, 1.0), 1e6) AS k FROM moments),
rates AS (SELECT source, m, n + k AS total, (f + m * k) / (n + k) AS rate FROM hosts JOIN prior USING (rule)),
bad AS (SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 3 * m) AS host_failed FROM rates GROUP BY source)
SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(host_failed, false) AS host_failed, NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM base LEFT JOIN bad USING (source)"""


@_query(RULES_SQL)
def op8_judge_prompts(t: Tables) -> DataFrame:
    """A document's source is its host."""
    from pleonasm.llm.rules import judge_prompts

    return judge_prompts(prompts_of(t.documents, F.col("source").alias("host"))).drop("host_rate").withColumnRenamed("prompt_id", "doc_id")


CHAT_SQL = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM turns WHERE speaker <> 'system'),
parts AS (
  SELECT t.conv_id, participant, turn, speaker, content, speaker = participant AS own,
    CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = participant THEN '<|assistant|>' ELSE '<|user:' || speaker || '|>' END || chr(10) AS heading,
    content || '<|end|>' || chr(10) AS body
  FROM turns t JOIN people p ON t.conv_id = p.conv_id),
placed AS (SELECT *, sum(length(heading) + length(body)) OVER (PARTITION BY conv_id, participant ORDER BY turn, speaker, content ROWS UNBOUNDED PRECEDING) AS stop FROM parts)
SELECT conv_id, participant, count(*) AS n_turns, count(*) FILTER (own) AS n_own, sha256(string_agg(heading || body, '' ORDER BY turn, speaker, content)) AS text_sha256,
  string_agg(CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY stop) FILTER (own) AS mask
FROM placed GROUP BY conv_id, participant"""


@_query(CHAT_SQL)
def op1_rotate_perspectives(t: Tables) -> DataFrame:
    from pleonasm.llm.chat import rotate_perspectives

    messages = t.conversations.select(F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"))
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rotate_perspectives(messages).select(
        F.col("conversation_id").alias("conv_id"), "participant", "n_turns", "n_own", F.sha2("text", 256).alias("text_sha256"), F.array_join(spans, ",").alias("mask")
    )


@_query()
def op6_resolve_revisits(t: Tables) -> DataFrame:
    from uuid import uuid4

    from pleonasm.llm.warc import read_archives, with_original_payloads, write_archives
    from pleonasm.session import shared_folder

    folder = f"{shared_folder(t.spark).rstrip('/')}/archives-{uuid4().hex}"
    write_archives(t.pages.select(F.col("page_id").alias("record_id"), "url", F.col("html").alias("payload")), folder)
    records = with_original_payloads(read_archives(t.spark, folder, with_payload=False))
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


# CRC-32 bit by bit, the lowest bit of a byte first; windows of words are joined by one space.
RESAMPLE_SQL = f"""
WITH texts AS (
  SELECT TRUE AS known, doc_id, {_WORDS_SQL} AS w FROM documents
  UNION ALL SELECT FALSE, NULL, {_WORDS_SQL} FROM benchmark),
features AS (
  SELECT known, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
counted AS (SELECT known, doc_id, f, count(*) AS n FROM features GROUP BY ALL),
names AS (
  SELECT f, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, len(h) + 1, 2), lambda i: list_transform([4, 5, 6, 7, 0, 1, 2, 3],
      lambda k: ((instr('0123456789ABCDEF', h[CASE WHEN k < 4 THEN i ELSE i + 1 END]) - 1) >> (k % 4)) & 1)))),
    lambda c, d: CASE WHEN (xor(c, d) & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM counted))),
hashed AS (SELECT known, doc_id, n, xor(c, 4294967295) % 10000 AS bucket FROM counted JOIN names USING (f)),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (known), 0) AS s, coalesce(sum(n) FILTER (NOT known), 0) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sums, totals),
weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS total FROM hashed JOIN gains USING (bucket) WHERE known GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(CAST((total - ((total % n_features) + n_features) % n_features) // n_features AS BIGINT), 0) AS weight,
    CAST('0x' || substr(sha256('7:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM texts d LEFT JOIN weights ON weights.doc_id = d.doc_id WHERE known),
noised AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM noised WHERE n_words >= 20)
SELECT noised.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM noised LEFT JOIN ranked USING (doc_id)"""


@_query(RESAMPLE_SQL)
def op11_resample_prompts(t: Tables) -> DataFrame:
    from pleonasm.llm.resampling import resample_prompts

    drawn = resample_prompts(prompts_of(t.documents), benchmark_cases(t.benchmark), buckets=10_000, min_words=20, percent=25, seed=7)
    return drawn.withColumnRenamed("prompt_id", "doc_id")


NEGATIVES_SQL = """
WITH rows_of AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows_of a, rows_of b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""


@_query(NEGATIVES_SQL)
def op12_mine_hard_negatives(t: Tables) -> DataFrame:
    """Vectors are those of prompts, labels their types; every hundredth one is an anchor."""
    from pleonasm.llm.hard_negatives import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = t.embeddings.select(F.col("vec_id").alias("prompt_id"), F.col("embedding").alias("vector"), label.alias("prompt_type"))
    return mine_hard_negatives(vectors, F.col("prompt_id") % 100 == 0)


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query()
def op13_encode_prompts(t: Tables) -> DataFrame:
    from pleonasm.llm.bpe import decoded_text, encode_prompts

    encoded = encode_prompts(prompts_of(t.documents), tokenizer=byte_tokenizer())
    return encoded.select(
        F.col("prompt_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded_text(F.col("ids"), byte_tokenizer(), encoded), 256).alias("decoded_sha256"),
    )
