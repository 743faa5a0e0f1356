"""Texts to rows: tokens, sentences, paragraphs, segments, sections, retrieved chunks.

Every explode here works on one text at a time and adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions import text as T

_MARK, _CUT, _STOP = "\u001e", "\u001f", "\u001d"


def worked_out(df: DataFrame, *columns: str) -> DataFrame:
    """`df`, whose `columns` no filter behind it works out again.

    Spark moves a filter below the columns it asks for, and puts what they are made of into it, once for each time it
    asks: a wide expression is then worked out two to five times. A filter is not moved below a column that is not
    deterministic; the condition here is, to Spark, and holds for every row.
    """
    return df.withColumns({c: F.when(F.spark_partition_id() >= 0, F.col(c)) for c in columns})


def token_statistics(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Texts, pieces and estimated tokens per group."""
    sized = df.select(*by, T.count_pieces(F.col(text)).alias("_pieces"), T.count_tokens(F.col(text)).alias("_tokens"))
    return sized.groupBy(*by).agg(
        F.count("*").alias("texts"),
        F.sum("_pieces").cast("long").alias("pieces"),
        F.sum("_tokens").alias("tokens"),
        F.max("_tokens").alias("max_tokens"),
    )


def conversation_tokens(messages: DataFrame, conversation: str, role: str = "role", text: str = "text") -> DataFrame:
    """Token total of each conversation: role, content and 4 per message."""
    size = T.count_tokens(F.col(role)) + T.count_tokens(F.col(text)) + F.lit(L.MESSAGE_OVERHEAD)
    return messages.groupBy(conversation).agg(F.sum(size).alias("tokens"), F.count("*").alias("messages"))


def _explode(df: DataFrame, keys: list[str], items: Column, name: str) -> DataFrame:
    return df.select(*keys, F.posexplode(items).alias("pos", name))


def sentence_rows(df: DataFrame, keys: list[str], text: str = "text", pattern: str = T.SPLIT_TERMINAL_OR_LINE) -> DataFrame:
    """One row per sentence, cut after `.!?` and, by default, at line ends."""
    return _explode(df, keys, T.sentences(F.col(text), pattern), "sentence")


def matched_sentence_rows(df: DataFrame, keys: list[str], text: str = "text", min_words: int = 3) -> DataFrame:
    """One row per complete sentence of at least `min_words` that holds no placeholder."""
    return _explode(df, keys, T.matched_sentences(F.col(text), min_words), "sentence")


def word_tokens(text: Column) -> Column:
    return T.find_all(text, L.WORD_TOKEN)


def word_norms(text: Column) -> Column:
    return F.transform(word_tokens(text), lambda t: F.rtrim(F.lower(t), F.lit("'")))


def word_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per word token with its normal form; placeholders stay whole."""
    rows = _explode(df, keys, word_tokens(F.col(text)), "token")
    return rows.withColumn("norm", F.rtrim(F.lower("token"), F.lit("'")))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: T.strip(p) != "")


def paragraph_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per paragraph; blank lines separate them."""
    return _explode(df, keys, paragraphs(F.col(text)), "paragraph")


def segment_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Text cut around placeholders, with the kind of each piece."""
    marked = F.regexp_replace(F.col(text), f"({L.PLACEHOLDER})", f"{_MARK}$1{_MARK}")
    pieces = F.filter(F.split(marked, _MARK), lambda s: s != "")
    kind = F.when(F.col("segment").rlike(f"^{L.PLACEHOLDER}$"), "protected").otherwise("natural_language")
    return _explode(df, keys, pieces, "segment").withColumn("kind", kind)


def _sections(text: Column, header: str) -> Column:
    """Array of `label CUT body`; element 0 is what stands before the first header."""
    marked = F.regexp_replace(text, rf"(?imd)^({header}):\s*$", f"{_MARK}$1{_CUT}")
    return F.split(marked, _MARK)


def section_array(text: Column) -> Column:
    """Typed sections of a prompt as an array of (label, kind, body)."""

    def typed(piece: Column) -> Column:
        label = F.trim(F.element_at(F.split(piece, _CUT), 1))
        low = F.lower(label)
        kind = T.first_match(
            [
                (low.rlike("question|task|ticket|request"), "variable"),
                (low.rlike("instructions?|reminder|system"), "instruction"),
            ],
            "context",
        )
        return F.struct(label.alias("label"), kind.alias("kind"), T.strip(F.try_element_at(F.split(piece, _CUT), F.lit(2))).alias("body"))

    def untitled(label: str, kind: str, body: Column) -> Column:
        return F.array(F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), T.strip(body).alias("body")))

    pieces = _sections(text, L.TYPED_HEADER)
    titled = F.transform(F.slice(pieces, 2, 1 << 30), typed)
    whole = untitled("FULL_PROMPT", "context", text)
    parts = F.concat(untitled("PREFACE", "instruction", F.element_at(pieces, 1)), titled)
    return F.when(F.size(pieces) == 1, whole).otherwise(F.filter(parts, lambda s: s["body"] != ""))


def typed_sections(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per section with its label, its kind (variable, instruction, context) and its body."""
    rows = df.select(*keys, F.posexplode(section_array(F.col(text))).alias("section_no", "_s"))
    return rows.select(*keys, "section_no", "_s.label", "_s.kind", "_s.body")


def generic_sections(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per `Header:` section of any name of 3 to 61 characters; bodies may be empty."""
    pieces = F.slice(_sections(F.col(text), L.GENERIC_HEADER), 2, 1 << 30)
    rows = df.select(*keys, F.posexplode(pieces).alias("section_no", "_p"))
    label, body = F.element_at(F.split("_p", _CUT), 1), F.try_element_at(F.split("_p", _CUT), F.lit(2))
    return rows.select(*keys, "section_no", F.trim(label).alias("header"), T.strip(body).alias("body"))


def chunk_array(text: Column) -> Column:
    """Retrieved chunks of a prompt as an array of (chunk_no, header, body), numbered from 1. A chunk ends at the next
    one, at a section that is no evidence, or at a line that holds only a placeholder."""
    stops = "|".join(L.NON_EVIDENCE_HEADERS)
    stopped = F.regexp_replace(text, rf"(?imd)^(?:(?:{stops})\s*|{L.PLACEHOLDER}\s*)$", f"{_STOP}$0")

    def chunk(piece: Column, i: Column) -> Column:
        label, rest = F.element_at(F.split(piece, _CUT), 1), F.try_element_at(F.split(piece, _CUT), F.lit(2))
        body = T.strip(F.element_at(F.split(rest, _STOP), 1))
        return F.struct((i + 1).alias("chunk_no"), label.alias("header"), body.alias("body"))

    return F.transform(F.slice(_sections(stopped, L.CHUNK_HEADER), 2, 1 << 30), chunk)


def chunk_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per retrieved chunk."""
    return df.select(*keys, F.explode(chunk_array(F.col(text))).alias("_c")).select(*keys, "_c.*")


def section_body(text: Column, header: str) -> Column:
    """Body of a named section up to the next header line, or null."""
    pattern = rf"(?imsd)^{header}:\s*(.*?)(?=^[A-Z][A-Za-z0-9 /&-]{{2,60}}:\s*$|\z)"
    return F.when(text.rlike(rf"(?im)^{header}:"), T.strip(F.regexp_extract(text, pattern, 1)))


# --- clean-up ------------------------------------------------------------------------------------


def token_cleanup(text: Column) -> Column:
    """Collapse repeated low-information words and spacing damage."""
    words = "|".join(L.LOW_INFORMATION_WORDS)
    out = F.regexp_replace(text, rf"(?i)\b({words})\b(?:\s+\1\b)+", "$1")
    out = F.regexp_replace(out, r"(?i)\bPlease\s+kindly\s+(?=\w)", "Please ")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return F.regexp_replace(out, r"\s+([.,;:!?])", "$1")


def normal_space(text: Column) -> Column:
    """Single blanks, at most one empty line, no blanks at the ends."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    return T.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def break_before_headers(text: Column) -> Column:
    """Known headers that ended up inside a line start a paragraph again."""
    names = (
        "Task|User Question|Customer Ticket|Agent Instructions|Agent Reminder|Canonical Evidence"
        "|Unique Evidence|Preserved Unique Chunks"
    )
    out = F.regexp_replace(text, rf"(?<!^)(?<!\n)\s+({names}):", "\n\n$1:")
    return F.regexp_replace(out, r"([.!?])\s+(```)", "$1\n$2")


def planned_cleanup(text: Column) -> Column:
    """Repair spacing after spans were cut out, and close an open question."""
    out = F.regexp_replace(text, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, rf"([.!?])\s+({L.PLACEHOLDER})", "$1\n$2")
    out = F.regexp_replace(out, r"\s+([.,!?;:])", "$1")
    out = F.regexp_replace(out, r"([.!?]){2,}", "$1")
    out = F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(" ,;:"))
    clause = F.try_element_at(F.split(out, r"[.!?]\s+"), F.lit(-1))
    asks = F.exists(F.slice(word_norms(clause), 1, 3), lambda w: w.isin(list(L.QUESTION_STARTERS)))
    return F.when(asks & ~out.rlike(r"[?.!]$"), F.concat(out, F.lit("?"))).otherwise(out)


def cleanup_report(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """How many texts the clean-up changes and how many characters it drops."""
    cleaned = df.select(*by, F.length(text).alias("_n"), F.col(text).alias("_t"), token_cleanup(F.col(text)).alias("_c"))
    return cleaned.groupBy(*by).agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("_t") != F.col("_c")).alias("changed"),
        F.sum(F.col("_n") - F.length("_c")).cast("long").alias("chars_dropped"),
    )
