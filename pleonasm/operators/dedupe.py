"""Exact repeats: inside one text without a shuffle, across a corpus by pre-aggregated keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions import arrays as A
from pleonasm.functions import text as T
from pleonasm.operators import rows as R

# Ways to say "the same sentence".
KEYS: dict[str, Callable[[Column], Column]] = {
    "squeezed": T.squeeze,
    "normal": T.normal_text,
    "bare": lambda s: T.spaced(F.lower(s), r"[a-z0-9$%_]+"),
}


def with_kept_sentences(
    df: DataFrame, text: str = "text", key: str = "squeezed", pattern: str = T.SPLIT_TERMINAL, out: str = "kept_text"
) -> DataFrame:
    """Adds the text with only the first of each repeated sentence, and how many were dropped."""
    staged = (
        df.withColumn("_s", T.sentences(F.col(text), pattern))
        .withColumn("_k", A.keyed(F.col("_s"), KEYS[key]))
        .withColumn("_p", A.first_positions(F.col("_k")))
    )
    dropped = F.size("_s") - F.size("_p")
    kept = F.when(dropped == 0, F.col(text)).otherwise(R.normal_space(F.array_join(A.pick(F.col("_s"), F.col("_p")), " ")))
    return staged.withColumn("dropped_sentences", dropped).withColumn(out, kept).drop("_s", "_k", "_p")


def keep_first_lines(text: Column) -> Column:
    """Drop repeated lines of three words or more that are neither headers nor bullets."""
    lines = F.split(text, "\n")
    exempt = lambda s: (s == "") | F.endswith(s, F.lit(":")) | F.startswith(s, F.lit("- ")) | (T.word_count(s) < 3)

    def key(line: Column, i: Column) -> Column:
        s = T.strip(line)
        # An exempt line gets a key of its own.
        return F.when(exempt(s), F.concat(F.lit("\u0000"), i.cast("string"))).otherwise(KEYS["bare"](s))

    keys = F.transform(lines, key)
    kept = A.pick(lines, A.first_positions(A.keyed(keys, lambda k: k)))
    return T.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def keep_first_across(sentences: DataFrame, order: list[str], sentence: str = "sentence", key: str = "normal") -> DataFrame:
    """Sentence rows of a whole corpus with a `first` flag on the first copy of each.

    The first copy of a key is found by a partial aggregation, so a sentence that fills a third of
    the corpus shuffles one row per task. Rows are matched back by their own position, which is
    unique, and not by the skewed key.
    """
    keyed = sentences.withColumn("_key", KEYS[key](F.col(sentence)))
    firsts = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first")).select("_first.*").withColumn("_hit", F.lit(True))
    return (
        keyed.drop("_key").join(firsts, order, "left").withColumn("first", F.coalesce("_hit", F.lit(False))).drop("_hit")
    )


def repeated_sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Later copies of a sentence of three words or more in the same text, with the kept position."""
    return _later(df, keys, T.complete_sentences(F.col(text)), 3, "repeated_sentence")


def repeated_paragraphs(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Later copies of a paragraph of six words or more in the same text, with the kept position."""
    return _later(df, keys, R.paragraphs(F.col(text)), 6, "repeated_paragraph")


def _later(df: DataFrame, keys: list[str], items: Column, min_words: int, kind: str) -> DataFrame:
    norm = lambda s: F.array_join(R.word_norms(s), " ")
    staged = df.select(*keys, items.alias("_i")).withColumn("_d", A.shared_keys(A.keyed(F.col("_i"), norm)))
    hits = F.filter(F.col("_d"), lambda d: F.size(F.split(d["k"], " ")) >= min_words)
    spans = F.transform(hits, lambda d: F.struct(d["k"].alias("k"), d["i"].alias("i"), F.get("_i", d["i"]).alias("span")))
    rows = staged.select(*keys, F.explode(spans).alias("_h"))
    # Copies meet by their text and key; what is shuffled are the copies, not the texts.
    first = F.min("_h.i").over(Window.partitionBy(*keys, "_h.k"))
    return rows.withColumn("kept_pos", first.cast("int")).filter(F.col("_h.i") > F.col("kept_pos")).select(
        *keys, F.col("_h.i").alias("pos"), "kept_pos", F.col("_h.span").alias("span"), F.lit(kind).alias("candidate_type")
    )


def repeated_tokens(df: DataFrame, keys: list[str], text: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """Tokens equal to the token before them; `only` restricts them to given words."""
    staged = df.select(*keys, A.adjacent_repeats(R.word_norms(F.col(text))).alias("_r"))
    rows = staged.select(*keys, F.explode("_r").alias("_h")).select(*keys, F.col("_h.i").alias("pos"), F.col("_h.value").alias("norm"))
    return rows if only is None else rows.filter(F.col("norm").isin(list(only)))


def _discourse(text: Column) -> Column:
    norms = F.transform(R.word_norms(text), lambda n, i: F.struct(n.alias("norm"), i.alias("pos")))
    return F.filter(norms, lambda t: t["norm"].isin(list(L.DISCOURSE_WORDS)))


def repeated_filler(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Discourse words that were already used earlier in the same text."""
    staged = df.select(*keys, _discourse(F.col(text)).alias("_d"))
    again = A.pick(F.col("_d"), F.transform(A.later_copies(A.keyed(F.col("_d"), lambda t: t["norm"])), lambda p: p["i"]))
    return staged.select(*keys, F.explode(again).alias("_h")).select(*keys, "_h.pos", "_h.norm")


def trailing_filler(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Texts that end on a discourse word they had used before."""
    staged = df.select(*keys, R.word_norms(F.col(text)).alias("_n")).withColumn("norm", F.try_element_at("_n", F.lit(-1)))
    hit = F.col("norm").isin(list(L.DISCOURSE_WORDS)) & (F.array_position("_n", F.col("norm")) < F.size("_n"))
    return staged.filter(hit).select(*keys, (F.size("_n") - 1).alias("pos"), "norm")


def repeated_ngrams(df: DataFrame, keys: list[str], n: int, text: str = "text") -> DataFrame:
    """n-grams said again in the same text without touching their first use: times and first position."""
    return repeated_ngrams_of_sizes(df, keys, n, n, text).drop("n")


def repeated_ngrams_of_sizes(df: DataFrame, keys: list[str], least: int, most: int, text: str = "text") -> DataFrame:
    """`repeated_ngrams` of every length from `least` to `most`, with their length `n`.

    A text is taken apart once. A run of words repeats only where the run without its last word does, so each length looks
    at the places the one before has left. Only n-grams that do repeat leave the row, so the shuffle carries the findings,
    not the corpus.
    """
    staged = df.select(*keys, R.word_norms(F.col(text)).alias("_n"))
    parts = []
    for n in range(least, most + 1):
        places = F.transform("_n", lambda w, i: i) if n == least else F.col(f"_g{n - 1}.i")
        whole = F.filter(places, lambda i: i + n <= F.size("_n"))
        grams = F.transform(whole, lambda i: F.struct(F.array_join(F.slice("_n", i + 1, n), " ").alias("k"), i.alias("i")))
        staged = staged.withColumn(f"_g{n}", A.shared_keys(F.sort_array(grams)))
        parts.append(F.transform(f"_g{n}", lambda g: F.struct(F.lit(n).alias("n"), g["k"].alias("k"), g["i"].alias("i"))))
    hits = staged.select(*keys, F.explode(F.concat(*parts)).alias("_h")).select(*keys, "_h.n", F.col("_h.k").alias("ngram"), F.col("_h.i").alias("_pos"))
    words = F.split("ngram", " ")
    allowed = (
        ~F.contains("ngram", F.lit("__protected_"))
        & ~F.col("ngram").isin(list(L.DOMAIN_PHRASES))
        & ~F.concat_ws(" ", "ngram", "ngram").isin(list(L.DOMAIN_PHRASES))
        & ~(F.array_contains(words, "dup") & F.array_contains(words, "chunk"))
    )
    first = F.min("_pos").over(Window.partitionBy(*keys, "n", "ngram"))
    return (
        hits.filter(allowed)
        .withColumn("first_pos", first)
        .filter(F.col("_pos") >= F.col("first_pos") + F.col("n"))
        .groupBy(*keys, "n", "ngram")
        .agg(F.min("first_pos").alias("first_pos"), F.count("*").alias("times"))
    )


def repeated_comparisons(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Later uses of "better than" and its like. Reported, never removed."""
    staged = df.select(*keys, R.word_norms(F.col(text)).alias("_n"))
    pairs = F.transform(
        "_n",
        lambda w, i: F.struct(F.concat_ws(" ", w, F.get("_n", i + 1)).alias("phrase"), i.alias("pos")),
    )
    staged = staged.select(*keys, F.filter(pairs, lambda p: p["phrase"].isin(list(L.RELATION_PAIRS))).alias("_p"))
    numbered = F.transform("_p", lambda p, i: F.struct(p["phrase"].alias("phrase"), p["pos"].alias("pos"), i.alias("i")))
    later = F.filter(numbered, lambda p: F.array_position(F.col("_p.phrase"), p["phrase"]) <= p["i"])
    return staged.select(*keys, F.explode(later).alias("_h")).select(*keys, "_h.pos", "_h.phrase")


def longest_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate per span and type: the one with the longest text."""
    rank = F.struct(F.length("span").alias("n"), F.col("span"))
    return candidates.groupBy(*keys, "start", "end", "candidate_type").agg(F.max_by("span", rank).alias("span"))


def duplicate_counts(sentences: DataFrame, sentence: str = "sentence", key: str = "squeezed", min_count: int = 2) -> DataFrame:
    """Keys that occur at least `min_count` times anywhere in the corpus."""
    return (
        sentences.groupBy(KEYS[key](F.col(sentence)).alias("key"))
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") >= min_count)
    )


def most_repeated(sentences: DataFrame, k: int, sentence: str = "sentence", key: str = "squeezed") -> DataFrame:
    """The k most repeated sentences; ties go to the smaller key."""
    return duplicate_counts(sentences, sentence, key).orderBy(F.desc("copies"), "key").limit(k)


def repeated_ratio(text: Column) -> Column:
    """Share of sentences (three words or more) that repeat another one of the same text."""
    keys = F.transform(F.filter(T.complete_sentences(text), lambda s: T.word_count(s) >= 3), T.bare_words)
    share = lambda k: F.round((F.size(k) - F.size(F.array_distinct(k))) / F.greatest(F.size(k), F.lit(1)), 3)
    return A.let(keys, share)
