"""Column expressions over text: tokens, sentences, normal forms, list rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions.arrays import let, literal_array, reusable  # noqa: F401 - literal_array is part of this module's surface
from pleonasm.functions.numbers import number_value

BLANKS = " \t\n\x0b\f\r"
SPLIT_TERMINAL = r"(?<=[.!?])\s+"
SPLIT_TERMINAL_OR_LINE = r"(?<=[.!?])\s+|\n+"


def find_all(text: Column, pattern: str) -> Column:
    """All matches of `pattern`, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spaced(text: Column, pattern: str) -> Column:
    """All matches of `pattern` with single blanks between them.

    Where a pattern stands for a run of characters, this is the text with everything else replaced by blanks, and
    several times as fast: Spark's replacement costs some microseconds for each match.
    """
    return F.array_join(find_all(text, pattern), " ")


def holds(text: Column, low: Column, needed: tuple[str, ...] | str) -> Column:
    """A cheap test before a search in any case. `low` is the text in lower case.

    `needed` is what every match of the search has in it: one of some strings, or an ending where these are too common.
    """
    if isinstance(needed, str):
        return text.rlike(needed)
    found = F.contains(low, F.lit(needed[0]))
    for word in needed[1:]:
        found |= F.contains(low, F.lit(word))
    return found


def find_all_of(text: Column, patterns, needs) -> Column:
    """An array of all matches for each of `patterns`, without regard to case; null for null.

    A pattern is searched for where the text holds what it needs.
    """
    none = F.array().cast("array<string>")

    def searched(low: Column) -> Column:
        each = zip(patterns, needs, strict=True)
        return F.array(*[F.when(holds(text, low, needed), find_all(text, f"(?i){p}")).otherwise(none) for p, needed in each])

    return F.when(text.isNotNull(), let(F.lower(text), searched))


def count_pieces(text: Column) -> Column:
    """Words plus punctuation marks."""
    return F.coalesce(F.regexp_count(text, F.lit(L.TOKEN)), F.lit(0))


def count_tokens(text: Column) -> Column:
    """Token estimate: pieces times 1.15, truncated, at least 1 for a non-empty text."""
    estimate = F.floor(count_pieces(text) * F.lit(L.TOKEN_FACTOR)).cast("long")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"), estimate)
    )


def word_count(text: Column) -> Column:
    """Runs of non-blank characters."""
    return F.regexp_count(text, F.lit(r"\S+"))


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def sentences(text: Column, pattern: str = SPLIT_TERMINAL_OR_LINE) -> Column:
    """Non-blank sentences in order."""
    pieces = F.transform(F.split(text, pattern), strip)
    return F.filter(pieces, lambda piece: piece != "")


def complete_sentences(text: Column) -> Column:
    """Sentences that end with a mark or with the text, as they stand on one line.

    A line that stops without a mark is no sentence unless the text ends there. The text is cut after
    each mark and the last line of a piece is kept, which is linear in the length of the text; a
    search for "anything up to a mark" would be quadratic on a long line without one.
    """
    pieces = F.split(F.regexp_replace(text, r"\n\z", ""), r"(?<=[.!?])(?=\s)")
    last_lines = F.transform(pieces, lambda p: strip(F.substring_index(p, "\n", -1)))
    return F.filter(last_lines, lambda s: s != "")


def matched_sentences(text: Column, min_words: int) -> Column:
    """Complete sentences of at least `min_words` that hold no placeholder."""
    return F.filter(
        complete_sentences(text), lambda s: (word_count(s) >= min_words) & ~F.contains(s, F.lit("__PROTECTED_"))
    )


def squeeze(text: Column) -> Column:
    """Lower case with single spaces."""
    return spaced(F.lower(text), r"\S+")


def bare_words(text: Column) -> Column:
    """Lower-case letters, digits, `$` and `%`; everything else is a space."""
    return spaced(F.lower(text), r"[a-z0-9$%]+")


@reusable
def normal_text(text: Column) -> Column:
    """Comparison key: number words and units in one form, punctuation dropped."""
    # No more nested than this: every `let` costs the analyser rounds, of which it makes a hundred at most.
    low = F.regexp_replace(F.lower(text), rf"\b(?=[efhmnostz])({L.NUMBER_PHRASE})\s*milliseconds\b", "$1 ms")
    low = let(low, _digits_for_words)
    low = F.regexp_replace(low, r"(?<=[a-z])-(?=[a-z])", " ")
    low = F.regexp_replace(low, r"\b(were|was)\s+migrated\s+successfully\b", "$1 migrated")
    low = F.regexp_replace(low, r"\b(\d+(?:\.\d+)?)\s+percent\b", "$1%")
    return spaced(low, r"[a-z0-9$%@./:+-]+")


def _digits_for_words(low: Column) -> Column:
    """Replace every run of number words by its value.

    The text is cut at the runs and put together again, since a replacement cannot call a function.
    Texts without a number word skip the work.
    """
    phrase = rf"\b{L.NUMBER_PHRASE}\b"
    values = F.transform(find_all(low, phrase), lambda p: number_value(p).cast("string"))
    joined = F.zip_with(F.split(low, phrase), values, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    # The letters number words begin with: most words are told from their first one.
    return F.when(low.rlike(rf"\b(?=[efhmnostz]){L.NUMBER_PHRASE}\b"), F.array_join(joined, "")).otherwise(low)


def render_list(items: Column, word: str = "and") -> Column:
    """`a`, `a and b`, `a, b, and c`."""

    def render(xs: Column) -> Column:
        size = F.size(xs)
        head = F.array_join(F.slice(xs, 1, F.greatest(size - 1, F.lit(1))), ", ")
        return (
            F.when(size <= 1, F.array_join(xs, ""))
            .when(size == 2, F.array_join(xs, f" {word} "))
            .otherwise(F.concat(head, F.lit(f", {word} "), F.try_element_at(xs, F.lit(-1))))
        )

    return let(items, render)


def any_word(words) -> str:
    """Pattern for any of `words` as a whole word."""
    ordered = sorted(words, key=len, reverse=True)
    return r"\b(?:" + "|".join(w.replace(".", r"\.") for w in ordered) + r")\b"


def first_match(cases, default=None) -> Column:
    """First condition that holds decides; `cases` are (condition, value) pairs."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def present(cases) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(label)) for condition, label in cases]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets given as arrays without repeats."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def word_runs(words: Column, n: int) -> Column:
    """Distinct runs of `n` words; fewer words are one run, none give none.

    Words are taken by their place: a slice copies the whole array, which is square in the length of a text.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    runs = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))
