"""Column expressions that tag a sentence or a prompt: facts, states, risk, roles, themes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions import text as T
from pleonasm.functions.arrays import let, literal_map, reusable
from pleonasm.functions.numbers import light_fact_key, number_value


@reusable
def light_facts(text: Column) -> Column:
    """Distinct fact strings of all light patterns; bare number words do not count."""
    found = F.flatten(T.find_all_of(text, L.LIGHT_FACT_PATTERNS, L.LIGHT_FACT_NEEDS))
    trimmed = F.transform(found, lambda v: F.regexp_replace(v, r"^[.,;:!?]+|[.,;:!?]+$", ""))
    # A number in words is letters, blanks and hyphens only.
    return F.filter(F.array_distinct(trimmed), lambda v: v.rlike(r"[^A-Za-z\s-]") | number_value(v).isNull())


@reusable
def light_fact_keys(text: Column) -> Column:
    """Sorted canonical keys of the light facts."""
    return F.sort_array(F.array_distinct(F.transform(light_facts(text), light_fact_key)))


def identity_keys(fact_keys: Column) -> Column:
    """The raw keys that name an entity."""
    return F.filter(
        fact_keys,
        lambda k: F.startswith(k, F.lit("raw:")) & F.substring(k, 5, 1 << 30).rlike(r"[@_\-/]|\b[A-Z]{2,}\b|\d"),
    )


@reusable
def state_signatures(text: Column) -> Column:
    """Sorted state words, `not_` when the text negates them."""
    joined = "|".join(L.STATE_WORDS)

    def found(low: Column) -> Column:
        hits = F.array_distinct(T.find_all(low, rf"\b(?:not\s+)?(?:{joined})\b"))
        named = F.transform(hits, lambda h: F.regexp_replace(F.replace(h, F.lit("-"), F.lit("_")), r"^not\s+", "not_"))
        states = let(named, lambda names: F.filter(names, lambda s: ~F.array_contains(names, F.concat(F.lit("not_"), s))))
        negated = [
            F.when(low.rlike(rf"\bnot\s+{w}\b|\bno\b[^.!?;:]{{0,80}}\b{w}\b"), F.lit(f"not_{w}"))
            for w in ("deleted", "offline", *L.NEGATABLE_WORDS)
        ]
        extra = F.when(low.rlike(r"\bnot?\b"), F.array_compact(F.array(*negated))).otherwise(F.array().cast("array<string>"))
        return F.sort_array(F.array_union(states, extra))

    return let(F.lower(text), found)


@reusable
def risk_markers(text: Column) -> Column:
    """Sorted risk and negation markers."""

    def found(low: Column) -> Column:
        words = F.array_distinct(T.find_all(low, T.any_word(L.RISK_WORDS)))
        phrases = T.present([(low.rlike(rf"(?<![a-z0-9]){p}(?![a-z0-9])"), p) for p in L.RISK_PHRASES])
        return F.sort_array(F.array_union(words, phrases))

    return let(F.lower(text), found)


def surface_issues(text: Column) -> Column:
    """Visible damage a rewrite can leave behind."""
    return T.present(
        [
            (text.rlike(r"(?i)\bnot\s+[A-Za-z0-9_-]+\s+or\s+[A-Za-z0-9_-]+\b"), "ambiguous_not_or"),
            (text.rlike(r"\s+[,.!?;:]"), "broken_punctuation"),
            (F.contains(text, F.lit("PREFACE: PREFACE")), "duplicated_preface_label"),
        ]
    )


_PREDICATES = "|".join(L.FACT_PREDICATES)
NEGATED_FACT = rf"(?i)^(.+?)\s+(is|are|was|were)\s+not\s+({_PREDICATES})[.]?$"
NO_FACT = rf"(?i)^No\s+(.+?)\s+(is|are|was|were)\s+({_PREDICATES})[.]?$"
CLAIM_WARNING = rf"(?i)^Do not claim\s+(.+?)\s+(is|are|was|were)\s+({_PREDICATES})[.]?$"
STATUS = r"(?i)^(.+?)\s+(" + "|".join(L.STATUS_PREDICATES) + r")[.]?$"


def status_subject(sentence: Column) -> Column:
    """Subject of a status sentence, or null; orders that start with "Do not" are none."""
    ok = sentence.rlike(STATUS) & ~sentence.rlike(r"(?i)^Do not\b")
    return F.when(ok, F.trim(F.regexp_extract(sentence, STATUS, 1)))


@reusable
def sentence_role(sentence: Column) -> Column:
    """instruction_warning, factual_state or other."""
    return (
        F.when(sentence.rlike(r"(?i)^(?:Do not|Never)\b"), F.lit("instruction_warning"))
        .when(
            sentence.rlike(NEGATED_FACT) | sentence.rlike(NO_FACT) | status_subject(sentence).isNotNull(),
            F.lit("factual_state"),
        )
        .otherwise(F.lit("other"))
    )


@reusable
def date_role(sentence: Column) -> Column:
    """The sentence with its dates masked, for sentences that give a date a role; else null."""
    roles = r"\b(?:started|paused|deadline|expires?|expired|legal hold|release|filing)\b"
    skeleton = F.regexp_replace(sentence, L.PLACEHOLDER, "DATE")
    skeleton = F.regexp_replace(skeleton, r"(?i)\b(?:the|a|an)\b", "")
    return F.when(
        F.contains(sentence, F.lit("__PROTECTED_")) & F.lower(sentence).rlike(roles), T.normal_text(skeleton)
    )


def event_subject(subject: Column) -> Column:
    """Normal form of a subject; nine known kinds become `kind:name`."""
    def tagged(norm: Column) -> Column:
        cases = []
        for kind in L.SUBJECT_KINDS:
            name_after = F.substring(norm, len(kind) + 2, 1 << 30)
            name_before = F.regexp_replace(norm, f" {kind}$", "")
            cases.append((F.startswith(norm, F.lit(kind + " ")), F.concat(F.lit(kind + ":"), name_after)))
            cases.append((F.endswith(norm, F.lit(" " + kind)), F.concat(F.lit(kind + ":"), name_before)))
        return T.first_match(cases, norm)

    return let(T.normal_text(F.regexp_replace(T.strip(subject), r"(?i)^(?:the|a|an)\s+", "")), tagged)


def event_values(sentence: Column) -> Column:
    """Canonical dates, shares and durations in order of first mention."""
    found = T.find_all(sentence, f"(?i){L.EVENT_VALUE}")
    return F.array_distinct(F.transform(found, light_fact_key))


# --- polarity, modality, actions (the words in these patterns are fixed values) ------------------------------------------------------------------


def cluster_polarity(text: Column) -> Column:
    low = F.lower(text)
    words = r"\b(?:not|never|cannot|can't|must not|prohibited|denied|unreliable|harder|worse|slower)\b"
    return F.when(low.rlike(words), F.lit("negative")).otherwise(F.lit("positive"))


def cluster_modality(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\b(?:will|must|shall|definitely|certainly)\b"), F.lit("certain"))
        .when(low.rlike(r"\b(?:might|may|could|possible|possibly|potentially)\b"), F.lit("uncertain"))
        .otherwise(F.lit("neutral"))
    )


def family_modality(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\b(?:might|may|could|possible|possibly|uncertain|potentially)\b"), F.lit("uncertain"))
        .when(low.rlike(r"\b(?:will|must|shall|definitely|certainly)\b"), F.lit("certain"))
        .otherwise(F.lit("neutral"))
    )


def proposition_modality(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\b(?:must|shall|required|need to|needs to)\b"), F.lit("must"))
        .when(low.rlike(r"\bshould\b"), F.lit("should"))
        .when(low.rlike(r"\b(?:might|may|could|possible|possibly)\b"), F.lit("uncertain"))
        .when(low.rlike(r"\b(?:will|definitely|certainly)\b"), F.lit("certain"))
        .otherwise(F.lit("neutral"))
    )


def proposition_negated(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(?:no|not|never|cannot|can't|without|not acceptable|must not|should not)\b")


def family_negated(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"\bwithout\s+(?:much\s+)?difficulty\b", "easy")
    return low.rlike(r"\b(?:no|not|never|cannot|can't|won't|unable|without|should not|must not)\b")


def starts_with_contrast(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(?:however|but|although|though|nevertheless)\b")


def has_uncertainty(text: Column) -> Column:
    return text.rlike(r"(?i)\b(?:may|might|could|possibly|probably|generally|often|usually|sometimes)\b")


def action_tag(text: Column) -> Column:
    low = F.lower(text)
    return T.first_match(
        [
            (low.rlike(r"\b(?:verify|confirm|check|validate)\b"), "verify"),
            (low.rlike(r"\b(?:apologize|apology)\b"), "apology"),
            (low.rlike(r"\b(?:built|build|created|made)\b"), "build"),
            (low.rlike(r"\b(?:tested|test|validated)\b"), "test"),
        ],
        "generic",
    )


def intent_tag(text: Column) -> Column:
    asks = r"\b(?:what can i do|can i do|need help|help me|what should i)\b"
    return F.when(F.lower(text).rlike(asks), F.lit("user_intent")).otherwise(F.lit("none"))


def effect_tag(text: Column) -> Column:
    low = F.lower(text)
    return T.first_match(
        [
            (low.rlike(r"\b(?:hallucinations?|errors?|quality loss|reduce response quality|accuracy loss)\b"), "quality_risk"),
            (low.rlike(r"\b(?:costs?|expenses?|spending|token costs?)\b"), "cost"),
        ],
        "other",
    )


# --- fingerprints, entities, keywords ------------------------------------------------------------------


def without_header(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^\s*[A-Z][A-Za-z &/-]{1,50}:\s*", " ")


def _mapped(word: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(literal_map(table), word), word)


@reusable
def cluster_fingerprint(text: Column) -> Column:
    """Distinct content words, synonyms merged, endings cut."""
    words = T.find_all(F.lower(without_header(text)), r"[A-Za-z0-9'-]+")
    content = F.array_except(words, T.literal_array(L.CLUSTER_STOP))

    def stem(word: Column) -> Column:
        size = F.length(word)
        return T.first_match(
            [
                (F.endswith(word, F.lit("ing")) & (size > 5), F.regexp_replace(word, "ing$", "")),
                (F.endswith(word, F.lit("ed")) & (size > 4), F.regexp_replace(word, "ed$", "")),
                (F.endswith(word, F.lit("s")) & (size > 4), F.regexp_replace(word, "s$", "")),
            ],
            word,
        )

    content = F.transform(content, lambda raw: _mapped(raw, L.CLUSTER_SYNONYMS))
    return F.sort_array(F.array_distinct(F.transform(content, stem)))


def cluster_content(text: Column) -> Column:
    """Content words of a sentence without the names in it."""
    unnamed = F.aggregate(cluster_entities(text), F.lower(text), lambda left, name: F.replace(left, F.lower(name), F.lit(" ")))
    return let(unnamed, cluster_fingerprint)


@reusable
def family_fingerprint(text: Column) -> Column:
    """The second variant: letters only, a synonym is final, longer minimum lengths."""
    words = T.find_all(F.lower(without_header(text)), r"[A-Za-z][A-Za-z'-]+")
    content = F.array_except(words, T.literal_array(L.FAMILY_STOP))

    def lemma(word: Column) -> Column:
        size = F.length(word)
        return T.first_match(
            [
                (word.isin(list(L.FAMILY_SYNONYMS)), _mapped(word, L.FAMILY_SYNONYMS)),
                (F.endswith(word, F.lit("ing")) & (size > 6), F.regexp_replace(word, "ing$", "")),
                (F.endswith(word, F.lit("ed")) & (size > 5), F.regexp_replace(word, "ed$", "")),
                (F.endswith(word, F.lit("s")) & (size > 4), F.regexp_replace(word, "s$", "")),
            ],
            word,
        )

    return F.sort_array(F.array_distinct(F.transform(content, lemma)))


#: Where a word begins or ends. What Java takes `\b` for differs by its version and with combining marks.
_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_SPACE = r"[\s\x85\p{Z}]"


def named_entities(text: Column) -> Column:
    """Capitalised runs, and the name in "my name is X"."""
    runs = T.find_all(text, rf"{_EDGE}[A-Z][a-z]+(?:{_SPACE}+[A-Z][a-z]+)*{_EDGE}")
    names = F.regexp_extract_all(text, F.lit(rf"(?i){_EDGE}my name is{_SPACE}+([a-z][a-z'-]{{2,}}){_EDGE}"), F.lit(1))
    return F.sort_array(F.array_union(runs, names))


def cluster_entities(text: Column) -> Column:
    runs = T.find_all(without_header(text), rf"{_EDGE}[A-Z][A-Za-z0-9]*(?:{_SPACE}+[A-Z][A-Za-z0-9]*){{0,3}}{_EDGE}")
    kept = F.filter(runs, lambda v: ~v.isin(list(L.CLUSTER_ENTITY_STOP)))
    return F.sort_array(kept)


def family_entities(text: Column) -> Column:
    body = without_header(text)
    stop = list(L.FAMILY_ENTITY_STOP)
    acronyms = F.filter(T.find_all(body, r"\b[A-Z]{2,}(?:-[A-Z0-9]+)*\b"), lambda v: ~v.isin(stop))
    runs = F.filter(
        T.find_all(body, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"), lambda v: ~F.regexp_extract(v, r"^\S+", 0).isin(stop)
    )

    def norm(value: Column) -> Column:
        return F.trim(F.replace(F.regexp_replace(F.lower(value), r"\b(?:the|a|an)\b", ""), F.lit("-"), F.lit(" ")))

    return F.sort_array(F.array_distinct(F.transform(F.concat(acronyms, runs), norm)))


def keywords(text: Column) -> Column:
    found = T.find_all(F.lower(text), rf"{_EDGE}[a-z][a-z-]{{3,}}{_EDGE}")
    return F.sort_array(F.array_except(found, T.literal_array(L.KEYWORD_STOP)))
