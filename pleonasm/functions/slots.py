"""Sentences of the form "<type> <id> [object] was <state>" and their list forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions import arrays as A
from pleonasm.functions import signals, text as T
from pleonasm.functions.numbers import plain_number

SLOT_TYPE = (
    "struct<entity_type:string,entity_id:string,owned_object:string,predicate:string,state:string,"
    "polarity:string,role:string,count:string,complaint_kind:string>"
)
_COUNT = rf"({L.PLACEHOLDER}|\d+|{L.NUMBER_PHRASE})"
_COMPLAINT = rf"(?i)^([A-Z][A-Za-z ]{{1,40}})\s+logged\s+{_COUNT}\s+([A-Za-z0-9][A-Za-z0-9 -]{{1,80}}?)\s+complaints[.]?$"
_COMPLAINTS = r"(?i)^([A-Z][A-Za-z ]{1,40})\s+logged\s+(.+?)\s+complaints[.]?$"
_COMPLAINT_ITEM = rf"(?i)^{_COUNT}\s+(.+?)(?:\s+complaints)?$"
_SINGLE = rf"(?i)^(.+?)\s+({L.SLOT_PREDICATE})[.]?$"
_LISTED = rf"(?i)^([A-Z][A-Za-z0-9&/ -]{{1,60}}?)\s+(.+?)\s+were ({'|'.join(L.SLOT_STATES)})[.]?$"
_PRONOUNS = ("it", "this", "that", "they", "these", "those")
# Fixed irregular forms.
_SINGULAR = {"policies": "policy", "companies": "company", "hashes": "hash", "classes": "class"}


def singular(word: Column) -> Column:
    low = F.lower(word)
    return T.first_match(
        [(low == plural, one) for plural, one in _SINGULAR.items()]
        + [
            (low.rlike(r".{2}ies$"), F.regexp_replace(word, r"(?i)ies$", "y")),
            (low.rlike(r".[sxz]es$"), F.regexp_replace(word, r"(?i)es$", "")),
            (low.rlike(r".*[^s]s$"), F.regexp_replace(word, r"(?i)s$", "")),
        ],
        word,
    )


def plural(word: Column) -> Column:
    low = F.lower(word)
    return T.first_match(
        [(low == one, many.capitalize()) for many, one in _SINGULAR.items()]
        + [
            (word.rlike(r"[^aeiouAEIOU]y$"), F.regexp_replace(word, "y$", "ies")),
            (word.rlike(r"[sxz]$"), F.concat(word, F.lit("es"))),
        ],
        F.concat(word, F.lit("s")),
    )


def _looks_like_id(word: Column) -> Column:
    return word.rlike(r"[A-Z0-9/]") & (word.rlike(r"[-_/0-9]") | ((F.upper(word) == word) & word.rlike(r"[A-Z]")))


def _slot(entity_type, entity_id, owned, predicate, state, role, count=None, kind=None) -> Column:
    empty = F.lit("")
    return F.struct(
        entity_type.alias("entity_type"),
        entity_id.alias("entity_id"),
        owned.alias("owned_object"),
        predicate.alias("predicate"),
        state.alias("state"),
        F.lit("positive").alias("polarity"),
        role.alias("role"),
        (empty if count is None else count).alias("count"),
        (empty if kind is None else kind).alias("complaint_kind"),
    )


@A.reusable
def slot(sentence: Column) -> Column:
    """The slot of a single sentence, or null."""
    return A.let(T.strip(sentence), _slot_of)


def _slot_of(raw: Column) -> Column:
    role = signals.sentence_role(raw)
    group = lambda pattern, i: F.regexp_extract(raw, pattern, i)

    kind = F.trim(group(_COMPLAINT, 3))
    logged = F.lit("logged")
    complaint = _slot(
        F.trim(group(_COMPLAINT, 1)), kind, F.lit("complaints"), logged, logged, role, plain_number(group(_COMPLAINT, 2)), kind
    )

    def from_head(words: Column) -> Column:
        n = F.size(words)
        last, before = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2))
        owned = (n >= 3) & _looks_like_id(before) & last.rlike(r"^[a-z][a-z0-9_-]{1,30}s?$")
        entity = F.btrim(F.when(owned, before).otherwise(last), F.lit(","))
        kept = F.slice(words, 1, F.greatest(n - F.when(owned, 2).otherwise(1), F.lit(0)))
        state = F.lower(F.regexp_extract(group(_SINGLE, 2), r"\S+$", 0))
        found = _slot(
            F.array_join(kept, " "), entity, F.when(owned, last).otherwise(F.lit("")), F.concat(F.lit("were "), state), state, role
        )
        return F.when((n >= 2) & (entity != "") & ~F.lower(entity).isin(list(_PRONOUNS)), found)

    head = F.split(F.trim(group(_SINGLE, 1)), r"\s+")
    blocked = raw.rlike(f"(?i){L.CONFLICT_RECORD}|{L.SLOT_BLOCKERS}")
    return F.when(raw.rlike(_COMPLAINT) & ~blocked, complaint).when(raw.rlike(_SINGLE) & ~blocked, A.let(head, from_head))


def _items(text: Column) -> Column:
    parts = F.transform(F.split(F.regexp_replace(text, r"\s+and\s+", ", "), ","), lambda p: F.btrim(p, F.lit(" ,")))
    return F.filter(parts, lambda p: p != "")


@A.reusable
def listed_slots(sentence: Column) -> Column:
    """The slots of a sentence that already is a list; empty when it is none."""
    return A.let(T.strip(sentence), _listed_slots_of)


def _listed_slots_of(raw: Column) -> Column:
    role = signals.sentence_role(raw)
    group = lambda pattern, i: F.regexp_extract(raw, pattern, i)
    logged, none = F.lit("logged"), F.array().cast(f"array<{SLOT_TYPE}>")

    def complaint(item: Column) -> Column:
        kind = F.trim(F.regexp_extract(item, _COMPLAINT_ITEM, 2))
        return _slot(
            F.trim(group(_COMPLAINTS, 1)), kind, F.lit("complaints"), logged, logged, role,
            plain_number(F.regexp_extract(item, _COMPLAINT_ITEM, 1)), kind,
        )

    complaints = _items(group(_COMPLAINTS, 2))
    complaint_list = F.when(
        F.forall(complaints, lambda i: i.rlike(_COMPLAINT_ITEM)), F.transform(complaints, complaint)
    ).otherwise(none)

    def entities(words: Column) -> Column:
        first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        widened = F.coalesce((F.lower(first) == first) & F.endswith(first, F.lit("s")) & _looks_like_id(second), F.lit(False))
        name = singular(F.trim(group(_LISTED, 1)))
        name = F.when(widened, singular(F.concat_ws(" ", name, first))).otherwise(name)
        body = F.array_join(F.when(widened, F.slice(words, 2, 1 << 30)).otherwise(words), " ")
        owned = F.when(F.endswith(body, F.lit(" data")), F.lit("data")).otherwise(F.lit(""))
        body = F.regexp_replace(body, r" data$", "")
        state = F.lower(group(_LISTED, 3))
        return F.transform(
            _items(body), lambda item: _slot(name, item, owned, F.concat(F.lit("were "), state), state, role)
        )

    listed = A.let(F.split(F.trim(group(_LISTED, 2)), r"\s+"), entities)
    return F.when(raw.rlike(_COMPLAINTS), complaint_list).when(raw.rlike(_LISTED), listed).otherwise(none)


def canonical_type(slot_: Column) -> Column:
    return singular(T.normal_text(slot_["entity_type"]))


def frame_key(slot_: Column) -> Column:
    """What two slots must share to stand in one list."""
    return F.concat_ws(
        "|", canonical_type(slot_), T.normal_text(slot_["owned_object"]), slot_["predicate"], slot_["state"],
        slot_["polarity"], slot_["role"],
    )


def signature(slot_: Column) -> Column:
    """The statement a slot makes, in one string."""
    logged = F.concat_ws(
        "::", F.lit("logged"), T.normal_text(slot_["entity_type"]), T.normal_text(slot_["count"]),
        T.normal_text(slot_["complaint_kind"]), slot_["role"],
    )
    other = F.concat_ws(
        "::", F.lit("slot"), canonical_type(slot_), T.normal_text(slot_["entity_id"]), T.normal_text(slot_["owned_object"]),
        slot_["predicate"], slot_["state"], slot_["polarity"], slot_["role"],
    )
    return F.when(slot_["predicate"] == "logged", logged).otherwise(other)


def slot_subject(slot_: Column) -> Column:
    parts = F.array(slot_["entity_type"], slot_["entity_id"], slot_["owned_object"])
    return signals.event_subject(F.array_join(F.filter(parts, lambda p: p != ""), " "))
