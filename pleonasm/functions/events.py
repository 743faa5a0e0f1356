"""Event signatures: `event::subject::state[::value]` for what a sentence reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions import arrays as A
from pleonasm.functions import signals, slots, text as T

_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _event(*parts) -> Column:
    return F.concat_ws("::", F.lit("event"), *parts)


def _list_items(text: Column) -> Column:
    parts = F.transform(
        F.split(text, r",\s*|\s+and\s+|\s+or\s+"),
        lambda p: F.regexp_replace(F.btrim(p, F.lit(" .")), r"(?i)^(?:and|or)\s+", ""),
    )
    return F.filter(parts, lambda p: p != "")


def list_events(raw: Column) -> Column:
    """Events of sentences that list entities or name one of a fixed kind."""
    listed = F.filter(slots.listed_slots(raw), lambda s: s["predicate"] != "logged")
    rendered = F.when(
        raw.rlike(r"(?i),|\s+and\s+"), F.transform(listed, lambda s: _event(slots.slot_subject(s), s["state"]))
    ).otherwise(_empty())
    tail = F.btrim(F.substring_index(raw, ":", -1), F.lit(" ."))
    tables = r"(?i)^(.+?)\s+routing tables were migrated[.]?$"
    routing = F.when(
        raw.rlike(tables),
        F.struct(
            F.lit("routing_table").alias("kind"), F.lit("migrated").alias("event"),
            _list_items(F.regexp_extract(raw, tables, 1)).alias("items"),
        ),
    )
    # Patterns are literals, so each is compiled once; one alternation keeps most sentences out of them.
    forms = F.array_compact(
        F.array(
            *[
                F.when(
                    raw.rlike(f"(?i){p}"),
                    F.struct(F.lit(kind).alias("kind"), F.lit(event).alias("event"), F.array(F.regexp_extract(raw, f"(?i){p}", 1)).alias("items")),
                )
                for p, kind, event in L.ENTITY_EVENT_FORMS
            ]
        )
    )
    any_form = "(?i)^(?:" + "|".join(p.removeprefix("^") for p, _, _ in L.ENTITY_EVENT_FORMS) + ")"
    none = F.array().cast("array<struct<kind:string,event:string,items:array<string>>>")
    form = F.when(raw.rlike(any_form), forms).otherwise(none)
    prefixes = A.literal_structs(("prefix", "event", "kind"), [(p + ":", event, kind) for p, (event, kind) in L.LIST_EVENT_PREFIXES.items()])
    prefixed = F.transform(
        F.filter(prefixes, lambda p: F.startswith(raw, p["prefix"])),
        lambda p: F.struct(p["kind"].alias("kind"), p["event"].alias("event"), _list_items(tail).alias("items")),
    )
    findings = F.concat(prefixed, F.array_compact(F.array(routing)), form)
    named = F.transform(
        findings,
        lambda f: F.transform(f["items"], lambda i: _event(F.concat(f["kind"], F.lit(":"), T.normal_text(i)), f["event"])),
    )
    return F.array_distinct(F.concat(rendered, F.flatten(named)))


# What is reported and where its subject ends. The first three carry every value of the sentence,
# the next four the change from the first value to the second.
_MEASURED = ("started", "reached", "paused")
_CHANGED = ("decreased", "increased", "dropped", "improved")
_FLAGGED = r"\s+(?:is|was)\s+(?:also\s+)?flagged\s+for\s+"
_VERBS = {
    "started": r"\b(?:started|began)\b",
    **{verb: rf"\b{verb}\b" for verb in _MEASURED[1:] + _CHANGED},
    "failed_validation": r"\b(?:failed validation|still fails validation)\b",
    "flagged_for": _FLAGGED,
}


def _verb_events(raw: Column, low: Column) -> Column:
    """Events of the verbs in a sentence; what stands before a verb is its subject."""
    place = lambda pattern: F.regexp_instr(raw, F.lit(f"(?i){pattern}"))
    spots = F.array(*[F.struct(F.lit(verb).alias("verb"), place(pattern).alias("at")) for verb, pattern in _VERBS.items()])
    found = F.filter(spots, lambda v: (v["at"] > 0) & ~((v["verb"] == "flagged_for") & F.contains(low, F.lit("not flagged"))))
    flag = T.normal_text(F.regexp_extract(raw, rf"(?i){_FLAGGED}([^.]+)", 1))

    def of_verb(v: Column, values: Column) -> Column:
        head = F.substring(raw, F.lit(1), v["at"] - 1)

        def build(subject: Column) -> Column:
            change = F.concat_ws("->", F.get(values, F.lit(0)), F.get(values, F.lit(1)))
            details = (
                F.when(v["verb"].isin(list(_MEASURED)), values)
                .when(v["verb"].isin(list(_CHANGED)), F.when(F.size(values) >= 2, F.array(change)).otherwise(_empty()))
                .when(v["verb"] == "flagged_for", F.filter(F.array(flag), lambda x: x != ""))
            )
            with_detail = F.transform(details, lambda d: _event(subject, v["verb"], d))
            return F.when(subject == "", _empty()).otherwise(F.coalesce(with_detail, F.array(_event(subject, v["verb"]))))

        return A.let(signals.event_subject(F.btrim(head, F.lit(" ,.;:"))), build)

    all_values = lambda values: F.flatten(F.transform(found, lambda v: of_verb(v, values)))
    # What is in every match of a verb.
    hints = ("started", "began", *_MEASURED[1:], *_CHANGED, "fail", "flagged")
    return F.when(T.holds(raw, low, hints), A.let(signals.event_values(raw), all_values)).otherwise(_empty())


def _excluded_pool(raw: Column) -> Column:
    """`excluded` for a note pool kept out of a migration, else null."""
    pool = T.strip(F.regexp_extract(raw, r"(?is)^(.*?)excluded from migration", 1))
    pool = F.regexp_replace(F.regexp_replace(pool, r"(?i)^the\s+", ""), r"(?i)\s+(?:is|are|was|were)$", "")
    name = T.normal_text(F.regexp_replace(pool, r"(?i)\s+note pool$", ""))
    return A.let(name, lambda n: F.when(n != "", _event(F.concat(F.lit("note_pool:"), n), F.lit("excluded"))))


def _events_of(raw: Column) -> Column:
    def build(listed: Column, low: Column) -> Column:
        from_slot = lambda s: F.when(s["predicate"] != "logged", _event(slots.slot_subject(s), s["state"]))
        single = F.when(F.size(listed) == 0, A.let(slots.slot(raw), from_slot))
        pool = F.when(F.contains(low, F.lit("excluded from migration")), _excluded_pool(raw))
        statuses = F.when(F.size(listed) == 0, _status_events(raw, low)).otherwise(_empty())
        return F.concat(listed, F.array_compact(F.array(single, pool)), _verb_events(raw, low), statuses)

    # A sentence without any of these words reports nothing; most prose stops here.
    hint = (
        r"(?i)\b(?:is|was|were|exists|fails|failed|started|began|reached|paused|decreased|increased|dropped|improved"
        r"|excluded)\b|^Approved\b|^(?:" + "|".join(L.LIST_EVENT_PREFIXES) + "):"
    )
    usable = raw.rlike(hint) & ~F.startswith(F.lower(raw), F.lit("do not claim "))
    both = F.struct(list_events(raw).alias("listed"), F.lower(raw).alias("low"))
    return F.when(usable, A.let(both, lambda b: build(b["listed"], b["low"]))).otherwise(_empty())


def _sentence_events(sentence: Column) -> Column:
    return A.let(F.btrim(T.strip(sentence), F.lit(".")), _events_of)


def _status_events(raw: Column, low: Column) -> Column:
    """All status phrases of a sentence; the subject ends where the first one starts."""
    known = F.filter(A.literal_structs(("phrase", "event"), L.EVENT_PHRASES.items()), lambda p: F.contains(low, p["phrase"]))
    spots = F.transform(known, lambda p: F.struct(F.instr(low, p["phrase"]).alias("at"), p["event"].alias("event")))

    def build(hits: Column) -> Column:
        first = F.array_min(F.transform(hits, lambda h: h["at"]))
        head = F.btrim(F.substring(raw, F.lit(1), first - 1), F.lit(" ,.;:"))
        named = lambda s: F.when(s != "", F.transform(hits, lambda h: _event(s, h["event"]))).otherwise(_empty())
        return F.when(F.size(hits) > 0, A.let(signals.event_subject(head), named)).otherwise(_empty())

    # Every phrase begins with one of these pairs of words; most sentences hold none.
    pairs = "|".join(sorted({" ".join(phrase.split(" ")[:2]) for phrase in L.EVENT_PHRASES}))
    return F.when(low.rlike(pairs) & low.rlike(r"\b(?:is|was|were|exists)\b"), A.let(spots, build)).otherwise(_empty())


@A.reusable
def event_signatures(text: Column) -> Column:
    """Sorted distinct event signatures of all sentences of a text."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(T.sentences(text), _sentence_events))))
