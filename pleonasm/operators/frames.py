"""Sentences of one text that share a frame become one sentence; what must stay apart stays apart.

Input and output of every pass are sentence rows: scope columns, `pos`, `sentence`. The scope is one
section of one prompt, so a group is never larger than one text. All passes use windows whose keys
start with the scope: rows that are hash-partitioned by the prompt once stay where they are through
the whole chain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions import arrays as A
from pleonasm.functions import signals, slots, text as T
from pleonasm.functions.events import event_signatures
from pleonasm.session import cut_lineage

def _sentence() -> Column:
    return F.col("sentence")


# --- the safety signature of a sentence --------------------------------------------------------------


@A.reusable
def signature(sentence: Column) -> Column:
    """Everything that a removal must not lose."""
    return F.struct(
        signals.sentence_role(sentence).alias("role"),
        signals.date_role(sentence).alias("date_role"),
        signals.light_fact_keys(sentence).alias("facts"),
        signals.state_signatures(sentence).alias("states"),
        event_signatures(sentence).alias("events"),
        signals.risk_markers(sentence).alias("risks"),
    )


def covers(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def removal_reasons(removed: Column, kept: Column) -> Column:
    """Why the first signature may not go in favour of the second; empty when it may."""
    removed_ids = signals.identity_keys(removed["facts"])
    return T.present(
        [
            ((removed["role"] == "factual_state") & (kept["role"] == "instruction_warning"), "fact for warning"),
            ((kept["role"] == "instruction_warning") & (removed["role"] != "instruction_warning"), "no warning for warning"),
            (F.coalesce(removed["date_role"] != kept["date_role"], F.lit(False)), "date role"),
            (~covers(removed["facts"], kept["facts"]), "facts"),
            (~covers(removed["states"], kept["states"]), "states"),
            (~covers(removed["events"], kept["events"]), "events"),
            (~covers(removed["risks"], kept["risks"]), "risks"),
            ((F.size(removed_ids) > 0) & (removed_ids != signals.identity_keys(kept["facts"])), "identity"),
        ]
    )


def can_remove(removed: Column, kept: Column) -> Column:
    """True when nothing of `removed` would be lost next to `kept`. Both are sentences."""
    pair = F.struct(signature(removed).alias("r"), signature(kept).alias("k"))
    return A.let(pair, lambda p: F.size(removal_reasons(p["r"], p["k"])) == 0)


# --- folding --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    """One kind of frame: which group a sentence belongs to, what it contributes, how a group is written."""

    name: str
    key: Column
    item: Column
    # (ordered entries, ordered distinct items, blocking sentences) -> sentence or null
    render: Callable[[Column, Column, Column], Column]
    # tokens must fall; tokens or characters must fall; no limit
    gain: str = "tokens"
    at_end: bool = False
    keeps_signatures: bool = False
    blocking: bool = False
    # (ordered items, merged sentence) -> may stand; evaluated outside the rendering
    check: Callable[[Column, Column], Column] | None = None


def with_groups(rows: DataFrame, scope: list[str], fold: Fold) -> DataFrame:
    """Adds the group of each sentence: `group_first`, `group_size` and, on the first row, `merged`."""
    staged = rows.withColumn("_in", fold.key).withColumn("_item", F.when(F.col("_in").isNotNull(), fold.item))
    staged = staged.withColumn("_key", F.coalesce("_in", F.concat(F.lit("\u0000"), F.col("pos").cast("string"))))
    group = Window.partitionBy(*scope, "_key")
    entry = F.struct("pos", F.col("_item").alias("item"), "sentence")
    staged = staged.withColumn("group_first", F.min("pos").over(group)).withColumn("group_size", F.count("*").over(group))
    members = F.collect_list(F.when(F.col("_in").isNotNull(), entry)).over(group)
    staged = staged.withColumn("_all", F.sort_array(members))
    if fold.blocking:
        blocks = F.when(blocks_items(_sentence()), F.struct("pos", T.normal_text(_sentence()).alias("text")))
        staged = staged.withColumn("_blocks", F.collect_list(blocks).over(Window.partitionBy(*scope)))
    else:
        staged = staged.withColumn("_blocks", F.lit(None))
    first = (F.col("pos") == F.col("group_first")) & F.col("_in").isNotNull()

    def write(entries: Column) -> Column:
        items = F.array_distinct(F.transform(entries, lambda e: e["item"]))
        return A.let(fold.render(entries, items, F.col("_blocks")), lambda new: F.when(_gains(fold, entries, new), new))

    staged = staged.withColumn("merged", F.when(first, A.let(F.col("_all"), write)))
    if fold.check is not None:
        staged = staged.withColumn("merged", F.when(fold.check(F.col("_all.item"), F.col("merged")), F.col("merged")))
    staged = staged.drop("_all", "_item", "_blocks")
    staged = _guarded(staged, group, fold)
    # The first row decides for its whole group.
    return staged.withColumn("_ok", F.max(F.col("merged").isNotNull()).over(group)).drop("_in", "_key")


def _gains(fold: Fold, entries: Column, new: Column) -> Column:
    sentences = F.transform(entries, lambda e: e["sentence"])
    total = lambda size: F.aggregate(F.transform(sentences, size), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    fewer = T.count_tokens(new) < total(T.count_tokens)
    checks = new.isNotNull()
    if fold.gain == "tokens":
        checks &= fewer
    elif fold.gain == "tokens or characters":
        checks &= fewer | (F.length(new) < total(F.length))
    return checks


_GUARDED = ("facts", "states", "events", "risks")


def _guarded(staged: DataFrame, group, fold: Fold) -> DataFrame:
    """Drops a merged sentence that lost a fact, state, event or risk of its group."""
    if not fold.keeps_signatures:
        return staged
    signed = with_signature(staged)
    entry = F.when(F.col("_in").isNotNull(), F.col("_sig"))
    signed = signed.withColumn("_sigs", F.when(F.col("merged").isNotNull(), F.collect_list(entry).over(group))).withColumn("_new", signature(F.col("merged")))
    kept = F.lit(True)
    for name in _GUARDED:
        said = F.array_distinct(F.flatten(F.transform("_sigs", lambda s: s[name])))
        kept &= covers(said, F.col("_new")[name])
    return signed.withColumn("merged", F.when(kept, F.col("merged"))).withColumn(
        "_sig", F.when(F.col("merged").isNotNull(), F.col("_new")).otherwise(F.col("_sig"))
    ).drop("_sigs", "_new")


def with_signature(rows: DataFrame) -> DataFrame:
    """Adds `_sig`, or fills it where an earlier pass changed the sentence and left it empty."""
    fresh = signature(_sentence())
    if "_sig" not in rows.columns:
        return rows.withColumn("_sig", fresh)
    return rows.withColumn("_sig", F.when(F.col("_sig").isNull(), fresh).otherwise(F.col("_sig")))


def fold_report(rows: DataFrame, scope: list[str], fold: Fold) -> DataFrame:
    """One row per merged group."""
    return with_groups(rows, scope, fold).filter(F.col("merged").isNotNull()).select(
        *scope, F.col("pos").alias("first_pos"), F.col("group_size").alias("sentences"), "merged"
    )


def apply_fold(rows: DataFrame, scope: list[str], fold: Fold) -> DataFrame:
    """Sentence rows with each accepted group replaced by its one sentence."""
    grouped = with_groups(rows, scope, fold).filter(~F.col("_ok") | F.col("merged").isNotNull())
    end = F.max("pos").over(Window.partitionBy(*scope)) + 1
    pos = F.when(F.col("merged").isNotNull(), end).otherwise(F.col("pos")) if fold.at_end else F.col("pos")
    columns = {c: F.col(c) for c in rows.columns}
    columns["pos"], columns["sentence"] = pos, F.coalesce("merged", "sentence")
    if "_sig" in columns and not fold.keeps_signatures:
        columns["_sig"] = F.when(F.col("merged").isNull(), F.col("_sig"))
    return grouped.select(*[value.alias(name) for name, value in columns.items()])


def _group(pattern: str, i: int, text: Column | None = None) -> Column:
    return F.regexp_extract(_sentence() if text is None else text, f"(?i){pattern}", i)


def _matched(pattern: str, value: Column) -> Column:
    return F.when(_sentence().rlike(f"(?i){pattern}"), value)


def _first(entries: Column) -> Column:
    return F.get(entries, F.lit(0))


def _several(items: Column, sentence: Column, n: int = 2) -> Column:
    return F.when(F.size(items) >= n, sentence)


# --- the frames --------------------------------------------------------------------------------------------


def verify_fold() -> Fold:
    """"Agents must verify X" with X split at commas and "and"."""

    def render(entries: Column, items: Column, _: Column) -> Column:
        parts = F.flatten(F.transform(items, lambda i: F.split(F.regexp_replace(i, r"(?i)^the\s+", ""), r",\s*| and ")))
        cleaned = F.array_distinct(F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" ."))), lambda p: p != ""))
        return A.let(
            cleaned,
            lambda c: F.when(
                (F.size(entries) >= 2) | (F.size(c) >= 2), F.concat(F.lit("Agents must verify "), T.render_list(c), F.lit("."))
            ),
        )

    return Fold("verify", _matched(L.VERIFY_FRAME, F.lit("verify")), F.trim(_group(L.VERIFY_FRAME, 1)), render, gain="none", at_end=True)


def do_not_claim_fold() -> Fold:
    """"Do not claim X <predicate>" by predicate."""

    def render(entries: Column, items: Column, _: Column) -> Column:
        predicate = F.lower(_group(L.DO_NOT_CLAIM_FRAME, 2, _first(entries)["sentence"]))
        many = F.regexp_replace(F.regexp_replace(predicate, "^is ", "are "), "^was ", "were ")
        return _several(items, F.concat(F.lit("Do not claim "), T.render_list(items), F.lit(" "), many, F.lit(".")))

    return Fold(
        "do_not_claim", _matched(L.DO_NOT_CLAIM_FRAME, F.lower(_group(L.DO_NOT_CLAIM_FRAME, 2))),
        F.trim(_group(L.DO_NOT_CLAIM_FRAME, 1)), render,
    )


def status_fold() -> Fold:
    """Several statuses of one subject, unless two of them contradict."""
    subject = signals.status_subject(_sentence())

    def render(entries: Column, items: Column, _: Column) -> Column:
        clash = F.lit(False)
        for a, b in L.STATUS_CONFLICTS:
            clash |= F.array_contains(items, a) & F.array_contains(items, b)
        name = F.trim(F.regexp_extract(_first(entries)["sentence"], signals.STATUS, 1))
        return F.when(~clash, _several(items, F.concat(name, F.lit(" "), T.render_list(items), F.lit("."))))

    return Fold("status", T.normal_text(subject), F.lower(F.regexp_extract(_sentence(), signals.STATUS, 2)), render)


_NO = r"^No\s+(.+?)\s+(were|was|are|is)\s+([A-Za-z-]+)[.]?$"
_NOT = r"^(.+?)\s+(were|was|are|is)\s+not\s+([A-Za-z-]+)[.]?$"


def negative_parts() -> Column:
    """(subject, auxiliary, state, mode) of "No X were S" and "X were not S", else null."""
    part = lambda pattern, mode: F.struct(
        F.trim(_group(pattern, 1)).alias("subject"), F.lower(_group(pattern, 2)).alias("aux"),
        F.lower(_group(pattern, 3)).alias("state"), F.lit(mode).alias("mode"),
    )
    return F.when(_sentence().rlike(f"(?i){_NO}"), part(_NO, "no")).when(_sentence().rlike(f"(?i){_NOT}"), part(_NOT, "not"))


def negative_fold() -> Fold:
    """Negative sentences about one subject become one list of states."""
    parts = negative_parts()

    def render(entries: Column, items: Column, _: Column) -> Column:
        states = F.array_distinct(F.transform(items, lambda i: i["state"]))
        modes = F.array_distinct(F.transform(items, lambda i: i["mode"]))
        first = _first(entries)["item"]
        body = F.concat_ws(" ", first["subject"], first["aux"], F.lit("not "))
        only_not = F.concat(body, F.call_function("array_join", states, F.concat(F.lit(" and "), first["aux"], F.lit(" not "))), F.lit("."))
        listed = F.concat(F.lit("No "), first["subject"], F.lit(" "), first["aux"], F.lit(" "), T.render_list(states, "or"), F.lit("."))
        enough = (F.size(entries) >= 2) & ((F.size(states) >= 2) | (F.size(modes) == 2))
        return F.when(enough, F.when(modes == F.array(F.lit("not")), only_not).otherwise(listed))

    return Fold("negative", F.lower(parts["subject"]), parts, render)


def frame_of(sentence: Column) -> Column:
    """(frame, item, mode) of the first of 16 fixed frames, or null."""
    cases = [
        (
            sentence.rlike(f"(?i){p}"),
            F.struct(F.lit(frame).alias("frame"), F.btrim(_group(p, 1, sentence), F.lit(" .")).alias("item"), F.lit(mode).alias("mode")),
        )
        for p, frame, mode in L.ITEM_FRAMES
    ]
    return T.first_match(cases, F.lit(None))


def _mentioned(blocks: Column, entries: Column, items: Column) -> Column:
    """A blocking sentence outside the group names one of the items."""
    inside = F.transform(entries, lambda e: e["pos"])
    names = lambda b, item: F.rlike(b["text"], F.concat(F.lit(r"(?<!\w)\Q"), T.normal_text(item), F.lit(r"\E(?!\w)")))
    return F.exists(
        blocks, lambda b: ~F.array_contains(inside, b["pos"]) & F.exists(items, lambda i: (T.normal_text(i) != "") & names(b, i))
    )


def blocks_items(sentence: Column) -> Column:
    """The sentence says something about an entity that forbids to list it with others."""
    low = F.lower(sentence)
    order = sentence.rlike(r"(?i)^\s*(?:do not|never)\b")
    return (
        F.when(low.rlike(L.BLOCKING_ALIAS) | low.rlike(L.BLOCKING_MERGE), F.lit(True))
        .when(F.contains(low, F.lit("after draining")), F.lit(False))
        .when(order, low.rlike(L.BLOCKING_ORDER_STATES))
        .otherwise(low.rlike(L.BLOCKING_STATEMENT))
    )


def item_fold() -> Fold:
    """16 fixed frames, at least two items, nothing said against any of them elsewhere."""
    framed = frame_of(_sentence())

    def render(entries: Column, items: Column, blocks: Column) -> Column:
        first = A.let(_first(entries)["sentence"], frame_of)
        names = T.render_list(items)
        text = F.when(first["mode"] == "suffix", F.concat(names, F.lit(" "), first["frame"], F.lit("."))).otherwise(
            F.concat(first["frame"], F.lit(": "), names, F.lit("."))
        )
        return F.when(~_mentioned(blocks, entries, items), _several(items, text))

    return Fold("item", framed["frame"], framed["item"], render, keeps_signatures=True, blocking=True)


def with_slots(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Adds `_slot` (with its signature) and `_frame`, the key under which slots share a list.

    An entity that another sentence says something blocking about has no frame.
    """
    parsed = rows.withColumn("_parsed", slots.slot(_sentence()))
    blocked = with_blocked_items(parsed, scope, F.col("_parsed.entity_id"))
    free = F.col("_parsed").isNotNull() & ~F.coalesce("_blocked", F.lit(False))
    signed = F.struct(F.col("_parsed.*"), slots.signature(F.col("_parsed")).alias("signature"))
    return (
        blocked.withColumn("_slot", F.when(free, signed)).withColumn("_frame", F.when(free, slots.frame_key(F.col("_parsed")))).drop("_parsed", "_blocked")
    )


def slot_fold() -> Fold:
    """Slots with the same frame key, from the columns of `with_slots`."""

    def render(entries: Column, items: Column, _: Column) -> Column:
        def write(group: Column) -> Column:
            first = F.get(group, F.lit(0))
            complaints = F.transform(group, lambda s: F.concat_ws(" ", s["count"], s["complaint_kind"], F.lit("complaints")))
            logged = F.concat(first["entity_type"], F.lit(" logged "), T.render_list(complaints), F.lit("."))
            owned = F.when(first["owned_object"] != "", F.concat(F.lit(" "), first["owned_object"])).otherwise(F.lit(""))
            listed = F.concat(
                slots.plural(first["entity_type"]), F.lit(" "), T.render_list(F.transform(group, lambda s: s["entity_id"])), owned,
                F.lit(" "), first["predicate"], F.lit("."),
            )
            return F.when(F.size(group) >= 2, F.when(first["predicate"] == "logged", logged).otherwise(listed))

        return A.let(A.keep_first(items, lambda s: s["signature"]), write)

    def stated(items: Column, merged: Column) -> Column:
        return covers(F.array_distinct(items["signature"]), F.transform(slots.listed_slots(merged), slots.signature))

    return Fold("slot", F.col("_frame"), F.col("_slot"), render, gain="tokens or characters", keeps_signatures=True, check=stated)


def with_blocked_items(rows: DataFrame, scope: list[str], item: Column) -> DataFrame:
    """Adds `_blocked`: some other sentence of the scope says something that keeps the item out of a list."""
    blocks = F.when(blocks_items(_sentence()), F.struct("pos", T.normal_text(_sentence()).alias("text")))
    staged = rows.withColumn("_item", T.normal_text(item)).withColumn("_b", F.collect_list(blocks).over(Window.partitionBy(*scope)))
    pattern = F.concat(F.lit(r"(?<!\w)\Q"), F.col("_item"), F.lit(r"\E(?!\w)"))
    hit = F.exists("_b", lambda b: (b["pos"] != F.col("pos")) & F.rlike(b["text"], pattern))
    return staged.withColumn("_blocked", F.when(F.col("_item") != "", hit)).drop("_b", "_item")


# Fixed plural forms.
_PLURAL_NOUNS = {"discrepancy": "discrepancies", "inconsistency": "inconsistencies"}


def warning_fold() -> Fold:
    """Three or more "do not merge this conflict" in a text that does hold conflicts."""
    key = F.concat_ws("|", T.normal_text(_group(L.CONFLICT_WARNING, 1)), F.lower(_group(L.CONFLICT_WARNING, 3)), T.normal_text(_group(L.CONFLICT_WARNING, 4)))

    def render(entries: Column, items: Column, _: Column) -> Column:
        part = lambda i: _group(L.CONFLICT_WARNING, i, _first(entries)["sentence"])
        noun = F.lower(part(3))
        many = T.first_match([(noun == one, many) for one, many in _PLURAL_NOUNS.items()], F.concat(noun, F.lit("s")))
        text = F.concat(part(1), F.lit("these "), many, part(4), part(5))
        return F.when((F.size(entries) >= 3) & (F.col("_conflicts") >= 2), text)

    return Fold("conflict_warning", _matched(L.CONFLICT_WARNING, key), _sentence(), render, gain="none")


def with_conflict_count(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Adds `_conflicts`: sentences of the scope that report a disagreement and are no warning."""
    found = _sentence().rlike(f"(?i){L.CONFLICT_SCOPE}") & ~_sentence().rlike(f"(?i){L.CONFLICT_WARNING}")
    return rows.withColumn("_conflicts", F.count_if(found).over(Window.partitionBy(*scope)))


# --- removals by a kept partner --------------------------------------------------------------------------------


def _partnered(rows: DataFrame, scope: list[str], key: Column, removable: Column, keeper: Column) -> DataFrame:
    """Adds `kept`: the first keeper sentence with the key of a removable one, if nothing would be lost."""
    signed = rows if "_sig" in rows.columns else with_signature(rows)
    staged = signed.withColumn("_key", F.coalesce(key, F.concat(F.lit("\u0000"), F.col("pos").cast("string"))))
    staged = staged.withColumn("_r", removable)
    partner = F.min_by(F.struct("sentence", "_sig"), F.when(keeper, F.col("pos"))).over(Window.partitionBy(*scope, "_key"))
    staged = staged.withColumn("_p", F.when(F.col("_r"), partner))
    safe = F.size(removal_reasons(F.col("_sig"), F.col("_p._sig"))) == 0
    kept = F.when(F.col("_p.sentence").isNotNull() & safe, F.col("_p.sentence"))
    return staged.withColumn("kept", kept).drop("_key", "_r", "_p", *([] if "_sig" in rows.columns else ["_sig"]))


def formula_notes(rows: DataFrame, scope: list[str]) -> DataFrame:
    """`kept` is set on formula notes that a preserve instruction makes superfluous."""
    appears, preserve = _sentence().rlike(f"(?i){L.FORMULA_APPEARS}"), _sentence().rlike(f"(?i){L.FORMULA_PRESERVE}")
    name = F.when(appears, _group(L.FORMULA_APPEARS, 1)).when(preserve, _group(L.FORMULA_PRESERVE, 1))
    return _partnered(rows, scope, T.normal_text(name), appears, preserve & ~appears)


def because_clauses(rows: DataFrame, scope: list[str]) -> DataFrame:
    """`kept` is set on short sentences that a longer "... because ..." repeats."""
    norm = F.regexp_replace(T.normal_text(_sentence()), r"\.+$", "")
    reason = F.contains(norm, F.lit(" because"))
    short = ~reason & (T.word_count(norm) >= 3)
    return _partnered(rows, scope, F.substring_index(norm, " because", 1), short, reason)


def drop_partnered(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("kept").isNull()).drop("kept")


def keep_first(rows: DataFrame, scope: list[str]) -> DataFrame:
    """First copy of each sentence by normal form."""
    keyed = rows.withColumn("_key", T.normal_text(_sentence()))
    first = F.min("pos").over(Window.partitionBy(*scope, "_key"))
    return keyed.withColumn("_f", first).filter(F.col("_f") == F.col("pos")).drop("_key", "_f")


def listed_already(rows: DataFrame, scope: list[str]) -> DataFrame:
    """`covered` is set on single slot sentences that a list of the same scope already states."""
    listed = slots.listed_slots(_sentence())
    staged = rows.withColumn("_l", listed).withColumn("_s", slots.slot(_sentence()))
    stated = F.when(F.size("_l") >= 2, F.transform("_l", slots.signature))
    lists = F.array_distinct(F.flatten(F.collect_list(stated).over(Window.partitionBy(*scope))))
    single = F.col("_s").isNotNull() & (F.size("_l") < 2)
    return staged.withColumn("covered", F.when(single, F.array_contains(lists, slots.signature(F.col("_s")))).otherwise(F.lit(False))).drop("_l", "_s")


# --- facts and their warnings -------------------------------------------------------------------------------------


def entity_key(subject: Column, sentence: Column) -> Column:
    ids = signals.identity_keys(signals.light_fact_keys(sentence))
    return A.let(ids, lambda k: F.when(F.size(k) > 0, F.array_join(k, "|")).otherwise(signals.event_subject(subject)))


def negated_facts(rows: DataFrame) -> DataFrame:
    """Fusable "X was not deleted" rows: predicate, subject, entity key."""
    fact = F.when(_sentence().rlike(signals.NEGATED_FACT), F.lit(signals.NEGATED_FACT)).when(_sentence().rlike(signals.NO_FACT), F.lit(signals.NO_FACT))
    part = lambda i: F.when(_sentence().rlike(signals.NEGATED_FACT), F.regexp_extract(_sentence(), signals.NEGATED_FACT, i)).otherwise(
        F.regexp_extract(_sentence(), signals.NO_FACT, i)
    )
    parsed = rows.filter(fact.isNotNull()).withColumn("subject", F.trim(part(1))).withColumn("aux", F.lower(part(2))).withColumn("predicate", F.lower(part(3)))
    states = T.any_word(L.UNFUSIBLE_STATES)
    return parsed.filter(
        F.col("predicate").isin(list(L.FUSABLE_PREDICATES)) & ~_sentence().rlike(f"(?i){L.CONFLICT_RECORD}") & ~F.lower(_sentence()).rlike(states)
    )


def claim_warnings(rows: DataFrame) -> DataFrame:
    """Fusable "Do not claim X was deleted" rows."""
    parsed = rows.filter(_sentence().rlike(signals.CLAIM_WARNING) & ~_sentence().rlike(f"(?i){L.CONFLICT_RECORD}"))
    named = parsed.withColumn("subject", F.trim(F.regexp_extract(_sentence(), signals.CLAIM_WARNING, 1))).withColumn(
        "predicate", F.lower(F.regexp_extract(_sentence(), signals.CLAIM_WARNING, 3))
    )
    return named.filter(F.col("predicate").isin(list(L.FUSABLE_PREDICATES)))


def fused_warnings(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Facts with the warning that belongs to them, and the one sentence that says both.

    A pair needs the same predicate and the same entity, which is an equi-join on (scope, predicate,
    entity). Where the entity keys differ, one subject may still contain the other: that join runs on
    the first word both share at a word border, so no pair is tried that shares nothing.
    """
    named = lambda df: (
        df.withColumn("entity", entity_key(F.col("subject"), _sentence())).withColumn("norm", T.normal_text(F.col("subject")))
    )
    facts = named(negated_facts(rows)).select(
        *scope, "predicate", "entity", F.col("pos").alias("fact_pos"), _sentence().alias("fact"), F.col("norm").alias("fact_norm"),
        (F.col("aux").isin("are", "were") | F.col("norm").rlike("[^s]s$")).alias("many"),
    )
    warns = named(claim_warnings(rows)).select(
        *scope, "predicate", "entity", F.col("pos").alias("warning_pos"), _sentence().alias("warning"), F.col("norm").alias("warning_norm")
    )
    # Read by three joins: entities and normal forms are made once.
    facts, warns = cut_lineage(facts), cut_lineage(warns)
    same = facts.join(warns, [*scope, "predicate", "entity"]).drop("entity", "fact_norm", "warning_norm")
    # Containment: the longest word of the shorter subject is a word of the longer one.
    words = lambda c: F.array_distinct(F.split(c, " "))
    longest = lambda c: F.element_at(F.sort_array(F.transform(F.split(c, " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    # At word borders, so that ORD-6 is not found inside ORD-64.
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    inside = (
        (F.contains(padded("fact_norm"), padded("warning_norm")) | F.contains(padded("warning_norm"), padded("fact_norm")))
        & (F.col("fact_norm") != "")
        & (F.col("warning_norm") != "")
    )
    short_fact = facts.withColumn("_w", longest(F.col("fact_norm"))).join(
        warns.withColumn("_w", F.explode(words(F.col("warning_norm")))).drop("entity"), [*scope, "predicate", "_w"]
    )
    short_warning = facts.withColumn("_w", F.explode(words(F.col("fact_norm")))).join(
        warns.withColumn("_w", longest(F.col("warning_norm"))).drop("entity"), [*scope, "predicate", "_w"]
    )
    columns = same.columns
    pairs = same.unionByName(short_fact.filter(inside).select(*columns)).unionByName(short_warning.filter(inside).select(*columns))
    # One warning per fact and one fact per warning: the first of each.
    one = pairs.groupBy(*scope, "fact_pos").agg(F.min_by(F.struct("warning_pos", "warning", "fact", "many"), "warning_pos").alias("_m"))
    one = one.groupBy(*scope, "_m.warning_pos").agg(F.min_by(F.struct("fact_pos", "_m.warning", "_m.fact", "_m.many"), "fact_pos").alias("_f"))
    one = one.select(*scope, F.col("_f.fact_pos").alias("fact_pos"), "warning_pos", F.col("_f.fact").alias("fact"), F.col("_f.warning").alias("warning"), F.col("_f.many").alias("many"))
    body = F.regexp_replace("fact", r"[.;]+$", "")
    predicate = F.lower(F.regexp_extract("warning", signals.CLAIM_WARNING, 3))
    fused = F.concat(body, F.when(F.col("many"), F.lit("; do not claim they were ")).otherwise(F.lit("; do not claim it was ")), predicate, F.lit("."))
    sized = one.withColumn("fused", fused).filter(
        T.count_tokens(F.col("fused")) <= T.count_tokens(F.col("fact")) + T.count_tokens(F.col("warning"))
    )
    return sized.select(*scope, "fact_pos", "warning_pos", "fused")


def fuse_warnings(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Sentence rows with each fact and its warning about the same entity in one sentence.

    The n-th fact of an entity takes its n-th warning. One window, no join, for use inside a chain.
    """
    s = _sentence()
    fact_form = rf"{signals.NEGATED_FACT}|{signals.NO_FACT}"
    warning = s.rlike(signals.CLAIM_WARNING) & ~s.rlike(f"(?i){L.CONFLICT_RECORD}")
    fact = s.rlike(fact_form) & ~warning & ~s.rlike(f"(?i){L.CONFLICT_RECORD}") & ~F.lower(s).rlike(T.any_word(L.UNFUSIBLE_STATES))
    part = lambda i: F.when(warning, F.regexp_extract(s, signals.CLAIM_WARNING, i)).when(
        s.rlike(signals.NEGATED_FACT), F.regexp_extract(s, signals.NEGATED_FACT, i)
    ).otherwise(F.regexp_extract(s, signals.NO_FACT, i))
    staged = rows.withColumn("_kind", F.when(warning, F.lit("w")).when(fact, F.lit("f"))).withColumn("_pred", F.when(F.col("_kind").isNotNull(), F.lower(part(3))))
    staged = staged.withColumn("_kind", F.when(F.col("_pred").isin(list(L.FUSABLE_PREDICATES)), F.col("_kind")))
    key = F.concat_ws("|", "_pred", entity_key(F.trim(part(1)), s))
    staged = staged.withColumn("_key", F.when(F.col("_kind").isNotNull(), key).otherwise(F.concat(F.lit("\u0000"), F.col("pos").cast("string"))))
    group, one_kind = Window.partitionBy(*scope, "_key"), Window.partitionBy(*scope, "_key", "_kind").orderBy("pos")
    staged = staged.withColumn("_n", F.row_number().over(one_kind))
    warnings = F.sort_array(F.collect_list(F.when(F.col("_kind") == "w", F.struct("pos", "sentence"))).over(group))
    staged = staged.withColumn("_w", F.when(F.col("_kind") == "f", F.get(warnings, F.col("_n") - 1)["sentence"]))
    many = F.lower(part(2)).isin("are", "were") | T.normal_text(F.trim(part(1))).rlike("[^s]s$")
    fused = F.concat(
        F.regexp_replace(s, r"[.;]+$", ""), F.when(many, F.lit("; do not claim they were ")).otherwise(F.lit("; do not claim it was ")),
        F.col("_pred"), F.lit("."),
    )
    fits = T.count_tokens(F.col("_new")) <= T.count_tokens(s) + T.count_tokens(F.col("_w"))
    staged = staged.withColumn("_new", F.when(F.col("_w").isNotNull(), fused)).withColumn("_new", F.when(fits, F.col("_new")))
    taken = F.collect_set(F.when(F.col("_new").isNotNull(), F.col("_n"))).over(group)
    staged = staged.withColumn("_gone", F.when(F.col("_kind") == "w", F.array_contains(taken, F.col("_n"))).otherwise(F.lit(False)))
    if "_sig" in rows.columns:
        staged = staged.withColumn("_sig", F.when(F.col("_new").isNull(), F.col("_sig")))
    return staged.filter(~F.col("_gone")).withColumn("sentence", F.coalesce("_new", "sentence")).select(*rows.columns)


def drop_fact_duplicates(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Sentence rows without those a shorter sentence with the same facts makes superfluous.

    Equal signatures leave one row each in a first window, so the second one holds few rows per fact set.
    """
    staged = with_signature(rows).withColumn("_facts", F.col("_sig.facts"))
    staged = staged.withColumn("_rank", F.struct(T.count_tokens(_sentence()).alias("tokens"), F.col("pos").alias("pos")))
    anchored = F.size("_facts") > 0
    own = F.when(anchored, F.lit(0)).otherwise(F.col("pos"))
    staged = staged.withColumn("_own", own)
    same = Window.partitionBy(*scope, "_own", "_facts", "_sig")
    staged = staged.withColumn("_best", F.min("_rank").over(same)).filter(F.col("_best") == F.col("_rank"))
    shelf = F.collect_list(F.struct(F.col("_rank").alias("rank"), F.col("_sig").alias("sig"))).over(Window.partitionBy(*scope, "_own", "_facts"))
    staged = staged.withColumn("_shelf", shelf)
    beaten = F.exists("_shelf", lambda k: (k["rank"] < F.col("_rank")) & (F.size(removal_reasons(F.col("_sig"), k["sig"])) == 0))
    return staged.filter(~(anchored & beaten)).select(*rows.columns)
