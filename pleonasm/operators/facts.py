"""Typed facts of a text as rows, as sets, and as placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions import arrays as A
from pleonasm.functions import text as T
from pleonasm.functions.numbers import canonical_value

_MASK = "__PROTECTED_0__"


def _facts(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def typed_facts(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per fact of 16 kinds; a text span belongs to the first kind that claims it.

    Kinds are taken in order, each hiding its spans from the next. One pass over the rows, no shuffle.
    """
    staged = df.select(*keys, F.col(text).alias("_t0"))
    found = []
    for i, (kind, pattern) in enumerate(L.FACT_PATTERNS):
        source, regex = F.col(f"_t{i}"), f"(?i){pattern}"
        hit = source.rlike(regex)
        facts = _facts(kind, T.find_all(source, regex))
        none = F.array().cast("array<struct<kind:string,value:string>>")
        staged = staged.withColumn(f"_f{i}", F.when(hit, facts).otherwise(none)).withColumn(
            f"_t{i + 1}", F.when(hit, F.regexp_replace(source, regex, _MASK)).otherwise(source)
        )
        found.append(f"_f{i}")
    rows = staged.select(*keys, F.explode(F.flatten(F.array(*found))).alias("_f")).select(*keys, "_f.*")
    rows = rows.filter(~F.startswith("value", F.lit("__PROTECTED_")))
    return rows.withColumn("canon", canonical_value(F.col("kind"), F.col("value")))


def with_masked_text(df: DataFrame, text: str = "text", out: str = "masked") -> DataFrame:
    """Adds the text with numbered placeholders and the array of facts they stand for.

    Facts with the same canonical value share a placeholder. The text is cut at the matches of a kind
    and joined again with the placeholders in between.
    """
    none = F.array().cast("array<struct<kind:string,canon:string,value:string>>")
    staged = df.withColumn("_m", F.struct(F.col(text).alias("text"), none.alias("regions")))
    for (kind, pattern), needed in zip(L.FACT_PATTERNS, L.FACT_NEEDS, strict=True):
        regex = f"(?i){pattern}"
        staged = staged.withColumn(
            "_m", F.when(T.holds(F.col("_m.text"), F.lower("_m.text"), needed) & F.col("_m.text").rlike(regex), _mask_kind(F.col("_m"), kind, regex)).otherwise(F.col("_m"))
        )
    # The result passes through a generator: a filter on it would otherwise be rewritten in terms of the
    # text, level by level, and the plan would grow without bound.
    done = staged.withColumn("_r", F.explode(F.array("_m")))
    return done.withColumn(out, F.col("_r.text")).withColumn("regions", F.col("_r.regions")).drop("_m", "_r")


def _mask_kind(state: Column, kind: str, regex: str) -> Column:
    text, regions = state["text"], state["regions"]

    def region(value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), canonical_value(kind, value).alias("canon"), value.alias("value"))

    def rebuild(matches: Column) -> Column:
        fresh = F.filter(matches, lambda m: ~F.startswith(m["value"], F.lit("__PROTECTED_")))
        known = A.keep_first(F.concat(regions, fresh), lambda r: F.struct(r["kind"], r["canon"]))

        def placed(all_regions: Column) -> Column:
            names = F.transform(all_regions, lambda r: F.struct(r["kind"].alias("kind"), r["canon"].alias("canon")))
            place = lambda m: F.when(F.startswith(m["value"], F.lit("__PROTECTED_")), m["value"]).otherwise(
                F.concat(
                    F.lit("__PROTECTED_"),
                    (F.array_position(names, F.struct(m["kind"].alias("kind"), m["canon"].alias("canon"))) - 1).cast("string"),
                    F.lit("__"),
                )
            )
            gaps = F.split(text, regex, -1)
            joined = F.zip_with(gaps, matches, lambda gap, m: F.concat(gap, F.when(m.isNotNull(), place(m)).otherwise("")))
            return F.struct(F.array_join(joined, "").alias("text"), all_regions.alias("regions"))

        return A.let(known, placed)

    return A.let(F.transform(T.find_all(text, regex), region), rebuild)


def restored(masked: Column, regions: Column) -> Column:
    """The text with every placeholder replaced by its fact; a later fact may contain an earlier one."""
    numbered = F.reverse(F.transform(regions, lambda r, i: F.struct(r["value"].alias("value"), i.alias("i"))))
    return F.aggregate(
        numbered,
        masked,
        lambda text, r: F.replace(text, F.concat(F.lit("__PROTECTED_"), r["i"].cast("string"), F.lit("__")), r["value"]),
    )


def free_numbers(text: Column) -> Column:
    """Distinct numbers outside header lines and dates."""
    date = next(pattern for kind, pattern in L.FACT_PATTERNS if kind == "date")
    out = text
    for pattern in (L.NUMBERED_HEADER_LINE, L.NAMED_HEADER_LINE):
        out = F.when(F.contains(text, F.lit(":")), F.regexp_replace(out, pattern, "")).otherwise(out)
    out = F.regexp_replace(out, f"(?i){date}", "")
    return F.array_distinct(T.find_all(out, L.FREE_NUMBER))


@A.reusable
def sensitive_facts(text: Column) -> Column:
    """Sorted distinct (kind, value) pairs; every kind looks at the whole text. Opaque kinds are left out."""
    kinds, patterns, needs = zip(*[(*k, n) for k, n in zip(L.FACT_PATTERNS, L.FACT_NEEDS, strict=True) if k[0] not in L.OPAQUE_KINDS])
    typed = F.zip_with(T.literal_array(kinds), T.find_all_of(text, patterns, needs), lambda kind, values: F.transform(values, lambda v: F.struct(kind.alias("kind"), v.alias("value"))))
    return F.sort_array(F.array_distinct(F.concat(F.flatten(typed), _facts("number", free_numbers(text)))))


def cache_facts(text: Column) -> Column:
    """The seven kinds that must agree before an answer may be reused."""
    return F.filter(sensitive_facts(text), lambda f: f["kind"].isin(list(L.CACHE_FACT_KINDS)))


def missing_facts(before_facts: Column, after_facts: Column, after: Column) -> Column:
    """Facts of the original that the rewrite lost.

    Numeric kinds are compared by canonical value, the others must occur literally.
    """

    def canon(f: Column) -> Column:
        return F.struct(f["kind"].alias("kind"), canonical_value(f["kind"], f["value"]).alias("canon"))

    def lost(known: Column) -> Column:
        return F.filter(
            before_facts,
            lambda f: F.when(f["kind"].isin(list(L.NUMERIC_KINDS)), ~F.array_contains(known, canon(f))).otherwise(
                ~F.contains(after, f["value"])
            ),
        )

    return A.let(F.transform(after_facts, canon), lost)


def entity_preservation(before: Column, after: Column) -> Column:
    """(score, missing) of the entities of `before` that still occur in `after`."""
    from pleonasm.functions.signals import named_entities

    def score(entities: Column) -> Column:
        missing = F.filter(entities, lambda e: ~F.contains(after, e))
        share = F.when(F.size(entities) == 0, F.lit(1.0)).otherwise(
            F.round((F.size(entities) - F.size(missing)) / F.size(entities), 3)
        )
        return F.struct(share.alias("score"), missing.alias("missing"))

    return A.let(named_entities(before), score)


def placeholder_diff(before: Column, after: Column) -> Column:
    """(missing, added) placeholders between two versions."""
    a = F.sort_array(F.array_distinct(T.find_all(before, L.PLACEHOLDER)))
    b = F.sort_array(F.array_distinct(T.find_all(after, L.PLACEHOLDER)))
    return F.struct(F.array_except(a, b).alias("missing"), F.array_except(b, a).alias("added"))
