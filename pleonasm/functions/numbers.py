"""Number words and canonical values of typed facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pleonasm import lexicons as L
from pleonasm.functions.arrays import let, literal_map


def number_value(phrase: Column) -> Column:
    """Value of a run of number words, or null when any part is not one."""
    table = literal_map(L.NUMBER_WORDS)
    parts = F.filter(F.split(F.lower(F.trim(phrase)), r"[-\s]+"), lambda p: p != "")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def step(acc: Column, part: Column) -> Column:
        value = F.try_element_at(table, part)
        scale = part.isin("thousand", "million")
        return F.struct(
            F.when(scale, acc["total"] + F.greatest(one, acc["run"]) * value).otherwise(acc["total"]).alias("total"),
            F.when(scale, zero)
            .when(part == "hundred", F.greatest(one, acc["run"]) * 100)
            .otherwise(acc["run"] + value)
            .alias("run"),
            (acc["known"] & value.isNotNull()).alias("known"),
        )

    start = F.struct(zero.alias("total"), zero.alias("run"), (F.size(parts) > 0).alias("known"))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["known"], acc["total"] + acc["run"]))


def plain_number(text: Column) -> Column:
    """Digits for number words; other text is only trimmed."""
    return F.coalesce(number_value(text).cast("string"), F.trim(text))


def iso_date(low: Column) -> Column:
    """`october 3 1998` to `1998-10-03`; other text stays."""
    shape = r"^([a-z]+)\s+(\d{1,2})\s+(\d{4})$"
    # A month is named by its first three letters or in full; "sept" is the one other short form.
    months = literal_map(
        {
            form: f"{number:02d}"
            for number, name in enumerate(L.MONTH_NAMES, start=1)
            for form in (name[:3], name, "sept" if name == "september" else name)
        }
    )
    month = F.try_element_at(months, F.regexp_extract(low, shape, 1))
    rebuilt = F.concat_ws("-", F.regexp_extract(low, shape, 3), month, F.lpad(F.regexp_extract(low, shape, 2), 2, "0"))
    return F.when(low.rlike(shape) & month.isNotNull(), rebuilt).otherwise(low)


def clock_time(low: Column) -> Column:
    """`9:30 pm` and `nine thirty pm` to `09:30:pm`; other text stays."""
    digits = r"^(\d{1,2}):(\d{2})\s*(am|pm)$"
    words = rf"^({L.NUMBER_PHRASE})\s+(?:oh\s+)?({L.NUMBER_PHRASE})\s*(am|pm)$"
    two = lambda text: F.lpad(text, 2, "0")
    part = lambda pattern, i: F.regexp_extract(low, pattern, i)
    numeric = F.concat_ws(":", two(part(digits, 1)), part(digits, 2), part(digits, 3))
    clock = F.struct(number_value(part(words, 1)).alias("hour"), number_value(part(words, 2)).alias("minute"))

    def spelled(c: Column) -> Column:
        text = F.concat_ws(":", two(c["hour"].cast("string")), two(c["minute"].cast("string")), part(words, 3))
        return F.when((c["hour"] <= 23) & (c["minute"] <= 59), text).otherwise(low)

    return F.when(low.rlike(digits), numeric).when(low.rlike(words), let(clock, spelled)).otherwise(low)


def money_amount(low: Column) -> Column:
    """`$1200.50` and `five hundred dollars` to the bare amount; other text stays."""
    digits, words = r"^\$([0-9]+(?:\.[0-9]+)?)$", rf"^({L.NUMBER_PHRASE})\s+dollars$"
    return (
        F.when(low.rlike(digits), F.regexp_extract(low, digits, 1))
        .when(low.rlike(words), number_value(F.regexp_extract(low, words, 1)).cast("string"))
        .otherwise(low)
    )


def percent_amount(low: Column) -> Column:
    return plain_number(F.regexp_replace(low, r"%$|\s+percent$", ""))


def measure_amount(low: Column) -> Column:
    """`2 seconds` to `2:second`, `twelve milliseconds` to `12:ms`; other text stays."""
    shape = r"^(.+?)\s*(ms|milliseconds|seconds|minutes|hours|days)$"
    unit = F.regexp_extract(low, shape, 2)
    unit = F.when(unit.isin("ms", "milliseconds"), F.lit("ms")).otherwise(F.regexp_replace(unit, "s$", ""))
    return F.when(low.rlike(shape), F.concat_ws(":", plain_number(F.regexp_extract(low, shape, 1)), unit)).otherwise(low)


_CANONICAL = {
    "date": iso_date,
    "time": clock_time,
    "money": money_amount,
    "percentage": percent_amount,
    "measurement": measure_amount,
    "number": plain_number,
}


def canonical_value(kind: Column | str, value: Column) -> Column:
    """One form for equal values of the kinds that can be written in several ways."""
    low = F.trim(F.replace(F.lower(value), F.lit(","), F.lit("")))
    if isinstance(kind, str):
        return let(low, _CANONICAL[kind]) if kind in _CANONICAL else value

    def by_kind(v: Column) -> Column:
        chain = F
        for name, canonical in _CANONICAL.items():
            chain = chain.when(kind == name, canonical(v))
        return chain.otherwise(value)

    return F.when(kind.isin(list(_CANONICAL)), let(low, by_kind)).otherwise(value)


def light_fact_key(value: Column) -> Column:
    """`percent:83`, `measure:12:ms`, `duration:5:minute`, or `raw:` and the text."""
    number = rf"(\d+(?:\.\d+)?|{L.NUMBER_PHRASE})"
    percent, ms = rf"^{number}\s*(?:%|percent)$", rf"^{number}\s*(?:ms|milliseconds)$"
    span = rf"^{number}\s*(second|minute|hour|day)s?$"

    def key(low: Column) -> Column:
        amount = lambda pattern: plain_number(F.regexp_extract(low, pattern, 1))
        return (
            F.when(low.rlike(percent), F.concat(F.lit("percent:"), amount(percent)))
            .when(low.rlike(ms), F.concat(F.lit("measure:"), amount(ms), F.lit(":ms")))
            .when(low.rlike(span), F.concat(F.lit("duration:"), amount(span), F.lit(":"), F.regexp_extract(low, span, 2)))
            .otherwise(F.concat(F.lit("raw:"), value))
        )

    return let(F.replace(F.lower(value), F.lit(","), F.lit("")), key)
