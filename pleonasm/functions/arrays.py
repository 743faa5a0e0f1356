"""Order and repeat logic inside one array, so that work on a single text needs no shuffle.

All of it is sort based: `n log n` in the number of elements, never pairwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_BUILT: WeakKeyDictionary = WeakKeyDictionary()


def reusable(build: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Builds a wide expression once per column name and context.

    Every node of an expression is a call into the JVM, so an expression of some thousand nodes takes
    a second to put together. Expressions are immutable and may stand in any number of plans.
    """

    @wraps(build)
    def once(value: Column) -> Column:
        plain = re.fullmatch(r"Column<'([A-Za-z_]+)'>", str(value))
        if plain is None:
            return build(value)
        built = _BUILT.setdefault(SparkContext._active_spark_context, {})
        key = (build.__module__, build.__name__, plain[1])
        if key not in built:
            built[key] = build(value)
        return built[key]

    return once


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyed(items: Column, key: Callable[[Column], Column]) -> Column:
    """Array of (key, index) sorted by key, then by index."""
    return F.sort_array(F.transform(items, lambda item, i: F.struct(key(item).alias("k"), i.alias("i"))))


def _same_as_previous(pairs: Column, i: Column) -> Column:
    return F.when(i > 0, F.get(pairs, i - 1)["k"] == F.get(pairs, i)["k"]).otherwise(F.lit(False))


def first_positions(pairs: Column) -> Column:
    """Indexes of the first element of every key, in order. `pairs` comes from `keyed`."""
    return let(
        pairs,
        lambda ps: F.sort_array(
            F.transform(F.filter(ps, lambda p, i: ~_same_as_previous(ps, i)), lambda p: p["i"])
        ),
    )


def later_copies(pairs: Column) -> Column:
    """The (key, index) pairs that have an earlier element with the same key."""
    return let(pairs, lambda ps: F.filter(ps, lambda p, i: _same_as_previous(ps, i)))


def grouped(pairs: Column) -> Column:
    """Array of (key, items): the indexes of the elements of every key, in order. `pairs` comes from `keyed`."""

    def build(ps: Column) -> Column:
        opens = F.filter(F.transform(ps, lambda p, i: i), lambda i: ~_same_as_previous(ps, i))

        def cut(starts: Column) -> Column:
            size = lambda s, r: F.coalesce(F.get(starts, r + 1), F.size(ps)) - s
            run = lambda s, r: F.transform(F.slice(ps, s + 1, size(s, r)), lambda p: p["i"])
            return F.transform(starts, lambda s, r: F.struct(F.get(ps, s)["k"].alias("key"), run(s, r).alias("items")))

        return let(opens, cut)

    return let(pairs, build)


def shared_keys(pairs: Column) -> Column:
    """The (key, index) pairs of all elements whose key another element has too."""

    def shared(ps: Column) -> Column:
        same_as_next = lambda i: F.coalesce(F.get(ps, i + 1)["k"] == F.get(ps, i)["k"], F.lit(False))
        return F.filter(ps, lambda p, i: _same_as_previous(ps, i) | same_as_next(i))

    return let(pairs, shared)


def shared_positions(pairs: Column) -> Column:
    """Indexes of all elements whose key another element has too, in order."""
    return F.sort_array(F.transform(shared_keys(pairs), lambda p: p["i"]))


def running_totals(values: Column) -> Column:
    """For each element the sum of all before it.

    Sums of blocks of about the root of their number, then sums inside a block: n times the root of n in all.
    """

    def summed(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda total, x: total + x.cast("long"))

    def build(xs: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), step), lambda at: F.slice(xs, at + 1, step))

        def place(bs: Column) -> Column:
            bases = let(F.transform(bs, summed), lambda sums: F.transform(sums, lambda s, i: summed(F.slice(sums, 1, i))))
            return F.flatten(F.zip_with(bs, bases, lambda block, base: F.transform(block, lambda x, i: base + summed(F.slice(block, 1, i)))))

        return let(blocks, place)

    return let(values, build)


def copies_and_firsts(pairs: Column) -> Column:
    """(i, first) of the elements that have an earlier one with the same key: their index and that of the first."""

    def build(ps: Column) -> Column:
        new = F.transform(ps, lambda p, i: F.when(_same_as_previous(ps, i), 0).otherwise(1))
        firsts = F.filter(ps, lambda p, i: ~_same_as_previous(ps, i))

        def match(m: Column) -> Column:
            group = lambda j: F.get(m["before"], j) + F.get(m["new"], j) - 1
            both = F.transform(ps, lambda p, j: F.struct(p["i"].alias("i"), F.get(m["firsts"], group(j).cast("int"))["i"].alias("first")))
            return F.filter(both, lambda x: x["i"] != x["first"])

        return let(F.struct(new.alias("new"), running_totals(new).alias("before"), firsts.alias("firsts")), match)

    return let(pairs, build)


def pick(items: Column, positions: Column) -> Column:
    """The items at `positions`."""
    return let(items, lambda xs: F.transform(positions, lambda i: F.get(xs, i)))


def keep_first(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items without later copies of an equal key, in order."""
    return let(items, lambda xs: pick(xs, first_positions(keyed(xs, key))))


def adjacent_repeats(items: Column) -> Column:
    """(value, index) of every element equal to the one before it."""

    def repeats(xs: Column) -> Column:
        hits = F.transform(xs, lambda v, i: F.struct(v.alias("value"), i.alias("i")))
        return F.filter(hits, lambda h: F.when(h["i"] > 0, F.get(xs, h["i"] - 1) == h["value"]).otherwise(F.lit(False)))

    return let(items, repeats)


# --- literals ------------------------------------------------------------------------------------
# One parsed expression instead of one call per element: wide literal tables are built often.


def _sql(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}L" if isinstance(value, int) else repr(value)


def literal_map(table: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items()) + ")")


def literal_array(values) -> Column:
    return F.expr("array(" + ", ".join(_sql(v) for v in values) + ")")


def literal_structs(names: tuple[str, ...], rows) -> Column:
    """Array of structs with string fields `names`."""
    one = lambda row: "named_struct(" + ", ".join(f"{_sql(n)}, {_sql(v)}" for n, v in zip(names, row)) + ")"
    return F.expr("array(" + ", ".join(one(row) for row in rows) + ")")
