"""Distributed radix sort: stable counting passes over the digits of a composite key, ranks by prefix sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pleonasm.llm.scratch import Scratch

_TOP = -(1 << 63)


@dataclass(frozen=True)
class Field:
    """A column of whole numbers in the key; nulls come last either way."""

    name: str
    descending: bool = False


@dataclass(frozen=True)
class Digit:
    """Bits of one field, from `shift` on."""

    value: Column
    shift: int
    bits: int

    @property
    def column(self) -> Column:
        return F.shiftrightunsigned(self.value, self.shift).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")


def _even(value: Column, width: int, most: int) -> list[Digit]:
    """Digits of a value of `width` bits, as few as `most` bits each allow, of even size."""
    passes = -(-width // most)
    if not passes:
        return []
    bits = -(-width // passes)
    return [Digit(value, at, min(bits, width - at)) for at in range(0, width, bits)]


def digits_of(rows: DataFrame, fields: list[Field], most_bits: int) -> list[Digit]:
    """Digits of the key from the least significant one on; what all rows share needs none."""
    wanted = []
    for field in fields:
        column = F.col(field.name)
        wanted += [F.min(column), F.max(column), F.count(column), F.count("*")]
    found = list(rows.agg(*[c.alias(f"a{i}") for i, c in enumerate(wanted)]).first())
    digits: list[Digit] = []
    for at in range(len(fields) - 1, -1, -1):
        low, high, present, every = found[4 * at : 4 * at + 4]
        column = F.col(fields[at].name).cast("long")
        if present:
            if high - low < 1 << 63:  # counted from one end, so that high digits are gone
                value, width = (F.lit(high) - column if fields[at].descending else column - F.lit(low)), (high - low).bit_length()
            else:
                value, width = column.bitwiseXOR(F.lit(_TOP)), 64
                value = F.bitwise_not(value) if fields[at].descending else value
            digits += _even(F.coalesce(value, F.lit(0).cast("long")), width, most_bits)
        if present < every:
            digits.append(Digit(column.isNull().cast("long"), 0, 1))
    return digits


def sorted_positions(rows: DataFrame, fields: list[Field], scratch: Scratch, block_rows: int = 1 << 17, digit_bits: int = 11) -> DataFrame:
    """`rows` with their `position` (from 0) in the order of `fields`.

    Every pass is a counting sort by one digit, the least significant first. Rows stand in blocks of equal size. The
    rows of each block and digit are counted; prefix sums over (digit, block) give each of them its first destination,
    and a row's destination is that plus its number among them, in the order of the pass before, so passes are stable.
    Destinations are dense: blocks of the next pass hold `block_rows` rows each (fewer if there are fewer than that
    for a task), whatever the keys, and no group of a pass is larger than a block, so a key that a third of all rows
    have is no hot key. Counts come in at most 2^`digit_bits` rows a block. Each pass writes a table, which the next
    one reads, and drops the table before it.

    Columns `position` and names starting with `radix_` must be free. Rows of equal keys come in any order. No rows, no
    positions.
    """
    if rows.isEmpty():
        return rows.withColumn("position", F.lit(0).cast("long"))
    session, columns = rows.sparkSession, rows.columns
    state = scratch.write(rows.withColumn("radix_place", F.monotonically_increasing_id()), "pass0")
    digits = digits_of(state, fields, digit_bits)
    total = state.count()
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))
    block = max(1, min(block_rows, max(1024, -(-total // tasks))))
    part = F.pmod(F.col("radix_place"), F.lit(-(-total // block)))  # at first dealt in turn
    for number, digit in enumerate(digits or [Digit(F.lit(0).cast("long"), 0, 1)], 1):
        keyed = state.withColumn("radix_part", part).withColumn("radix_digit", digit.column)
        counts = keyed.groupBy("radix_digit", "radix_part").agg(F.count("*").alias("radix_n"))
        before = F.coalesce(F.sum("radix_n").over(Window.partitionBy("radix_digit").orderBy("radix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        totals = counts.groupBy("radix_digit").agg(F.sum("radix_n").alias("radix_n"))  # at most 2^digit_bits rows
        smaller = F.coalesce(F.sum("radix_n").over(Window.partitionBy(F.lit(0)).orderBy("radix_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = totals.select("radix_digit", smaller.alias("radix_smaller"))
        first = counts.withColumn("radix_before", before).join(F.broadcast(starts), "radix_digit")
        first = first.select("radix_digit", "radix_part", (F.col("radix_before") + F.col("radix_smaller")).alias("radix_first"))
        nth = F.row_number().over(Window.partitionBy("radix_digit", "radix_part").orderBy("radix_place"))
        moved = keyed.withColumn("radix_nth", nth).join(first, ["radix_digit", "radix_part"])
        place = (F.col("radix_first") + F.col("radix_nth") - 1).cast("long")
        state = scratch.write(moved.select(*columns, place.alias("radix_place")), f"pass{number}")
        scratch.drop(f"pass{number - 1}")
        part = F.floor(F.col("radix_place") / block)
    return state.withColumnRenamed("radix_place", "position")
