"""Benchmark passages in prompts, by a prefix-filtered join of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pleonasm.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def item_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, words) of each window of an item; an item of fewer words is one window, of no words none."""
    split = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return split.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct()


def _shingles(words: Column, size: Column | int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.slice(words, i, size).alias("gram")))


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(words, pos, gram): shingles of each distinct window; a window shorter than a shingle is one itself."""
    distinct = windows.select("words").distinct()
    return distinct.select("words", F.inline(_shingles(F.col("words"), F.least(F.size("words"), F.lit(shingle)))))


def postings(prompts: DataFrame, row: Column, text: str, grams: DataFrame, sizes: list[int], window: int, block_rows: int) -> DataFrame:
    """(row, n_words, pos, gram, context, at): where a prompt holds a shingle of the benchmark, with the words around it.

    `context` starts at word `at` and reaches as far as a window around the shingle can. Each prompt also has a row of
    position 0, so that none is lost. The benchmark side is broadcast in blocks of `block_rows` shingles: each block
    is one pass over the prompts, and one block is the rule.
    """
    count = grams.count()
    blocks = max(1, -(-count // block_rows))
    split = prompts.select(row.alias("row"), words_of(F.col(text)).alias("w")).withColumn("n_words", F.size("w"))

    def hashed(size: int) -> Column:
        starts = F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), F.xxhash64(F.slice("w", i, size)).alias("hash")))

    nothing = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("hash")))
    entries = split.select("row", "n_words", "w", F.inline(F.concat(nothing, *[hashed(s) for s in sizes])))
    known = grams.select(F.xxhash64("gram").alias("known"), "gram")
    parts = []
    for b in range(blocks):
        side = F.broadcast(known.where(F.pmod("known", F.lit(blocks)) == b) if blocks > 1 else known)
        met = entries.join(side, F.col("hash") == F.col("known"), "left" if b == 0 else "inner")
        met = met.where(((F.col("pos") == 0) if b == 0 else F.lit(False)) | (F.slice("w", F.greatest("pos", F.lit(1)), "size") == F.col("gram")))
        at = F.greatest(F.col("pos") - window, F.lit(1))
        parts.append(met.select("row", "n_words", "pos", "gram", at.alias("at"), F.when(F.col("pos") > 0, F.slice("w", at, F.col("pos") - at + window)).alias("context")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def find_benchmark_passages(
    prompts: DataFrame,
    benchmark: DataFrame,
    key: str = "prompt_id",
    text: str = "text",
    item: str = "case_id",
    item_text: str = "prompt",
    window: int = 10,
    shingle: int = 5,
    block_rows: int = 200_000,
) -> DataFrame:
    """Finds the benchmark cases whose windows of `window` words stand in a prompt word for word.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. Of a case with fewer words
    than a window all words are one window; a case without words has none.

    Method: the shingles of all windows are ordered by how often they stand in the prompts. A prompt that holds a window
    holds all its shingles, so the rarest alone is joined (a prefix of one). The shingle's place in the window bounds
    where the window can start and end in the prompt, and the words there are compared. A window with a shingle that
    no prompt has is not joined at all.

    Built-in functions only. Prompts are read once: the shingles of the benchmark are broadcast in blocks of
    `block_rows` rows (about 20 MB), beyond which each block is one more pass. What is shuffled are the places where a
    benchmark shingle stands; a passage in a third of all prompts gives as many places, dealt by prompt.

    Returns one row per input row: `key`, n_words, n_hit (words inside any occurrence), items (sorted array of the
    cases with occurring windows, as strings), passages (sorted array of start and length in words, from 0). A null or
    empty text has no words. Repeated rows are returned as often as they come, null keys are kept, a null case id
    counts as none, other columns are not read. An empty benchmark leaves all prompts clean, an empty table gives no
    rows.
    """
    row = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h"))
    windows = cut_lineage(item_windows(benchmark, item, item_text, window))
    shingles = window_shingles(windows, shingle)
    grams = shingles.select("gram").distinct()
    sizes = sorted(r[0] for r in grams.select(F.size("gram")).distinct().collect())  # at most `shingle` numbers
    placed = cut_lineage(postings(prompts, row, text, grams, sizes, window, block_rows))

    rarity = placed.where("pos > 0").groupBy("gram").agg(F.count("*").alias("places"))
    ranked = shingles.join(rarity, "gram", "left")
    rarest = ranked.groupBy("words").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "pos", "gram")).alias("rarest"))
    prefix = rarest.where("rarest.places > 0").select("words", F.col("rarest.pos").alias("within"), F.col("rarest.gram").alias("gram"))
    start = F.col("pos") - F.col("within") + 1
    found = (
        placed.where("pos > 0")
        .join(prefix, "gram")
        .where((start >= 1) & (start + F.size("words") - 1 <= F.col("n_words")))
        .where(F.slice("context", start - F.col("at") + 1, F.size("words")) == F.col("words"))
        .select("row", "words", start.alias("start"), F.size("words").alias("length"))
        .distinct()
    )

    def covered(spans: Column) -> Column:
        def step(state: Column, span: Column) -> Column:
            end = span["start"] + span["length"]
            more = F.greatest(end - F.greatest(span["start"], state["end"]), F.lit(0))
            return F.struct((state["n"] + more).alias("n"), F.greatest(state["end"], end).alias("end"))

        return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("long")

    passages = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct((F.col("start") - 1).alias("start"), "length"))).alias("passages"))
    cases = found.select("row", "words").distinct().join(windows, "words").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hit = passages.join(cases, passages["row"].eqNullSafe(cases["row"])).select(passages["row"].alias("hit"), "passages", "items")
    every = placed.where("pos = 0").select("row", F.col("n_words").cast("long").alias("n_words"))
    joined = every.join(hit, F.col("row").eqNullSafe(F.col("hit")), "left")
    return joined.select(
        F.col("row.id").alias(key),
        "n_words",
        F.coalesce(covered(F.col("passages")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("passages", F.array().cast("array<struct<start:int,length:int>>")).alias("passages"),
    )
