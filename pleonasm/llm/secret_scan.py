"""Secrets in prompts, and how many repositories and owners carry each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pleonasm.functions import arrays as A
from pleonasm.session import cut_lineage

# Kinds of finding, pattern, group that holds the value, least number of code points of the value.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
_PLACEHOLDER = r"(?i)example|placeholder|changeme|dummy|sample|your|xxxx|\*\*\*"
_SPAN = "start long, kind int, end long, value string"


def _found(text: Column, kind: int) -> Column:
    """Spans of one kind: leftmost matches that do not overlap, the short ones dropped.

    Places are running totals of the lengths of matches and of what lies between them.
    """
    _, pattern, group, least = KINDS[kind]
    pattern = F.lit(pattern)
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"), F.regexp_extract_all(text, pattern, F.lit(group)).alias("value")
    )
    # The last gap has no match behind it.
    sized = F.transform(
        F.filter(pairs, lambda p: p["match"].isNotNull()),
        lambda p: F.struct(F.length(p["gap"]).cast("long").alias("gap"), F.length(p["match"]).cast("long").alias("match"), p["value"].alias("value")),
    )

    def placed(items: Column) -> Column:
        def span(before: Column, p: Column, i: Column) -> Column:
            start = F.get(before, i) + p["gap"]
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + p["match"]).alias("end"), p["value"].alias("value"))

        totals = A.running_totals(F.transform(items, lambda p: p["gap"] + p["match"]))
        spans = A.let(totals, lambda before: F.transform(items, lambda p, i: span(before, p, i)))
        return F.filter(spans, lambda s: F.length(s["value"]) >= least)

    empty = F.array().cast(f"array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>")
    return F.when(text.rlike(KINDS[kind][1]), A.let(sized, placed)).otherwise(empty)


def find_secrets(text: Column) -> Column:
    """Array of (start, kind, end, value) by start, then kind; places in code points, end exclusive."""
    return F.array_sort(F.concat(*[_found(text, k) for k in range(len(KINDS))]))


def span_names(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def live_looking(value: Column) -> Column:
    """Long enough, letters and digits mixed, and no word that stands for a value."""
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(_PLACEHOLDER)


def secret_ownership(findings: DataFrame) -> DataFrame:
    """(secret, prompts, repositories, owners) of rows (secret, repository, owner).

    Each step counts where the rows are read, then by the next shorter key: a secret in a third of all prompts shuffles
    one row for each repository and task. A repository is known by its owner and name; a null name or owner counts as
    one of its own.
    """
    by_repository = findings.groupBy("secret", "owner", "repository").agg(F.count("*").alias("prompts"))
    by_owner = by_repository.groupBy("secret", "owner").agg(F.sum("prompts").alias("prompts"), F.count("*").alias("repositories"))
    return by_owner.groupBy("secret").agg(F.sum("prompts").alias("prompts"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(
    prompts: DataFrame,
    key: str = "prompt_id",
    text: str = "text",
    repository: str = "repository",
    owner: str = "owner",
    copied_owners: int = 3,
) -> DataFrame:
    """Finds secrets in whole prompts and tells copied examples from those one owner has.

    Kinds: an assignment to a name such as password or token, an access key id, a long hexadecimal string. Over the
    corpus each value (by its SHA-256) is counted by distinct repositories and owners. A finding is `copied` if at
    least `copied_owners` owners have its value, `live` if one owner alone has it and it looks like a real credential
    (16 characters or more, letters and digits, no placeholder word), `unclear` otherwise.

    Built-in functions only. Findings leave the scan as one slim row per prompt; only their hashes are shuffled.

    Returns one row per input row: `key`, findings (array of start, kind, end, value; code points, end exclusive),
    verdicts (map from SHA-256 of a value to struct of prompts, repositories, owners, verdict). A null text is empty
    and has no findings. Repeated rows count as prompts of their own, null keys, repositories and owners are values
    like any other, other columns are not read, an empty table gives no rows.
    """
    columns = [F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(repository).alias("repository"), F.col(owner).alias("owner")]
    scanned = cut_lineage(prompts.select(*columns, find_secrets(F.coalesce(F.col(text), F.lit(""))).alias("findings")))
    row = F.struct("id", "h").alias("row")
    single = scanned.where(F.size("findings") > 0).select(row, "repository", "owner", F.explode(F.array_distinct(F.transform("findings", lambda s: s["value"]))).alias("value"))
    single = single.withColumns({"secret": F.sha2("value", 256), "live": live_looking(F.col("value"))}).drop("value")
    verdict = F.when(F.col("owners") >= copied_owners, "copied").when((F.col("owners") == 1) & F.col("live"), "live").otherwise("unclear")
    # Cut off from its aggregation, so that adaptive execution can split a secret of very many prompts in the join.
    judged = single.join(cut_lineage(secret_ownership(single)), "secret").select("row", "secret", F.struct("prompts", "repositories", "owners", verdict.alias("verdict")).alias("verdict"))
    by_row = judged.distinct().groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("secret", "verdict"))).alias("verdicts"))
    whole = scanned.select(row.alias("own"), "findings")
    joined = whole.join(by_row, F.col("own").eqNullSafe(F.col("row")), "left")
    none = F.create_map().cast("map<string,struct<prompts:bigint,repositories:bigint,owners:bigint,verdict:string>>")
    return joined.select(F.col("own.id").alias(key), "findings", F.coalesce("verdicts", none).alias("verdicts"))
