"""From raw documents to packed training sequences, one operator a stage.

Every stage takes all that the one before it kept and returns the columns of `documents`; the last returns pieces of
sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pleonasm.llm import catalog
from pleonasm.llm.decontaminate import find_benchmark_passages
from pleonasm.llm.lines import drop_repeated_lines
from pleonasm.llm.quality import learn_quality, score_column
from pleonasm.llm.simhash import near_duplicate_prompts
from pleonasm.session import shared_folder
from pleonasm.sources.tables import Tables

QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject; it learns from the labels that are not held out.

    Each row is scored for itself: a null text has the score of an empty one, a null or repeated id is no reason to go.
    All columns stay as they are, whatever their names.
    """
    labels = catalog.labelled_prompts(Tables(spark, sf_dir).labels)
    model = learn_quality(catalog.prompts_of(docs), labels)
    return docs.where(score_column(docs, "text", model) >= QUALITY)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share.

    A null text becomes an empty one. Repeated rows count as documents of their own and stay, and so do rows without an
    id. `n_chars` is that of the text that is left; other columns stay as they are, whatever their names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0), *others).alias("others"))
    kept = drop_repeated_lines(packed, key="doc_id", carry=("others",))
    named = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return kept.select(*[named[c] if c in named else F.col("others").getField(c).alias(c) for c in docs.columns])


def _with_row_key(docs: DataFrame) -> DataFrame:
    """(row_key, text, doc): what a decision on a document comes back by, its text, and the whole row.

    The key is the id, which can be null or repeated, with the text; it is never null. In order of `row_key` the
    smallest id is first and null the last.
    """
    key = F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", F.xxhash64("text").alias("text_hash"))
    return docs.select(key.alias("row_key"), "text", F.struct(*docs.columns).alias("doc"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, that of the smallest id.

    A document without an id goes in favour of one with an id, and of several only one stays. Of an id with several
    texts each text is decided on its own (if two of them are near copies, that of the smaller hash stays), and of
    repeats of id and text one stays, that of the smallest hash of its other columns.
    """
    keyed = _with_row_key(docs)
    groups = near_duplicate_prompts(keyed, key="row_key")
    first = groups.where(F.col("component_id") == F.col("row_key")).select("row_key").distinct()
    others = F.struct(*[F.col("doc").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    # Before the join: repeats of a row are no hot key.
    single = keyed.groupBy("row_key").agg(F.min_by("doc", F.xxhash64(F.to_json(others))).alias("doc"))
    return single.join(first, "row_key", "left_semi").select("doc.*")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, with or without an id.

    Of an id with several texts only those that hold one go; full repeats of a row stay or go together.
    """
    keyed = _with_row_key(docs)
    cases = catalog.benchmark_cases(Tables(spark, sf_dir).benchmark)
    hit = find_benchmark_passages(keyed, cases, key="row_key").where("n_hit > 0").select("row_key").distinct()
    return keyed.join(hit, "row_key", "left_anti").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in sequences of 2048.

    A null or empty text is the end id alone. Repeated rows are packed each for itself, null ids are kept, and columns
    other than `doc_id` and `text` are left behind.
    """
    return catalog.packed_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack),
]

#: The classifier and the fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is a table in the shared folder, which the next one reads."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs = Tables(spark, sf_dir).documents
    for number, (_, stage) in enumerate(STAGES, 1):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
