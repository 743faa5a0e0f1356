"""WARC archives: write records, read them back, and resolve records that repeat a payload."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pleonasm.session import cut_lineage

# Fixed values of the format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ID = "urn:record:"


def payload_digest(payload: Column) -> Column:
    """SHA-1 of a text in UTF-8, in upper-case base 32: every five hexadecimal digits are four base-32 ones."""
    digest = F.sha1(payload.cast("binary"))
    digits = []
    for block in range(8):
        value = F.conv(F.substring(digest, 5 * block + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*digits)


def resolve_revisits(headers: DataFrame, record: str = "record_id", shortest: int = 0) -> DataFrame:
    """(payload_digest, original): the largest record of each digest that two or more records share.

    Takes rows (record, payload_digest, payload_bytes); payloads of fewer than `shortest` bytes are left out. Headers
    alone are shuffled, after each task has taken the largest record of what it read; a payload that a third of all
    records have is one row per task.
    """
    known = headers.where((F.col("payload_bytes") >= shortest) & F.col(record).isNotNull())
    shared = known.groupBy("payload_digest").agg(F.max(record).alias("original"), F.count("*").alias("records"))
    return shared.where("records > 1").drop("records")


def _clean(value: Column) -> Column:
    """A header value: no white space or control characters, which could end the line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")


def record_texts(records: DataFrame, record: str, url: str, payload: str, date: Column) -> DataFrame:
    """(value): each record as text, up to the two line ends behind it.

    Takes rows with payload_digest and `original` (null: a response, else the record it repeats).
    """
    line = "\r\n"
    uri = F.concat(F.lit(f"<{_ID}"), F.url_encode(F.col(record).cast("string")), F.lit(">"))
    refers = F.concat(F.lit(f"<{_ID}"), F.url_encode(F.col("original").cast("string")), F.lit(">"))
    revisit = F.col("original").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(line + line)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col(payload)))
    headers = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.when(F.col(record).isNotNull(), F.concat(F.lit("WARC-Record-ID: "), uri)),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col(url))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), refers)),
        F.when(revisit, F.lit(f"WARC-Profile: {IDENTICAL}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return records.select(F.concat(F.concat_ws(line, *headers), F.lit(line + line), block).alias("value"))


def write_archives(
    pages: DataFrame,
    path: str,
    record: str = "record_id",
    url: str = "url",
    payload: str = "payload",
    shortest: int = 0,
    date: Column | None = None,
    records_per_file: int = 1000,
) -> None:
    """Writes one WARC record per row below `path`, payloads that repeat as revisits.

    The project has no web records of its own, so this is general: rows of a record id, a URL and a payload. Of records
    with equal payloads of at least `shortest` bytes the largest is the response, the others are revisits that refer to
    it and carry no payload; smaller payloads are all responses. All headers are made anew. A null payload is empty, a
    null URL is written as empty. A null record id is never referred to and is written without a record id; repeated
    rows of one id are all responses or all revisits. Other columns are not read, an empty table gives no records.

    Spark's text sink writes the files: a WARC record ends with two line ends, which is the separator of its rows. So
    writing is retried and committed as for any other table, and goes wherever Spark can write. A file is compressed
    with gzip and holds at most `records_per_file` records.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is None else date
    given = pages.select(F.col(record).alias("record_id"), F.col(url).alias("url"), body.alias("payload"))
    given = given.withColumns({"payload_digest": payload_digest(F.col("payload")), "payload_bytes": F.octet_length("payload")})
    # Apart from its aggregation, so that adaptive execution can split a payload of very many records.
    originals = cut_lineage(resolve_revisits(given.select("record_id", "payload_digest", "payload_bytes"), shortest=shortest)).withColumnRenamed("payload_digest", "digest")
    same = (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= shortest)
    joined = given.join(originals, same, "left")
    # The largest one is the response; a null id is compared as different.
    joined = joined.withColumn("original", F.when(~F.col("record_id").eqNullSafe(F.col("original")), F.col("original")))
    texts = record_texts(joined, "record_id", "url", "payload", date)
    texts.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:stop].decode().split("\r\n")
        if first != VERSION:
            raise ValueError(f"no WARC record at byte {at}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = stop + 4
        end = start + int(headers["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield headers, content[start:end]
        at = end + 4


def _named(uri: str | None) -> str | None:
    found = re.fullmatch(rf"<{_ID}(.*)>", uri or "")
    return unquote(found[1].replace("+", " ")) if found else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(record_id, url, record_type, payload_digest, refers_to, payload_bytes, payload) of the archives below `path`.

    Record ids are text; payload_bytes is null and payload too for a revisit, which has none of its own. The digest of
    a response is computed from what was read, and reading fails where it is not the one in its header. A task holds
    one batch of whole files.
    """
    names = ["record_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"]
    schema = T.StructType([T.StructField(n, T.LongType() if n == "payload_bytes" else T.StringType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_records(gzip.decompress(content.as_buffer())):
                    kind, digest, size, payload = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), None, None
                    if kind == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"payload of {headers.get('warc-record-id')} does not have its digest")
                        size, payload = len(body), body.decode() if with_payload else None
                    rows.append((_named(headers.get("warc-record-id")), headers["warc-target-uri"], kind, digest, _named(headers.get("warc-refers-to")), size, payload))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.gz").load(path).select("content")
    return files.mapInArrow(run, schema)


def with_original_payloads(records: DataFrame) -> DataFrame:
    """Records with payload_bytes and payload of the response for each revisit, joined by payload digest and id."""
    plain = records.where("record_type <> 'revisit'")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload")
    referred = plain.select(F.col("record_id").alias("of"), F.col("payload_digest").alias("digest"), "payload_bytes", "payload").dropDuplicates(["of", "digest"])
    joined = revisits.join(referred, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("digest")), "left")
    return plain.unionByName(joined.drop("of", "digest"))
