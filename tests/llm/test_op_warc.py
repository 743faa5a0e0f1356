import base64
import gzip
import hashlib

import pytest

from pleonasm.llm import warc as W

SCHEMA = "record_id long, url string, payload string"
ROWS = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://b/ 9\r\nX: y", "same"), (3, None, None), (4, "http://e", ""),
    (5, "http://long", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "é🤦\r\n\r\n" * 20_000), (6, "http://t", "tail\r\n\r\n"), (7, "http://u", "own"), (7, "http://u", "own"), (None, "http://n", "own"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, shortest=0):
    out = []
    for i, url, p in rows:
        same = [r[0] for r in rows if (r[2] or "") == (p or "") and r[0] is not None]
        size = len((p or "").encode())
        best = max(same) if size >= shortest and sum((r[2] or "") == (p or "") and r[0] is not None for r in rows) > 1 else None
        revisit = best is not None and best != i
        out.append((str(i), "revisit" if revisit else "response", digest(p), str(best) if revisit else None, size, p or ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("shortest,per_file", [(0, 1000), (4, 2), (1000, 1)])
def test_round_trip(spark, tmp_path, shortest, per_file):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "original", "value")}).repartition(3)
    path = f"file://{tmp_path}/archives"
    W.write_archives(pages, path, shortest=shortest, records_per_file=per_file)
    found = W.with_original_payloads(W.read_archives(spark, path)).collect()
    assert sorted(((str(r.record_id), r.record_type, r.payload_digest, r.refers_to, r.payload_bytes, r.payload) for r in found), key=str) == brute(ROWS, shortest)


def test_headers_are_fresh_and_whole(spark, tmp_path):
    W.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), f"file://{tmp_path}/a")
    content = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*")))
    records = list(W.parse_records(content))
    assert len(records) == len(ROWS)
    for headers, block in records:
        assert int(headers["content-length"]) == len(block)
        assert headers["warc-date"].endswith("Z") and "\n" not in headers["warc-target-uri"]
        assert ("warc-refers-to" in headers) == (headers["warc-type"] == "revisit") == ("warc-profile" in headers)
    urls = {h["warc-target-uri"] for h, _ in records}
    assert "http://b/%209%20%0d" not in urls and "http://b/%209%20%20X:%20y" in urls


def test_a_broken_archive_is_refused():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert list(W.parse_records(good * 2))[1][1] == b"ab"
    with pytest.raises(ValueError, match="does not end"):
        list(W.parse_records(good.replace(b": 2", b": 1")))
    with pytest.raises(ValueError, match="no WARC record"):
        list(W.parse_records(b"x" + good))


def test_empty_table(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert W.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_query_by_brute_force(spark, duck, folder):
    from pleonasm.llm.catalog import QUERIES

    found = QUERIES["op6_resolve_revisits"](spark, folder).collect()
    rows = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert sorted(((str(r.page_id), r.record_type, r.payload_digest, None if r.refers_to is None else str(r.refers_to), r.payload_bytes) for r in found), key=str) == sorted((x[:5] for x in brute(rows)), key=str)
