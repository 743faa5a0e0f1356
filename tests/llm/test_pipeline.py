import sys
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402
from test_op_decontaminate import brute as passages  # noqa: E402
from test_op_lines import brute as lines  # noqa: E402
from test_op_simhash import components, plain_fingerprint  # noqa: E402

from pleonasm.llm import catalog  # noqa: E402


def test_stages_and_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "near-dedup", "decontamination", "packing"]
    assert P.ORACLE_SQL is None


def test_stages_against_brute_force(spark, folder, duck, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, state = docs.dtypes, []
    for number, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{number}")
        docs = spark.read.parquet(f"file://{tmp_path}/{number}")
        if number < 4:
            assert docs.dtypes == columns
            state.append({r.doc_id: r for r in docs.collect()})
    graded, stripped, single, clean = state

    whole = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    scores = {r.doc_id: r.predicted for r in catalog.QUERIES["op10_score_quality"](spark, folder).collect()}
    assert {i: r.text for i, r in graded.items()} == {i: t for i, t in whole.items() if scores[i] == 1}
    assert 0 < len(graded) < len(whole)

    assert {i: r.text for i, r in stripped.items()} == {k: t for k, t, *_ in lines([(i, r.text) for i, r in graded.items()], 10)}
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (graded[i].lang, graded[i].source) for i, r in stripped.items())

    prints = {i: plain_fingerprint(r.text) for i, r in stripped.items()}
    root, first = components(set(prints.values())), {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    assert set(single) == set(first.values())

    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    hits = {int(k): n for k, _, n, _ in passages([(i, r.text) for i, r in single.items()], items, 10)}
    assert set(clean) == {i for i, n in hits.items() if n == 0}

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.word_tokenizer())
    pieces = {}
    for r in docs.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, r in clean.items():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], dtype="<u4")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n, _ in sorted(pieces[i])] == [c for _, _, c in sorted(pieces[i])]
        assert sum(n for _, n, _ in pieces[i]) == len(ids)
    assert set(pieces) == set(clean)


def _odd_documents(spark, folder, rows):
    like = spark.read.parquet(f"{folder}/documents.parquet").schema
    named = spark.createDataFrame(rows, "doc_id long, text string")
    more = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in like if f.name not in ("doc_id", "text")}
    return named.select(*[more.get(f.name, F.col(f.name).cast(f.dataType).alias(f.name)) for f in like]).repartition(3)


def _left(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)


def test_near_dedup_of_null_and_repeated_ids(spark, folder):
    a, b, c, d = ("".join(f"{x}{i} " for i in range(40)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b), (None, a), (None, c), (None, c), (9, d), (9, None), (None, "")]
    kept = P.drop_near_duplicates(spark, _odd_documents(spark, folder, rows), folder)
    assert kept.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
    assert _left(kept) == sorted([(3, a), (5, b), (None, c), (9, d), (9, None)], key=str)


def test_decontamination_of_null_and_repeated_ids(spark, folder, duck):
    (passage,) = duck.execute("SELECT text FROM benchmark ORDER BY item_id LIMIT 1").fetchone()
    dirty, clean = f"before {passage} after", "nothing of the kind"
    rows = [(1, dirty), (1, clean), (1, clean), (None, dirty), (None, clean), (None, None), (2, dirty), (2, dirty), (3, clean)]
    kept = P.drop_benchmark_passages(spark, _odd_documents(spark, folder, rows), folder)
    assert _left(kept) == sorted([(1, clean), (1, clean), (None, clean), (None, None), (3, clean)], key=str)


def test_run_gives_the_same_pieces(spark, folder):
    rows = P.run(spark, folder)
    assert rows.columns == catalog.packed_pieces(spark.read.parquet(f"{folder}/documents.parquet")).columns and rows.count() > 0


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
