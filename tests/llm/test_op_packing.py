import zlib

import numpy as np
import pytest
from conftest import order  # noqa: F401

from pleonasm.llm.catalog import word_tokenizer
from pleonasm.llm.packing import _Encoder, balance, pack_prompts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


@pytest.mark.parametrize(
    "text",
    ["", "Hello, world.", "a.. b., ,. . A.B. x.", "<|endoftext|> X<|ENDOFTEXT|>.", "don't We'LL İI ß Σ. ΟΔΟΣ", "\x1c\x85  a\tb\x0bc", "a ́b", "12345 6,7."],
)
def test_words_encode_as_the_whole_text(tokenizer, text):
    found = np.frombuffer(_Encoder(word_tokenizer()).encode(text), "<u4").tolist()
    assert found == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letter", ["\u0130", "\u095c", "\u095d", "\ufb2a", "TAK\u0130", "\u00e9", "e\u0301"])
@pytest.mark.parametrize("mark", [".", ","])
def test_letters_that_end_in_a_combining_mark_keep_what_follows(tokenizer, letter, mark):
    for text in (letter + mark, f"x {letter}{mark} x {letter}"):
        found = np.frombuffer(_Encoder(word_tokenizer()).encode(text), "<u4").tolist()
        assert found == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_letter_before_a_mark(tokenizer):
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    words = [c + mark for c in letters for mark in ".,"]
    encoder, cut = _Encoder(word_tokenizer()), 2000
    for at in range(0, len(words), cut):
        text = " ".join(words[at : at + cut])
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_file_with_another_normalizer_encodes_whole_texts(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(word_tokenizer())
    other.normalizer = normalizers.Sequence([normalizers.Replace("a b", "ab"), normalizers.NFC()])
    other.save(path := str(tmp_path / "other.json"))
    for text in ("a b c", "Word word. WORD.", "", "x a\nb"):
        found = np.frombuffer(_Encoder(path).encode(text), "<u4").tolist()
        assert found == other.encode(text, add_special_tokens=False).ids


def test_balance_is_complete_and_evens_costs():
    lengths = [900, 700, 700, 300, 300, 100, 96, 1000]
    parts, over = balance(lengths, 2, 2048, 1.0, 1 / 2048)
    assert over == []
    assert sum(n for s in parts for _, _, n in s) == sum(lengths)
    costs = [sum(n + n * n / 2048 for _, _, n in s) for s in parts]
    assert abs(costs[0] - costs[1]) < 0.1 * sum(costs)


def test_balance_cuts_what_fits_nowhere_and_returns_the_rest():
    parts, over = balance([2048, 2048, 10], 2, 2048, 1.0, 0.1)
    assert over == [(2, 0)]
    parts, over = balance([1500, 1500, 1000], 2, 2048, 1.0, 0.1)
    assert over == []
    assert sorted(n for s in parts for i, _, n in s if i == 2) == [452, 548]


def check_pieces(rows, texts, tokenizer, capacity):
    expected = {}
    for key, text in texts:
        expected.setdefault((key, len(expected) if key is None else 0), []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    all_ids = sorted(tuple(v) for vs in expected.values() for v in vs)
    assert sum(r.length for r in rows) == sum(map(len, all_ids))
    sequences = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= capacity
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_each_id_lies_in_one_piece(edges, edge_rows, tokenizer):
    rows = pack_prompts(edges, word_tokenizer(), cell_sequences=2).collect()
    sequences = check_pieces(rows, edge_rows, tokenizer, 2048)
    short = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(n < 2048 for n in short) <= 3  # one for each partition
    for key, text in edge_rows:
        if key in (8, None):
            continue
        pieces = sorted((r.start, r.ids) for r in rows if r.prompt_id == key)
        ids = b"".join(p for _, p in pieces)
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert {r.prompt_tokens for r in rows if r.prompt_id == key} == {len(ids) // 4}


def test_empty_table(nothing):
    assert pack_prompts(nothing, word_tokenizer()).count() == 0


def test_query_against_whole_documents(spark, duck, folder, tokenizer):
    from pleonasm.llm.catalog import QUERIES

    rows = QUERIES["op7_pack_prompts"](spark, folder).collect()
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in texts}
    seen = dict.fromkeys(ids, 0)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {d: len(v) for d, v in ids.items()}
    total = sum(map(len, ids.values()))
    assert len({r.sequence_id for r in rows}) == -(-total // 2048)
