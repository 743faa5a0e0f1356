import random

import numpy as np
import pytest
from conftest import order
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pleonasm.llm import bpe
from pleonasm.llm.catalog import byte_tokenizer


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokenizer())


@pytest.fixture(scope="module")
def coder():
    with open(byte_tokenizer(), encoding="utf-8") as opened:
        return bpe.Coder(opened.read())


def ids_of(coder, text):
    return coder.encode([text])[0].tolist()


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n  x", "Hello, world.", "don't WE'LL 'tis", "a" * 999, "  " * 40 + "x", "=" * 300, "été übung 漢字かな 한국", "🤦🏽‍♀️ é", "\x1c\x85 x　y", "𞓐 ꟊ \U0001e4d0", "x\x00y",
     "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext", " <|ENDOFTEXT|> 12345 6,7"],
)
def test_texts_encode_as_the_library_does(coder, library, text):
    assert ids_of(coder, text) == library.encode(text, add_special_tokens=False).ids
    ids = np.array(ids_of(coder, text), np.int64)
    assert coder.decode(ids, np.array([len(ids)])) == [library.decode(ids.tolist(), skip_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aaeeintrs theolLEé漢9.-='’\n\t "), max_size=40))
def test_any_text(text):
    from tokenizers import Tokenizer

    with open(byte_tokenizer(), encoding="utf-8") as opened:
        coder = bpe.Coder.of(opened.read())
    assert ids_of(coder, text) == Tokenizer.from_str(coder.file).encode(text, add_special_tokens=False).ids


def test_every_settled_character_is_cut_as_the_file_says(coder, library):
    settled = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and coder.settled.fullmatch(chr(c))]
    for c in settled:
        text = f"a{c}b 1{c}2 {c}{c} .{c}.  {c}\n{c}"
        assert coder.words.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_pairs_that_hold_are_those_merging_keeps_apart(coder):
    rng = random.Random(3)
    merges = coder.merges
    some = [i for i in range(merges.size - 1) if rng.random() < 0.08]
    left = np.array([rng.choice(some) for _ in range(20_000)])
    right = np.array([rng.choice(some) for _ in range(20_000)])
    kept = [merges.merge(merges.token_bytes[a] + merges.token_bytes[b]) == [a, b] for a, b in zip(left, right, strict=True)]
    assert merges.compatible(left, right).tolist() == kept and 0 < sum(kept) < len(kept)


def test_only_words_with_a_failing_pair_are_merged(coder):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 12))).encode() for _ in range(4000)]
    merged = []
    real = coder.merges.merge
    coder.merges.merge = lambda w: merged.append(w) or real(w)
    try:
        ids, lengths, failed = coder.merges.encode_words(words)
    finally:
        del coder.merges.merge
    assert failed == len(merged) and 0 < failed < len(words) / 2
    ends = np.cumsum(lengths)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [real(w) for w in words]


def test_a_long_word_without_spaces(coder, library):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefgh0123456789+/") for _ in range(120_000))
    assert ids_of(coder, word) == library.encode(word, add_special_tokens=False).ids


def test_a_full_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 10)
    with open(byte_tokenizer(), encoding="utf-8") as opened:
        small = bpe.Coder(opened.read())
    for i in range(20):
        text = f"words {i} of<|endoftext|> text {i * i}"
        assert ids_of(small, text) == library.encode(text, add_special_tokens=False).ids


def test_tokens_made_by_two_merges_are_merged_step_by_step():
    letters = {chr(b): b for b in range(33, 127)}
    names = {v: k for k, v in bpe.byte_letters().items()}
    vocabulary = {names[b]: b for b in range(256)} | {"ab": 256, "bc": 257, "abc": 258}
    file = {"model": {"type": "BPE", "vocab": vocabulary, "merges": [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]}, "added_tokens": [], "normalizer": None, "pre_tokenizer": dict(bpe.SPLITTER)}
    merges = bpe.Merges(file)
    assert letters and not merges.sound[258]
    assert merges.encode_words([b"abc", b"bcab"])[0].tolist() == [258, 257, 256]


def test_other_files_are_refused():
    file = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "normalizer": {"type": "NFC"}, "pre_tokenizer": dict(bpe.SPLITTER)}
    with pytest.raises(ValueError):
        bpe.Merges(file)


def test_edges(edges, edge_rows, library):
    encoded = bpe.encode_prompts(edges, byte_tokenizer())
    found = encoded.withColumn("text", bpe.decoded_text(F.col("ids"), byte_tokenizer(), encoded)).collect()
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in edge_rows]
    assert order((r.prompt_id, r.ids, r.text) for r in found) == order(expected)


def test_empty_table_and_odd_ids(spark, nothing):
    assert bpe.encode_prompts(nothing, byte_tokenizer()).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [31373, None, 10**9, -1, 995]), (4, [94])], "n int, ids array<int>")
    texts = {r.n: r.text for r in odd.select("n", bpe.decoded_text(F.col("ids"), byte_tokenizer(), odd).alias("text")).collect()}
    assert texts == {1: "", 2: "", 3: "hello world", 4: "�"}


def test_query_against_the_library(spark, folder, duck, library):
    import hashlib

    from pleonasm.llm.catalog import QUERIES

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    expected = []
    for i, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = QUERIES["op13_encode_prompts"](spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
