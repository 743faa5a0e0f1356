"""What the encoder of op7 spends on new words."""

import gc

import public_tokenizers

from pleonasm.llm.packing import _Encoder


def test_learning_words_does_not_run_the_collector():
    encoder = _Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"Word{n:x}, other{n:o}." for n in range(20000))
    runs = []
    note = lambda phase, info: runs.append(phase)
    gc.callbacks.append(note)
    try:
        ids = encoder.encode(text)
    finally:
        gc.callbacks.remove(note)
    assert gc.isenabled() and runs.count("start") < 10
    assert ids == encoder.encode(text)
    plain = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids == b"".join(n.to_bytes(4, "little") for n in plain)
