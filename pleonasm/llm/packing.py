"""Packing of prompts into training sequences of a fixed capacity, balanced by attention cost."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Word pieces kept per Python worker; the cache is emptied when it is full.
CACHED_WORDS = 1_000_000


#: What `_parts` and the cache rely on: tokens end at a space, and nothing but a mark joins a mark.
_BY_WORDS = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _by_words(tokenizer) -> bool:
    """Whether the words of a text can be encoded one by one."""
    file = json.loads(tokenizer.to_str())
    plain = all(re.fullmatch(r"<\|\w+\|>", a["content"]) and not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in file["added_tokens"])
    return plain and all(file[k] == v for k, v in _BY_WORDS.items())


_FIRST = itemgetter(0)


class _Encoder:
    """Token ids of a text, word by word: where tokens never span a space or a line feed, words can be cached.

    A tokenizer file that normalises or splits in another way encodes whole texts.
    """

    _shared: dict[str, _Encoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task one core
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _by_words(self.tokenizer)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> _Encoder:
        """One per Python worker and file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.replace("\n", " ").split(" ")
        known = self.known
        ids = list(map(known.get, words))
        try:
            return b"".join(ids)
        except TypeError:  # a word is not known
            pass
        new = {w for w, found in zip(words, ids) if found is None}
        if len(known) + 2 * len(new) > CACHED_WORDS:
            known.clear()
        # The places of tokens are many short-lived tuples, and the collector would go through them again and again.
        collects = gc.isenabled()
        gc.disable()
        try:
            self._learn(new)
        finally:
            if collects:
                gc.enable()
        return b"".join([known[w] if found is None else found for w, found in zip(words, ids)])

    def _learn(self, new: set[str]) -> None:
        """Puts the ids of words into the cache; words that are a stem with a mark are put together from both."""
        known = self.known
        stems, parted = set(), []
        for word in new:
            stem, mark = _parts(word)
            if stem not in known:
                stems.add(stem)
            if mark or stem != word:
                parted.append((word, stem, mark))
        stems.update(mark for mark in (".", ",") if mark not in known)
        listed = list(stems)
        for at in range(0, len(listed), 500):
            known.update(self._encode_words(listed[at : at + 500]))
        for word, stem, mark in parted:
            known[word] = known[stem] + known[mark] if mark else known[stem]

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of many words by one call on the words in a row: the place of a token tells its word."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4").tobytes()
        starts = np.fromiter(map(_FIRST, found.offsets), np.int64, len(found))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        cuts = [0, *np.searchsorted(starts, ends).tolist()]
        return {word: ids[4 * a : 4 * b] for word, a, b in zip(words, cuts, cuts[1:], strict=False)}


def _parts(word: str) -> tuple[str, str]:
    """A word in the form its tokens depend on, and a mark at its end that is always a token of its own.

    Tokens do not tell upper from lower case, and never join an ASCII letter with a full stop or a comma. Other letters
    can end in a combining mark once they are normalised, and that joins the mark after it.
    """
    mark, before = "", word[-2:-1]
    if word[-1:] in (".", ",") and before.isascii() and before.isalpha():
        word, mark = word[:-1], word[-1]
    return (word.lower() if word.isascii() and "<" not in word else word), mark


class _Piece:
    __slots__ = ("prompt", "start", "ids", "total")

    def __init__(self, prompt, start: int, ids: bytes, total: int) -> None:
        self.prompt, self.start, self.ids, self.total = prompt, start, ids, total


def balance(lengths: list[int], sequences: int, capacity: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Assigns items, longest first, to the sequence of lowest cost that has room for them.

    An item no sequence can hold whole is cut: its next part fills the cheapest sequence with room.
    Returns per sequence the parts (item, start, length), and the parts (item, start) for which no room was left.
    """
    room = np.full(sequences, capacity)
    cost = np.zeros(sequences)
    parts: list[list[tuple[int, int, int]]] = [[] for _ in range(sequences)]
    over: list[tuple[int, int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            if not fits.any():
                over.append((item, start))
                break
            k = int(np.where(fits, cost, np.inf).argmin())
            take = min(left, int(room[k]))
            parts[k].append((item, start, take))
            room[k] -= take
            cost[k] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return parts, over


def pack_prompts(
    prompts: DataFrame,
    tokenizer: str,
    key: str = "prompt_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    cell_sequences: int = 512,
) -> DataFrame:
    """Packs the token ids of prompts into sequences of at most `capacity` tokens.

    Each prompt is its ids by the tokenizer file (no special tokens added), then `end_id`. Whole runs of `capacity`
    ids fill sequences of their own. What remains is packed in cells of `cell_sequences` sequences: the cost of a
    piece is `linear * n + quadratic * n * n` (attention does not cross prompts), and pieces go, longest first, to the
    sequence of lowest cost with room. A piece that fits nowhere is cut. What a full cell cannot hold opens the next
    one, so only the last sequences of an input partition are not full.

    Packing needs no shuffle: a task packs the rows of its own partition, cell by cell, in bounded memory, and a
    repeated task gives the same pieces.

    Returns one row per piece: `key`, start, length, ids (binary, little-endian unsigned 32 bit), prompt_tokens,
    sequence_id, offset. A null or empty text is the end id alone. Repeated rows are packed each for itself, null keys
    stay null, other columns are not read. An empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField(key, prompts.schema[key].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("prompt_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(tokenizer)
        next_sequence = TaskContext.get().partitionId() << 40
        waiting: list[_Piece] = []
        held = 0
        out: list[tuple] = []
        kind = None

        def cell(last: bool) -> None:
            nonlocal waiting, held, next_sequence
            sequences = -(-held // capacity) if last else held // capacity
            parts, over = balance([len(p.ids) // 4 for p in waiting], sequences, capacity, linear, quadratic)
            for sequence in parts:
                offset = 0
                for item, start, n in sequence:
                    p = waiting[item]
                    out.append((p.prompt, p.start + start, n, p.ids[4 * start : 4 * (start + n)], p.total, next_sequence, offset))
                    offset += n
                next_sequence += 1
            waiting = [_Piece(waiting[i].prompt, waiting[i].start + s, waiting[i].ids[4 * s :], waiting[i].total) for i, s in over]
            held = sum(len(p.ids) // 4 for p in waiting)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for prompt, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(value.as_py() or "") + end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    out.append((prompt, start, capacity, ids[4 * start : 4 * (start + capacity)], total, next_sequence, 0))
                    next_sequence += 1
                if whole < total:
                    waiting.append(_Piece(prompt, whole, ids[4 * whole :], total))
                    held += total - whole
                if held >= cell_sequences * capacity:
                    cell(last=False)
                if len(out) >= 2000:
                    yield flush()
        if waiting:
            cell(last=True)
        if out:
            yield flush()

    return prompts.select(key, text).mapInArrow(run, schema)
