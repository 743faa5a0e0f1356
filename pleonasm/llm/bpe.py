"""Byte-pair encoding and decoding of prompts: tokens are guessed, checked pair by pair, and merged step by step only where the guess fails."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words, and ids of words, a Python worker remembers; when one is reached it starts anew.
KNOWN_WORDS, KNOWN_IDS = 300_000, 6_000_000
#: Bytes of text that are worked on at a time.
PART_BYTES = 1 << 20
NEVER = np.int64(1) << 40
_NO_MERGE = (1 << 40, -1)
SHORT_WORD = 40
_HEAD = 4

# How byte-level files cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Scripts and marks whose classes are the same in every version of Unicode; other texts are cut by the file's own splitter.
SETTLED = r"[\x00-ǿЀ-ҁҊ-ӿ‐-‧‰-⁞₠-₵←-⇿ぁ-ゖァ-ヺ一-龥가-힣]*"


def byte_letters() -> dict[str, int]:
    """The letter a vocabulary file writes for each byte: visible Latin-1 characters stand for themselves, the
    other bytes in order for the code points from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merges of a byte-level file as arrays by token id."""

    def __init__(self, file: dict) -> None:
        model, letters = file["model"], byte_letters()
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE file")
        if file.get("normalizer") or any((file.get("pre_tokenizer") or {}).get(k) != v for k, v in SPLITTER.items()):
            raise ValueError("only files that split at the byte level without a normaliser")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in file["added_tokens"]):
            raise ValueError("only added tokens that are taken literally")
        vocabulary = model["vocab"]
        self.added = {a["content"]: a["id"] for a in file["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.added.values()])
        self.token_bytes = [b""] * size
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.token_of = {self.token_bytes[i]: i for i in vocabulary.values() if i not in set(self.added.values())}
        self.byte_id = [self.token_of[bytes([b])] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        lefts = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        rights = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.size = size
        codes = lefts * size + rights
        self.merged = {int(c): (rank, int(t)) for rank, (c, t) in enumerate(zip(codes, made, strict=True))}
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        # What a token is made of, and by which merge; bytes by none.
        self.born = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.born[made], self.left[made], self.right[made] = np.arange(len(made)), lefts, rights
        self.sound = self._sound(lefts, rights, made)
        # By the first bytes of a token how long one gets that starts so.
        self.longest: dict[bytes, int] = {}
        for token in self.token_of:
            if len(token) >= _HEAD:
                head = token[:_HEAD]
                self.longest[head] = max(self.longest.get(head, 1), len(token))

    def _sound(self, lefts: np.ndarray, rights: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which tokens the merges really make out of their own bytes, so that a guess may use them.

        A token that two merges make, or one made before its parts, is never guessed.
        """
        once = np.bincount(made, minlength=self.size)[made] == 1
        grows = (self.born[lefts] < np.arange(len(made))) & (self.born[rights] < np.arange(len(made)))
        fits = once & grows & self.compatible(lefts, rights, apart=False)
        sound = np.zeros(self.size, bool)
        sound[self.byte_id] = True
        for rank in np.flatnonzero(fits).tolist():  # parts come before the whole
            sound[made[rank]] = sound[lefts[rank]] and sound[rights[rank]]
        return sound

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NEVER) if len(self.codes) else np.full(len(code), NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, apart: bool = True) -> np.ndarray:
        """Whether two tokens stay two tokens when their bytes stand side by side, for arrays of pairs.

        Merging is undone backwards at the border: of the two pieces that touch there the one made last falls into its
        parts. Two touching pieces merge across the border if their merge comes before the one that takes the left
        piece away, and not after the one that takes the right piece away (of equal merges the left one comes first).
        With `apart` false the two whole tokens may merge with each other.
        """
        fits = np.ones(len(left), bool)
        live = np.arange(len(left))
        l, r = left.copy(), right.copy()
        until_l, until_r = np.full(len(l), NEVER), np.full(len(r), NEVER)
        first = True
        while len(live):
            rank = self._rank(l, r)
            crossed = (rank < until_l) & (rank <= until_r)
            if first and not apart:
                crossed[:] = False
            first = False
            fits[live[crossed]] = False
            born_l, born_r = self.born[l], self.born[r]
            go = ~crossed & ((born_l >= 0) | (born_r >= 0))
            live, l, r, born_l, born_r, until_l, until_r = (x[go] for x in (live, l, r, born_l, born_r, until_l, until_r))
            undo = born_l > born_r
            l, until_l = np.where(undo, self.right[l], l), np.where(undo, born_l, until_l)
            r, until_r = np.where(undo, r, self.left[r]), np.where(undo, until_r, born_r)
        return fits

    def guess(self, word: bytes) -> list[int]:
        """Tokens of a word by taking the longest one every time."""
        whole = self.token_of.get(word)
        if whole is not None:
            return [whole]
        found, at, end = [], 0, len(word)
        longest, token_of = self.longest.get, self.token_of.get
        while at < end:
            step = min(longest(word[at : at + _HEAD], _HEAD - 1), end - at)
            while (token := token_of(word[at : at + step])) is None:
                step -= 1
            found.append(token)
            at += step
        return found

    def merge(self, word: bytes) -> list[int]:
        """Tokens of a word by the merges themselves, lowest rank first, the leftmost of equal ones first.

        Short words look at all their pairs every time, long ones keep the pairs in a heap.
        """
        ids = [self.byte_id[b] for b in word]
        return self._merge_short(ids) if len(ids) <= SHORT_WORD else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        merged, size = self.merged, self.size
        found = [merged.get(a * size + b, _NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is _NO_MERGE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = merged.get(ids[i - 1] * size + ids[i], _NO_MERGE)
            if i < len(found):
                found[i] = merged.get(ids[i] * size + ids[i + 1], _NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        merged, size = self.merged, self.size

        def offer(i: int, j: int) -> None:
            found = merged.get(ids[i] * size + ids[j])
            if found:
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        heap: list[tuple[int, int, int, int, int]] = []
        for i in range(end - 1):
            offer(i, i + 1)
        while heap:
            _, i, l, r, token = heapq.heappop(heap)
            j = after[i]
            if ids[i] != l or j >= end or ids[j] != r:
                continue
            ids[i], ids[j] = token, -1
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [t for t in ids if t >= 0]

    def encode_words(self, words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words in a row, the number of ids of each, and how many words the guess failed for."""
        guesses = [self.guess(w) for w in words]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        ids = np.fromiter(chain.from_iterable(guesses), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(guesses)), lengths)
        failed = np.zeros(len(guesses), bool)
        failed[owner[~self.sound[ids]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, place = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)
        failed[owner[inner[~fits[place]]]] = True
        wrong = np.flatnonzero(failed).tolist()
        if wrong:
            for i in wrong:
                guesses[i] = self.merge(words[i])
            lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
            ids = np.fromiter(chain.from_iterable(guesses), np.int64, int(lengths.sum()))
        return ids, lengths, len(wrong)


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of every row, in a row."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return pool[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Coder:
    """Encodes and decodes texts with one file, remembering the words it has met."""

    _shared: dict[int, Coder] = {}

    def __init__(self, file: str) -> None:
        self.merges = Merges(json.loads(file))
        self.file = file
        added = sorted(self.merges.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.words = regex.compile(WORD_PATTERN)
        self.settled = regex.compile(SETTLED)
        self._splitter = None
        self._start()
        parts = self.merges.token_bytes
        self.byte_lengths = np.array([len(p) for p in parts], np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.byte_pool = np.frombuffer(b"".join(parts), np.uint8)

    def _start(self) -> None:
        """Forgets all words; an added token is known under a key no word has."""
        tokens = self.merges.added
        self.known: dict = {(t,): i for i, t in enumerate(tokens)}
        self.pool = np.array(list(tokens.values()), np.int32)
        self.lengths = np.ones(len(tokens), np.int64)
        self.starts = np.arange(len(tokens), dtype=np.int64)

    @classmethod
    def of(cls, file: str) -> Coder:
        """One per Python worker and file."""
        mark = hash(file)
        if mark not in cls._shared:
            cls._shared[mark] = cls(file)
        return cls._shared[mark]

    def _split(self, text: str) -> list[str]:
        if self.settled.fullmatch(text):
            return self.words.findall(text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_str(self.file).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def split(self, text: str) -> list:
        """Words of a text; an added token is a tuple of its own."""
        if self.added is None or not self.added.search(text):
            return self._split(text)
        found: list = []
        for i, part in enumerate(self.added.split(text)):
            found.extend([(part,)] if i % 2 else self._split(part))
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        if len(self.known) > KNOWN_WORDS or len(self.pool) > KNOWN_IDS:
            self._start()
        split = [self.split(t) for t in texts]
        known = self.known
        new = list(set(chain.from_iterable(split)).difference(known))
        if new:
            ids, lengths, _ = self.merges.encode_words([w.encode() for w in new])
            known.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
        counts = np.fromiter(map(len, split), np.int64, len(split))
        slots = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        sizes = self.lengths[slots]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return _gather(self.pool, self.starts[slots], sizes), total[ends] - total[ends - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of rows of ids; an id the file does not have is skipped, broken UTF-8 is replaced."""
        known = (ids >= 0) & (ids < len(self.byte_lengths))
        ids = np.where(known, ids, 0)
        sizes = np.where(known, self.byte_lengths[ids], 0)
        data = _gather(self.byte_pool, self.byte_starts[ids], sizes).tobytes()
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        cuts = total[ends]
        firsts = total[ends - counts]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(firsts.tolist(), cuts.tolist(), strict=True)]


def _parts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` units each, one row at least."""
    total = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = int(total[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield at, stop
        at = stop


def encode_prompts(prompts: DataFrame, tokenizer: str, key: str = "prompt_id", text: str = "text") -> DataFrame:
    """Token ids of every whole prompt, those the file `tokenizer` gives without special tokens around a text.

    A text is cut at added tokens, which are one id each, and into words by the rule of byte-level files. Words a
    worker has not met are encoded many at a time: the longest token is taken again and again (the guess); then every
    pair of neighbours is checked, once for each different pair, by undoing merges at their border; where all pairs
    of a word hold, its guess is what merging gives. Only words with a pair that does not hold are merged step by
    step. Truncation and padding of the file are not used. The file is read here and sent to the tasks; it is of
    fixed size.

    Returns one row per input row: `key`, ids (array<int>). A null or empty text has no ids. Repeated rows are encoded
    each for itself, null keys are kept, other columns are not read, an empty table gives no rows. A word without end
    costs its length times the logarithm of it.
    """
    with open(tokenizer, encoding="utf-8") as opened:
        shared = prompts.sparkSession.sparkContext.broadcast(opened.read())
    source = prompts.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([source.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(shared.value)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in _parts(sizes, PART_BYTES):
                ids, counts = coder.encode(batch.column(1).slice(a, b - a).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["id", "ids"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", key)


def decoded_text(ids: Column, tokenizer: str, prompts: DataFrame) -> Column:
    """The text of a column of token ids, added tokens included.

    A null or empty array is an empty text; a null id and one the file does not have are skipped; bytes that are no
    UTF-8 are replaced.
    """
    with open(tokenizer, encoding="utf-8") as opened:
        shared = prompts.sparkSession.sparkContext.broadcast(opened.read())

    @F.arrow_udf(T.StringType())
    def decode(column: pa.Array) -> pa.Array:
        coder = Coder.of(shared.value)
        column = column.fill_null([]) if column.null_count else column
        counts = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        texts: list[str] = []
        for a, b in _parts(counts, PART_BYTES):
            texts.extend(coder.decode(ids[ends[a] - counts[a] : ends[b - 1]], counts[a:b]))
        return pa.array(texts, pa.string())

    return decode(ids.cast("array<int>"))
