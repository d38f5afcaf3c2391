"""Token ids of whole texts for tokenizers that never join characters across white space.

Invented prose repeats its words, so a text is cut at ASCII white space, each distinct word is encoded
once by the tokenizers library, and documents are put together from the words' ids with numpy. This
equals encoding the whole text if the tokenizer lower-cases, drops white space and starts a new token after it and between
letters and ASCII marks behind them, as ``word_bpe_49k.json`` does; ``tests/llm`` compares both.

Words are kept and looked up as Arrow arrays. Words of letters alone that are new go to the library as one text: each of them
is one run of tokens, the last with the tokenizer's end of word. Where the ends do not count up to the words, and for all other
words, each word is encoded by itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridloom.llm.common import give_back

SLICE_BYTES = 4 << 20  # text encoded at a time: bounds the memory of a task
REMEMBERED_BYTES = 48 << 20  # words and their ids that a worker keeps between slices; others are encoded again
JOINED = 2_000  # new words in one call of the library
LETTERS_AND_MARKS = r"^(?P<letters>\p{L}+)(?P<marks>[!-/:-@\[-`{-~]+)$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known:
    """Words with their ids, and the number by which each is found again."""

    def __init__(self) -> None:
        """Only the empty word, which has no ids, is known."""
        self.words = pa.array([""])
        self.start, self.length = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def size(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.start.nbytes + self.length.nbytes

    def add(self, words: pa.Array, ids: np.ndarray, length: np.ndarray) -> None:
        start = len(self.ids) + np.cumsum(length, dtype=np.int64) - length
        self.words = pa.concat_arrays([self.words, words])
        self.start = np.concatenate([self.start, start.astype(np.int32)])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])


class WordEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self._tokenizer.get_vocab_size()
        suffix = json.loads(self._tokenizer.to_str())["model"].get("end_of_word_suffix")
        names = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(1 + max(names.values(), default=0), bool)
        if suffix:
            self._ends_word[[i for name, i in names.items() if name.endswith(suffix)]] = True
        self._remembered = remembered
        self._words, self._marks = _Known(), _Known()

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        found = [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(length.sum())), length

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone."""
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self._ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        return ids, np.diff(ends, prepend=0).astype(np.int32)

    def _learn(self, known: _Known, new: pa.Array) -> np.ndarray:
        """The numbers that the new words get."""
        first, plain = len(known.words), pc.utf8_is_alpha(new)
        letters, others = new.filter(plain), new.filter(pc.invert(plain))
        for k in range(0, len(letters), JOINED):
            part = letters.slice(k, JOINED)
            known.add(part, *self._joined(part.to_pylist()))
        if len(others):
            known.add(others, *self._each(others.to_pylist()))
        is_plain = plain.to_numpy(zero_copy_only=False)
        numbers = np.cumsum(is_plain) - 1
        numbers[~is_plain] = len(letters) + np.arange(len(others))
        return first + numbers

    def _numbers(self, known: _Known, words: pa.Array) -> np.ndarray:
        """Each word's number among the known ones; new words are learnt first."""
        coded = words.dictionary_encode()
        found = pc.index_in(coded.dictionary, known.words)
        number = pc.fill_null(found, 0).to_numpy().copy()
        if found.null_count:
            absent = pc.is_null(found)
            number[absent.to_numpy(zero_copy_only=False)] = self._learn(known, coded.dictionary.filter(absent))
        return number[coded.indices.to_numpy()]

    def _spelt(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and where each word's begin."""
        if self._words.size() + self._marks.size() > self._remembered:
            self._words, self._marks = _Known(), _Known()
        cut = pc.extract_regex(words, LETTERS_AND_MARKS)
        whole = pc.is_null(cut)
        letters = pc.if_else(whole, words, pc.struct_field(cut, "letters"))
        # Names of special tokens count as written, so only words of letters are lower-cased here.
        letters = pc.if_else(pc.utf8_is_alpha(letters), pc.ascii_lower(letters), letters)
        marks = pc.if_else(whole, "", pc.struct_field(cut, "marks"))
        mine, theirs = self._numbers(self._words, letters), self._numbers(self._marks, marks)
        # Words' ids first, marks' behind them, in one array.
        start, length = np.empty(2 * len(words), np.int64), np.empty(2 * len(words), np.int32)
        start[0::2], start[1::2] = self._words.start[mine], len(self._words.ids) + self._marks.start[theirs]
        length[0::2], length[1::2] = self._words.length[mine], self._marks.length[theirs]
        ids, begins = _gathered(np.concatenate([self._words.ids, self._marks.ids]), start, length)
        return ids, begins[::2]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        ends = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        spelt, begins = self._spelt(coded.dictionary)
        which = coded.indices.to_numpy()
        ids, behind = _gathered(spelt, begins[:-1].astype(np.int32)[which], np.diff(begins).astype(np.int32)[which])
        return ids, behind[ends - ends[0]]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of a slice of rows, offsets of its rows in them), slice after slice."""
        for first, part in slices(texts, SLICE_BYTES):
            ids, offsets = self._encode(part)
            yield first, ids, offsets
        give_back()


def _gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values one after another, and where each run begins, with the end behind the last."""
    begins = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=begins[1:])
    kind = np.int32 if begins[-1] < 1 << 31 else np.int64
    source = np.repeat((start - begins[:-1]).astype(kind), length)
    source += np.arange(begins[-1], dtype=kind)
    return values[source], begins


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first = total = 0
    for row, n in enumerate(size):
        if total and total + n > most:
            yield first, texts.slice(first, row - first)
            first, total = row, 0
        total += n
    if first < len(texts):
        yield first, texts.slice(first)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker; Spark uses a worker for many tasks."""
    return WordEncoder(path)
