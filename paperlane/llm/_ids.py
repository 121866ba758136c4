"""Token ids of whole texts with the tokenizers library."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered per Python worker in each of two generations, none longer than LONGEST; only speed and memory depend on them.
WORDS_KEPT = 400_000
LONGEST = 64
#: Punctuation that ends a word is a piece of its own after a letter or digit.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])


def _taken(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of `data`, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])] if len(ends) else data[:0]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _strings(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = _starts(sizes).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(_taken(data, begins, sizes)))


def _listed(strings: pa.Array, before: str = "") -> list[str]:
    """The strings, none with a zero byte, as a list, each with `before` before it."""
    if not len(strings):
        return []
    return (before + pc.binary_join(pa.ListArray.from_arrays([0, len(strings)], strings), "\0" + before)[0].as_py()).split("\0")


def _without_marks(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words without the punctuation at their ends, and that. Only after letters and digits that all versions of Unicode know."""
    if not len(words):
        return words, words
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    begins, sizes = offsets[:-1], np.diff(offsets)
    stems = pc.binary_length(pc.ascii_rtrim(words, characters=MARKS)).to_numpy().astype(np.int64)
    at = np.flatnonzero((stems > 0) & (stems < sizes))
    last, lead = data[begins[at] + stems[at] - 1], data[np.maximum(begins[at] + stems[at] - 2, 0)]
    latin = (last >= 0x80) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    cut = sizes.copy()
    at = at[_ALNUM[last] | latin]
    cut[at] = stems[at]
    return _strings(data, begins, cut), _strings(data, begins + cut, sizes - cut)


class Encoder:
    """Ids of texts, equal to encoding each text as a whole.

    The byte-level pre-tokenizer always starts a new piece at a single space between two other
    characters, so a text without double spaces can be encoded word by word, each word of a batch once. Texts
    with double spaces or with the string of an added token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = self.tokenizer.pre_tokenizer
        self.by_word = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and kind.use_regex
        self.by_word &= self.tokenizer.normalizer is None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.narrow = max(vocabulary.values(), default=0) < 1 << 16  # ids fit two bytes
        self.width = np.dtype("<u2" if self.narrow else "<u4")
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of tokens that start with a space
        for token, i in vocabulary.items():
            self.spaced[i] = token.startswith("\u0120")

    def _fresh(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.width).tobytes() for e in found]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words that start with a space, many in one text: each space starts a word and a token."""
        found = []
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            ids = self._fresh(["".join(part)])[0]
            at = np.flatnonzero(self.spaced[np.frombuffer(ids, self.width)]) * self.width.itemsize
            if len(at) != len(part) or at[0] != 0:
                found += self._fresh(part)
                continue
            at = at.tolist()
            found += map(ids.__getitem__, map(slice, at, [*at[1:], len(ids)]))
        return found

    def _each(self, words: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct words; those not remembered by `encode`."""
        if len(self.known) > WORDS_KEPT:  # words met again come back from the older generation, others are forgotten with it
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, words))
        for source in (self.older, None):
            new = [i for i, ids in enumerate(out) if ids is None]
            missing = [words[i] for i in new]
            found = encode(missing) if source is None else map(source.get, missing)
            for i, word, ids in zip(new, missing, found):
                if ids is not None:
                    out[i] = ids
                    if len(word) <= LONGEST:
                        self.known[word] = ids
        return out

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, none null) in a row, and where each text's ids begin, with the end of the last."""
        if not self.by_word:
            each = self._fresh(texts.to_pylist())
            return np.frombuffer(b"".join(each), self.width), _starts(self._sizes(each))
        whole = np.zeros(len(texts), bool)
        for s in ("  ", "\0", *self.special):
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        first = words.offsets.to_numpy()[:-1].astype(np.int64)
        words = words.values
        inner = np.ones(len(words), bool)
        inner[first] = False
        words_of, firsts = words.filter(pa.array(inner)).dictionary_encode(), words.take(pa.array(first)).dictionary_encode()
        stems, marks = (x.dictionary_encode() for x in _without_marks(words_of.dictionary))
        each = self._each(_listed(stems.dictionary, " "), self._spaced)
        plain = len(each)
        each += self._each(_listed(marks.dictionary), self._fresh)
        # a word is its stem and its punctuation
        pieces = np.column_stack([stems.indices.to_numpy(), plain + marks.indices.to_numpy()]).astype(np.int64).ravel()
        sizes = self._sizes(each)
        ids = [_taken(np.frombuffer(b"".join(each), self.width), _starts(sizes)[pieces], sizes[pieces])]
        sizes = sizes[pieces].reshape(-1, 2).sum(1)
        # first words have no space before them; texts encoded whole stand in the place of theirs
        at = np.flatnonzero(whole)
        each = self._each(_listed(firsts.dictionary), self._fresh) + self._fresh(texts.take(pa.array(at)).to_pylist())
        ids.append(np.frombuffer(b"".join(each), self.width))
        begin = firsts.indices.to_numpy().astype(np.int64)
        begin[at] = len(firsts.dictionary) + np.arange(len(at))
        entry = np.empty(len(words), np.int64)
        entry[inner], entry[first] = words_of.indices.to_numpy(), len(sizes) + begin
        sizes = np.concatenate([sizes, self._sizes(each)])
        ids = _taken(np.concatenate(ids), _starts(sizes)[entry], sizes[entry])
        return ids, _starts(sizes[entry])[np.append(first, len(words))]

    def _sizes(self, each: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, each), np.int64, len(each)) // self.width.itemsize

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        if not texts:
            return []
        ids, bounds = self.encode_flat(pa.array(texts, pa.string()))
        ids, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 400, size: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """Batches in pieces of at most `rows` rows and, above one row, about `size` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
