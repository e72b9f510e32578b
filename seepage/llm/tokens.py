"""Token ids of whole texts with the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut where its tokenizer is sure to cut, before white space that
follows something else, so the ids of a text are the ids of its pieces in
turn. Pieces repeat: Arrow parts many texts at once into their distinct
pieces, and the ids of those seen are kept, up to a bounded size.
A text with rarer white space or runs of it goes to the tokenizer whole.

The strings of special tokens in a text are ordinary text, as the vocabularies'
own notes have it: a document that quotes ``<|endoftext|>`` must not end there.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain, compress
from operator import not_
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than blank and line feed, as either library understands it.
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: Characters whose lower case depends on their neighbours, or that combine with the letter before.
_CASED = re.compile(r"[\u0130\u03a3\u0300-\u036f]")
#: A full stop or comma next to another mark, which the tokenizer may take together, or not right after a word.
_MARKED = re.compile(r"[.,](?:(?=[^\s\w]|_)|(?<=[\W_][.,]))")
#: Letters, then ASCII marks to the end.
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
#: Bytes that pieces may take in a worker, as estimated: their characters, and for each its ids and a place in a hash table.
KEPT_BYTES = 48 << 20
_OBJECTS = 40
#: Letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow at U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LETTERS = np.array([_BYTE_LETTERS.get(b, b) for b in range(256)], "<u2")
#: The letters for a blank and a line feed, and a token with one of them inside or with something after a line feed.
_BORDERS = "\u0120\u010a"
_ACROSS = re.compile(f"[^{_BORDERS}][{_BORDERS}]|\u010a[^\u010a]")
#: Words that go to the merges at once; strings beyond 256 letters are not looked up in the library's own cache.
_AT_ONCE = 128


def _with_room(held: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy of it that has room for ``size`` entries and for half as many again as before."""
    if size <= len(held):
        return held
    out = np.empty(max(size, len(held) * 3 // 2), held.dtype)
    out[: len(held)] = held
    return out


def _mixed(first: np.ndarray, ids: np.ndarray, sizes: np.ndarray, other_ids: np.ndarray, other_sizes: np.ndarray):
    """Ids and sizes of pieces of two sorts in one order; ``first`` tells which are of the first sort."""
    all_sizes = np.empty(len(first), np.int32)
    all_sizes[first], all_sizes[~first] = sizes, other_sizes
    own, out = np.repeat(first, all_sizes), np.empty(len(ids) + len(other_ids), ids.dtype)
    out[own], out[~own] = ids, other_ids
    return out, all_sizes


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word is among others, -1 if it is not."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)


class _Pieces:
    """Pieces of text, numbered in the order in which they came, and their ids end to end in that order."""

    def __init__(self, dtype: np.dtype):
        self.words = pa.array([], pa.large_string())
        self._ids, self._ends = np.empty(0, dtype), np.zeros(1, np.int32)

    def __len__(self) -> int:
        return len(self.words)

    def values(self) -> range:
        """The pieces' numbers."""
        return range(len(self))

    @property
    def ends(self) -> np.ndarray:
        return self._ends[: len(self) + 1]

    def add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New pieces with their ids."""
        n, at = len(self), int(self._ends[len(self)])
        self._ends, self._ids = _with_room(self._ends, n + 1 + len(sizes)), _with_room(self._ids, at + len(ids))
        self._ends[n + 1: n + 1 + len(sizes)] = at + np.cumsum(sizes, dtype=np.int32)
        self._ids[at: at + len(ids)] = ids
        self.words = pa.concat_arrays([self.words, words])

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self._ends[numbers + 1] - self._ends[numbers]

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of these numbers end to end, and where each of them ends."""
        ends, sizes = self._ends[numbers + 1], self.sizes(numbers)
        done = np.cumsum(sizes, dtype=np.int32)
        return self._ids[np.repeat(ends - done, sizes) + np.arange(done[-1], dtype=np.int32)], done


class Encoder:
    """Ids of texts as little-endian unsigned integers of ``dtype``.

    ``spaced``: the tokenizer keeps white space and joins one blank to the
    word after it (byte-level vocabularies). Otherwise it normalises texts,
    drops white space and marks where a word ends.
    """

    def __init__(self, path: str, spaced: bool, dtype: str = "<u4", kept: int = KEPT_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced, self.dtype, self.kept = spaced, np.dtype(dtype), kept
        size = self.model.get_vocab_size()
        if size > np.iinfo(self.dtype).max:
            raise ValueError(f"{path}: ids do not fit in {dtype}")
        self.bare = self._joins() if spaced else None
        self.held = 0
        self.known, self.before = _Pieces(self.dtype), _Pieces(self.dtype)
        self.marks: dict[str, list[int]] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.dtype).tobytes() for ids in self._whole(texts)]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _joins(self):
        """A tokenizer that takes words of letters end to end, each after its blank or line feed; None if the vocabulary forbids it.

        Words may be merged side by side if no token can hold a border between
        them: one with a blank or line feed inside, or letters after a line feed.
        Such tokens do no harm where what is left and right of it are no letters.
        ``begins`` tells which tokens begin with one of the two.
        """
        from tokenizers import Tokenizer

        byte_of = {v: k for k, v in _BYTE_LETTERS.items()}
        vocabulary = self.model.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.begins[k] = token[0] in _BORDERS
            if _ACROSS.search(token):
                try:
                    parts = [bytes(byte_of.get(ord(c), ord(c)) for c in x).decode() for x in re.split(f"[{_BORDERS}]", token) if x]
                except ValueError:  # part of a character
                    return None
                if any(x.isalpha() for x in parts):
                    return None
        return Tokenizer(self.model.model)

    def _learn(self, pieces: pa.Array) -> None:
        """Put pieces that are new into ``known``, with ids found now or kept in ``before``."""
        old = _places(pieces, self.before.words)
        seen = old >= 0
        if seen.any():
            ids, ends = self.before.of(old[seen])
            fresh = pieces.filter(pa.array(~seen)).to_pylist()
            found = _mixed(seen, ids, np.diff(ends, prepend=0), *self._found(fresh))
        else:
            found = self._found(pieces.to_pylist())
        self.known.add(pieces, *found)
        self.held += _OBJECTS * len(pieces) + pieces.nbytes

    def _found(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and how many each has."""
        if not self.bare:
            return self._singly(pieces)
        words = [p if p.isalpha() else p.rstrip(punctuation) for p in pieces]
        plain = [w.isalpha() or w[:1] == "\n" and w[1:].isalpha() for w in words]
        if not any(plain):
            return self._singly(pieces)
        others = list(compress(pieces, map(not_, plain)))
        return _mixed(np.array(plain), *self._side_by_side(list(compress(pieces, plain)), list(compress(words, plain))),
                      *self._singly(others))

    def _side_by_side(self, pieces: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that are a word of letters, after a blank or line feed, and maybe ASCII marks.

        Nothing cuts a word of letters, and it is surely cut before the marks,
        so words go to the merges as their bytes, in the letters that the
        vocabulary writes bytes with, many at once.
        """
        data = np.frombuffer("".join([w if w[0] == "\n" else " " + w for w in words]).encode(), np.uint8)
        letters = _LETTERS[data].tobytes().decode("utf-16-le")
        cuts = [*np.flatnonzero((data == 32) | (data == 10))[::_AT_ONCE].tolist(), len(letters)]
        ids = np.concatenate([np.array(self.bare.encode_batch_fast([letters[a:b]], add_special_tokens=False)[0].ids, self.dtype)
                              for a, b in zip(cuts, cuts[1:])])
        sizes = np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))
        marked = [i for i, (p, w) in enumerate(zip(pieces, words)) if len(p) > len(w)]
        if marked:
            marks = [self._mark(pieces[i][len(words[i]):]) for i in marked]
            more = np.fromiter(map(len, marks), np.int32, len(marks))
            ids = np.insert(ids, np.repeat(np.cumsum(sizes)[marked], more), list(chain.from_iterable(marks)))
            sizes[marked] += more
        return ids, sizes

    def _mark(self, mark: str) -> list[int]:
        """The ids of marks that follow a word."""
        if mark not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[mark] = self._whole([mark])[0]
        return self.marks[mark]

    def _singly(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces one by one.

        Nothing cuts a word of letters, so its bytes, in the letters that the
        vocabulary writes bytes with, go to the merges at once. Such a word is
        surely cut before the marks that end its piece.
        """
        spaced = self.spaced
        tokenize, blank = self.model.model.tokenize, "\u0120" if spaced else ""
        found, others = [], []
        for piece in pieces:
            word, mark = piece, ""
            if not piece.isalpha():
                parts = _WORD_AND_MARKS.fullmatch(piece)
                word, mark = parts.groups() if parts else ("", "")
            if word.isascii():
                letters = word
            elif word.isalpha() and (spaced or unicodedata.is_normalized("NFC", word)):
                letters = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            else:
                letters = ""
            if not letters:
                others.append(len(found))
                found.append([])
                continue
            ids = [t.id for t in tokenize(blank + letters)]
            if mark:
                ids += self._mark(mark)
            found.append(ids)
        for i, ids in zip(others, self._whole([self._source(pieces[i]) for i in others])):
            found[i] = ids
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())), sizes

    def parted(self, text: str) -> str | None:
        """The text's pieces with a blank between each two, or None if it has to be encoded whole.

        With ``spaced``, a piece marked by U+0001 stands for itself, one that
        begins a line starts with its line feed, and any other stands for a
        blank and itself. Full stops and commas right after letters or digits
        are pieces of their own, so words with and without them are one piece.
        Otherwise a piece may be empty; it has no ids.
        """
        if any(map(text.__contains__, _ODD_ASCII)) if text.isascii() else _ODD.search(text):
            return None
        split = not _MARKED.search(text) and text[:1] not in ".,"
        if not self.spaced:  # lower-casing by character, as the tokenizer does it, once no mark combines with a letter
            if not text.isascii() and _CASED.search(text):
                return None
            text = text.lower()
            return (text.replace(",", " , ").replace(".", " . ") if split else text).replace("\n", " ")
        if "  " in text or " \n" in text or "\n\n" in text or "\x01" in text:
            return None
        if split:
            text = text.replace(",", " \x01,").replace(".", " \x01.")
        return "\x01" + text.replace("\n", " \n")

    def _source(self, piece: str) -> str:
        if not self.spaced or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == "\x01" else " " + piece

    def _numbered(self, texts: list[str | None]) -> tuple[list[int], list[int], np.ndarray, list[int]]:
        """Which texts have pieces, how many each, all the pieces' numbers in turn, and which texts have to be encoded whole."""
        if 2 * self.held > self.kept:  # the younger half of the pieces stays
            self.before, self.known, self.held = self.known, _Pieces(self.dtype), 0
        at, some, odd = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            parted = self.parted(text)
            if parted is None:
                odd.append(i)
            else:
                at.append(i)
                some.append(parted)
        if not at:
            return [], [], np.empty(0, np.int32), odd
        sizes = [x.count(" ") + 1 for x in some]
        pieces = pc.split_pattern(pa.array([" ".join(some)], pa.large_string()), " ").values.dictionary_encode()
        numbers = _places(pieces.dictionary, self.known.words)
        new = numbers < 0
        if new.any():
            n = len(self.known)
            self._learn(pieces.dictionary.filter(pa.array(new)))
            numbers[new] = np.arange(n, len(self.known))
        return at, sizes, numbers[pieces.indices.to_numpy()], odd

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none of a null text."""
        out = [b""] * len(texts)
        at, sizes, numbers, odd = self._numbered(texts)
        if at:
            ids, done = self.known.of(numbers)
            cuts = [0, *done[np.cumsum(sizes) - 1].tolist()]
            for i, a, b in zip(at, cuts, cuts[1:]):
                out[i] = ids[a:b].tobytes()
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = ids
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """How many ids each text has."""
        out = [0] * len(texts)
        at, sizes, numbers, odd = self._numbered(texts)
        if at:
            for i, n in zip(at, np.add.reduceat(self.known.sizes(numbers), np.cumsum([0, *sizes[:-1]])).tolist()):
                out[i] = n
        for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = len(ids)
        return out


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool, dtype: str = "<u4", kept: int = KEPT_BYTES) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, spaced, dtype, kept)


def batches_of_texts(texts, most: int = 4_000_000):
    """Slices of a column of texts of about ``most`` characters, so that memory follows the texts, not the rows."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Return what earlier tasks of this worker freed to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
