"""Byte-level BPE encoding by the tokenizers library, with caches of words.

The library spends its time on merging; natural text repeats its words. A text
is cut where its pre-tokeniser must cut as well (a space or a newline between
two other characters), each piece is looked up, and only pieces not seen before
go to the library. Texts with any other white space, or with the opening of a
special token, go to the library whole. Results equal ``Tokenizer.encode``.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: White space that isn't one plain space or newline between two other
#: characters, or what may open a special token.
_ODD = (
    r"[ \n][ \n]|\A[ \n]|[ \n]\z|<|"
    r"[\t\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
#: Pattern of the byte-level pre-tokeniser (a fixed value of the tokenizer file format).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The byte-level alphabet of the file format: printable bytes stand for
#: themselves, the rest for the characters from U+0100 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b if b in _PRINTABLE else 256 + [x for x in range(256) if x not in _PRINTABLE].index(b) for b in range(256)}
_SPACE = chr(_ALPHABET[32])
#: Entries at which a cache is emptied: a bound of about 100 MB for each.
_CACHED = 500_000
#: Bytes of text that are worked on at a time.
SLICE = 16 << 20


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= _CACHED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """``ids(text)``: the ids as little-endian bytes, ``width`` bytes each."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.width = self.dtype.itemsize
        self.code = "H" if self.width == 2 else "I"
        pre = spec.get("pre_tokenizer") or {}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = (
            not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True)
            and all(t.startswith("<") for t in special)
        )
        self.model = self.tokenizer.model
        self.words = _Cache(self._word)
        self.heads = _Cache(self._head)
        self.rests = _Cache(lambda chunk: self._split(" " + chunk))
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """One word of the pre-tokeniser: the library's BPE model alone."""
        if word.isascii() and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            spelt = _SPACE + word[1:] if word[0] == " " else word  # letters stand for themselves
        else:
            spelt = word.encode("utf-8", "replace").decode("latin-1").translate(_ALPHABET)
        return array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _head(self, unit: str) -> bytes:
        return (self.newline if unit[0] == "\n" else b"") + self._split(unit[1:])

    def _split(self, piece: str) -> bytes:
        words = self.words
        if piece[1:].isalpha() and piece.isascii() and piece[0] == " ":
            return words[piece]  # one word: a space and letters
        found = _WORDS.findall(piece)
        return words[found[0]] if len(found) == 1 else b"".join([words[w] for w in found])

    def ids(self, text: str) -> bytes:
        """Ids of one text."""
        return next(iter(self.encode(pa.array([text or ""]))))[0].tobytes()

    def encode(self, texts: pa.Array, with_ids: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts, one after another; number of ids of each), in order, about SLICE bytes of text at a time.

        A null is an empty text. Ids are left empty if not asked for.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        start = 0
        while start < len(texts):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + SLICE)))
            yield self._slice(texts.slice(start, end - start), with_ids)
            start = end

    def _slice(self, texts: pa.Array, with_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.fast else pc.binary_length(texts).to_numpy() > 0
        plain = pc.if_else(pa.array(odd), "", texts)
        # A unit is a word and what hangs on it: "\r..." opens a text, "\n..." a line, any other comes after a space.
        marked = pc.binary_join_element_wise(pa.scalar("\r", pa.large_string()), pc.replace_substring(plain, "\n", " \n"), pa.scalar("", pa.large_string()))
        split = pc.split_pattern(marked, " ")
        units = split.values.dictionary_encode()
        index = units.indices.to_numpy()
        rests, heads = self.rests, self.heads
        found = [rests[u] if (c := u[:1]) != "\n" and c != "\r" else heads[u] for u in units.dictionary.to_pylist()]
        width = np.array(list(map(len, found)), np.int64) // self.width
        taken = width[index]
        bounds = split.offsets.to_numpy()
        ends = np.concatenate([[0], np.cumsum(taken)])
        lengths = ends[bounds[1:]] - ends[bounds[:-1]]
        ids = np.zeros(0, self.dtype)
        if with_ids:
            flat = np.frombuffer(b"".join(found), self.dtype)
            first = np.cumsum(width) - width
            place = np.repeat((first[index] - ends[:-1]).astype(np.int32), taken)
            place += np.arange(len(place), dtype=np.int32)
            ids = flat[place]
        if odd.any():
            whole = {i: np.frombuffer(self._whole(texts[i].as_py()), self.dtype) for i in np.flatnonzero(odd).tolist()}
            if with_ids:
                parts, at = [], 0
                for i, n in enumerate(lengths.tolist()):
                    parts.append(whole.get(i, ids[at : at + n]))
                    at += n
                ids = np.concatenate(parts)
            for i, x in whole.items():
                lengths[i] = len(x)
        return ids, lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: its caches outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
