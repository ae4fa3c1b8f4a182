"""Operator 10: SentencePiece encoding and decoding by a weighted transducer.

A model file is compiled once: the normaliser (white space becomes U+2581, a
prefix is put in front, runs are cut if the model says so), the lexicon (a trie
whose arcs end in pieces) and the byte fallback (a character that no piece
spells costs a penalty and comes out as its UTF-8 bytes). Composing it with an
input gives a lattice whose states are places in the text; the encoding is the
shortest path in the tropical semiring (weights add along a path, the least wins).

For a unigram model an arc weighs minus the piece's score. A BPE model's result
is not the path of least score sum: it is the one path on which each two
neighbouring pieces are what merging their own characters gives. There the
lexicon is composed with an acceptor of such pairs, whose state is the last
piece: an allowed pair weighs 0, any other is infinite, so the shortest path is
again the model's own result.

Characters that stand side by side inside no piece part the text into units
without changing the result; the paths of short units are kept in a cache.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cuts, ship

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
UNIGRAM, BPE = 1, 2
_CACHED, _SHORT = 200_000, 40


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < n:
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 5:
            yield number, struct.unpack_from("<f", data, i)[0]
            i += 4
        elif kind == 1:
            yield number, struct.unpack_from("<d", data, i)[0]
            i += 8
        elif kind == 2:
            size = varint()
            yield number, data[i : i + size]
            i += size
        else:
            raise ValueError("not a model file")


class Transducer:
    """Compiled model: ``encode(text)`` gives ids as little-endian bytes, ``decode`` undoes it."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normaliser.get(2) or trainer.get(24) or not normaliser.get(5, 1) or any(t == USER for _, _, t in pieces):
            raise ValueError("only unigram and BPE models with an identity character map are compiled")
        self.dummy, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.pieces = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, UNUSED)}
        self.scores = [s for _, s, _ in pieces]
        self.unused = {i for i, (_, _, t) in enumerate(pieces) if t == UNUSED}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unk = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
        usable = [p for p, i in self.pieces.items() if i not in self.unused]
        low = min((self.scores[self.pieces[p]] for p in usable), default=0.0)
        self.penalty = -(low - 10.0)
        self.longest = max(map(len, self.pieces), default=1)
        self.trie: dict = {}
        for p in usable:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.plain = not any(SPACE in p.lstrip(SPACE) for p in self.pieces) and not any("\n" in p for p in self.pieces)
        self.text_of = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.text_of[self.unk] = " ⁇ ".encode()
        self.allowed: dict[tuple[str, str], bool] = {}
        self.short: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    # -- normaliser ------------------------------------------------------------
    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.dummy:
            text = " " + text
        return text.replace(" ", SPACE)

    # -- acceptor of pairs (BPE) ----------------------------------------------
    def merge(self, text: str) -> list[str]:
        """Merging by score, the leftmost first: what the acceptor is built from."""
        parts, rank = list(text), self.pieces
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = rank.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, a: str, b: str) -> bool:
        ok = self.allowed.get((a, b))
        if ok is None:
            if len(self.allowed) >= 2 * _CACHED:
                self.allowed.clear()
            ok = self.allowed[a, b] = self.merge(a + b) == [a, b] if a else self.merge(b) == [b]
        return ok

    # -- lattice ----------------------------------------------------------------
    def _arcs(self, text: str, at: int) -> list[str]:
        """Pieces that begin here, the longest first; a character that none spells stands for itself."""
        out, node, end = [], self.trie, at
        while end < len(text) and (node := node.get(text[end])) is not None:
            end += 1
            if "" in node:
                out.append(node[""])
        if not out or len(out[0]) > 1:
            out.insert(0, text[at])
        out.reverse()
        return out

    def path(self, text: str) -> list[str]:
        """The shortest path's pieces."""
        if self.kind == BPE:
            return self._bigram_path(text)
        best = [(0.0, 0, "")] + [(math.inf, 0, "")] * len(text)
        for at in range(len(text)):
            base = best[at][0]
            for p in self._arcs(text, at):
                k = self.pieces.get(p)
                w = base + (self.penalty if k is None or k in self.unused else -self.scores[k])
                if w < best[at + len(p)][0]:
                    best[at + len(p)] = (w, at, p)
        out, at = [], len(text)
        while at:
            _, before, p = best[at]
            out.append(p)
            at = before
        return out[::-1]

    def _bigram_path(self, text: str) -> list[str]:
        """Least-weight-first search; all finite weights are 0, so the deepest state is taken next."""
        if len(text) <= 1:
            return [text] if text else []
        dead: set[tuple[int, str]] = set()
        stack = [(0, "", iter(self._arcs(text, 0)))]
        allowed, pair = self.allowed, self._pair
        while stack:
            at, last, arcs = stack[-1]
            for p in arcs:
                ok = allowed.get((last, p))
                if ok or (ok is None and pair(last, p)):
                    end = at + len(p)
                    if end == len(text):
                        return [s[1] for s in stack[1:]] + [p]
                    if (end, p) not in dead:
                        stack.append((end, p, iter(self._arcs(text, end))))
                        break
            else:
                dead.add((at, last))
                stack.pop()
        raise ValueError("no path")

    # -- units ------------------------------------------------------------------
    def _ids(self, pieces: list[str]) -> bytes:
        out = []
        for p in pieces:
            k = self.pieces.get(p)
            if k is not None and k not in self.unused:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return np.array(out, self.dtype).tobytes()

    def _short(self, text: str) -> bytes:
        got = self.short.get(text)
        if got is None:
            got = self._ids(self.path(text))
            if len(text) <= _SHORT:
                if len(self.short) >= _CACHED:
                    self.short.clear()
                self.short[text] = got
        return got

    def _unit(self, text: str) -> bytes:
        """Ids of a stretch: parted where no piece joins two characters."""
        if not self.bytes or self.kind == UNIGRAM:
            return self._short(text)
        out, start, joined = [], 0, self.joined
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joined:
                out.append(self._short(text[start:i]))
                start = i
        out.append(self._short(text[start:]))
        return b"".join(out)

    def _cached(self, text: str) -> bytes:
        got = self.units.get(text)
        if got is None:
            got = self._unit(text)
            if len(text) <= _SHORT:
                if len(self.units) >= _CACHED:
                    self.units.clear()
                self.units[text] = got
        return got

    def encode(self, text: str | None) -> bytes:
        text = self.normalise(text or "")
        if not text:
            return b""
        if not self.plain or not self.bytes:
            return self._unit(text)
        out, get, unit = [], self.units.get, self._cached
        lines = text.split("\n")
        newline = unit("\n") if len(lines) > 1 else b""
        for i, line in enumerate(lines):
            if i:
                out.append(newline)
            head, *rest = line.split(SPACE)
            if head:
                out.append(get(head) or unit(head))
            run = ""
            for chunk in rest:
                run += SPACE
                if chunk:
                    key = run + chunk
                    out.append(get(key) or unit(key))
                    run = ""
            if run:
                out.append(unit(run))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Pieces put together; bytes that aren't UTF-8 become U+FFFD; the dummy prefix goes."""
        text = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, self.dtype).tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _COMPILED:
        with open(path, "rb") as f:
            _COMPILED[path] = Transducer(f.read())
    return _COMPILED[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """Every row of ``docs`` with ``ids`` (array<int>), ``n_ids``, ``ids_crc32`` (of little-endian 32-bit ids) and ``round_trip``.

    round_trip says that decoding gives the text back; it doesn't where the text
    holds U+2581 or the model's normaliser changes it. A null text is encoded
    like an empty one: no ids, and round_trip is true. Whole texts are encoded,
    however long. Repeated rows get equal results, an empty table none; columns
    that clash with the four get replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("ids", "n_ids", "ids_crc32", "round_trip")
    names = docs.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in cuts(batches):
            ids, crc, same = [], [], []
            for text in batch["text"].to_pylist():
                got = t.encode(text)
                same.append(t.decode(got) == (text or ""))
                wide = np.frombuffer(got, t.dtype).astype("<i4")
                ids.append(wide)
                crc.append(zlib.crc32(wide.tobytes()))
            sizes = np.array([len(x) for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *new], [*names, "ids", "n_ids", "ids_crc32", "round_trip"])

    extra = {"ids": F.array().cast("array<int>"), "n_ids": F.lit(0).cast("long"), "ids_crc32": F.lit(0).cast("long"), "round_trip": F.lit(True)}
    schema = docs.withColumns(extra).schema
    for f in schema.fields:
        f.nullable = True
    return docs.mapInArrow(encode, schema)
