"""Operator 7: benchmark decontamination as a prefix-filtered set join.

An item's windows (``window`` consecutive words) are the queries, documents are
searched for them. Shingles of ``shingle`` words are ordered by their count in
the documents; containment of a whole window needs its rarest shingle, so that
one shingle is the window's prefix. A document's shingle that is some window's
prefix makes a candidate; the shingle's place in the window bounds where the
window must begin and end in the document, and the words there are compared one
by one. The windows are cut into blocks of at most ``block_windows`` (the bound
of what is broadcast); every block meets all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cuts, drop, ship, written

#: Lower case for A-Z; what isn't a digit, a letter or beyond ASCII parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def _windows(seq: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not seq:
        return []
    return list({tuple(seq[i : i + window]): None for i in range(max(1, len(seq) - window + 1))})


def _shingles(seq, size: int) -> list[bytes]:
    """A shorter sequence has one shingle, itself."""
    size = min(size, len(seq))
    return [b" ".join(seq[i : i + size]) for i in range(len(seq) - size + 1)]


def _blocks(items: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[tuple[bytes, ...], list[str]]]]:
    """Different windows with the ids of their items, at most block_windows at a time on the driver."""
    block: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for r in items.toLocalIterator():
        for w in _windows(words(r["text"]), window):
            block[w].append(r["id"])
            if len(block) >= block_windows:
                yield list(block.items())
                block = defaultdict(list)
    if block:
        yield list(block.items())


def contaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 1, block_windows: int = 200_000) -> DataFrame:
    """Every row of ``docs`` with n_words, ``hits`` (spans [start, end) of word places, merged) and ``items`` (ids as strings, sorted).

    ``items`` needs item_id and text. An item of fewer words than ``window`` is
    one window; one without words, or with a null text, has none. An item whose
    id is null goes by the id "null". A document that is null or has no words has
    no hits. Repeated rows are searched each; an empty table of items leaves all
    documents clean; columns of ``docs`` that clash with the three get replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_words", "hits", "items")
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text").where(F.col("text").isNotNull())
    kept = docs.columns
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<struct<start:int,end:int>>"), "items": F.array().cast("array<string>")})
    paths: list[str] = []
    some = False
    for block in _blocks(items, window, block_windows):
        if some:  # what earlier blocks found travels with the rows
            out, path = written(out, "decontam")
            paths.append(path)
        out, some = _search(out, docs, block, shingle, kept), True
    if not some:
        out = _search(out, docs, [], shingle, kept)
    drop(spark, *paths[:-1])  # each was read to write the next
    return out


def _counts(docs: DataFrame, wanted: set[bytes], size: int) -> dict[bytes, int]:
    """How often the items' shingles stand in all documents: a row for each of them at most."""
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        total: Counter = Counter()
        for batch in cuts(batches):
            for text in batch["text"].to_pylist():
                seq = words(text)
                if size > 1:
                    seq = _shingles(seq, size)
                total.update(filter(known.value.__contains__, seq))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["s", "n"])

    sums = docs.select("text").mapInArrow(count, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {bytes(r["s"]): r["n"] for r in sums.collect()}


def _search(rows: DataFrame, docs: DataFrame, block: list, shingle: int, kept: list[str]) -> DataFrame:
    spark = rows.sparkSession
    size = min([shingle, *(len(w) for w, _ in block)])
    counts = _counts(docs, {s for w, _ in block for s in _shingles(w, size)}, size) if block else {}
    prefix: dict[bytes, list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]] = defaultdict(list)
    for w, ids in block:
        seq = _shingles(w, size)
        at = min(range(len(seq)), key=lambda i: (counts.get(seq[i], 0), seq[i], i))
        if counts.get(seq[at], 0):  # else it stands in no document
            prefix[seq[at]].append((at, w, tuple(ids)))
    known = spark.sparkContext.broadcast(dict(prefix))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known.value
        for batch in cuts(batches):
            n_words, hits, found = [], [], []
            for text, old_hits, old_items in zip(batch["text"].to_pylist(), batch["hits"].to_pylist(), batch["items"].to_pylist(), strict=True):
                seq = words(text)
                n_words.append(len(seq))
                spans, ids = [(h["start"], h["end"]) for h in old_hits], set(old_items)
                tokens = seq if size <= 1 else _shingles(seq, size)
                for p, token in enumerate(tokens):
                    if token in index:
                        for at, w, names in index[token]:
                            a = p - at
                            if a >= 0 and a + len(w) <= len(seq) and tuple(seq[a : a + len(w)]) == w:
                                spans.append((a, a + len(w)))
                                ids.update(names)
                hits.append(_merged(spans))
                found.append(sorted(ids))
            new = [
                pa.array(n_words, pa.int64()),
                pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(found, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *new], [*kept, "n_words", "hits", "items"])

    return rows.mapInArrow(search, rows.schema)


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out
