"""Operator 3: near-duplicate documents by an LSH forest.

A document's set of word shingles gets ``VALUES`` minhash values. Each of
``TREES`` trees sorts the documents by its own order of those values, so that
documents with a long common prefix stand side by side. Candidates are the
documents of a region: a run that agrees in the first ``BASE`` values. Where a
run holds more than ``REGION`` documents the tree goes one value deeper there,
and so on to ``DEEP``; in a run that is still too large each document meets its
neighbour and the run's first one, which is only an opening: see below.
Sorting is by range over all trees, so a large group spreads over tasks.

Candidates that a two-bit sketch of all values rules out (beyond 5 standard
deviations) are dropped; the rest are confirmed on full shingle sets in two
phases. First every set meets its smallest candidate, which settles groups of
copies with one link each; then those candidates meet that lie in different
components so far. Equal sets are one node from the start, so exact copies cost
nothing.

At last the crowded regions (more than ``REGION`` documents that agree in the
first ``BASE`` values) that hold several components so far are compared whole:
all their pairs from different components, on full shingle sets. A region is
dealt out in blocks of about ``BLOCK`` documents and every two blocks are a
group of their own, so that a task never holds more than two. A component that
fills blocks of its own isn't compared with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cuts, drop, ship, written

TREES, BASE, DEEP, REGION = 24, 4, 12, 16
BLOCK = 512
VALUES = TREES * BASE
_rng = np.random.default_rng(3)
_MUL = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
#: Tree t starts with values of its own; deeper levels borrow from the other trees.
_ORDER = np.array([np.r_[t * BASE : (t + 1) * BASE, _rng.permutation(np.r_[0 : t * BASE, (t + 1) * BASE : VALUES])[: DEEP - BASE]] for t in range(TREES)])
_CACHED = 200_000
#: Rows of a few numbers up to which a side is broadcast.
_BROADCAST = 250_000
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``size`` make one."""
    seq = text.encode("utf-8", "replace").lower().split() if text else []
    if not seq:
        return np.zeros(0, np.uint64)
    if len(_words) > _CACHED:
        _words.clear()
    try:
        hashes = list(map(_words.__getitem__, seq))
    except KeyError:
        for w in seq:
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        hashes = list(map(_words.__getitem__, seq))
    h = np.array(hashes, np.uint64)
    width = min(size, len(seq))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(total)


def forget() -> None:
    """Give the word cache's memory back at a task's end: the worker may go on to other stages."""
    _words.clear()


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each minhash value."""
    best = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    for i in range(0, len(shingles), 2048):
        block = shingles[i : i + 2048]
        best = np.minimum(best, (_MUL[:, None] * block + _ADD[:, None]).min(axis=1))
    return (_mix(best) >> np.uint64(48)).astype(np.uint16)


def _label_regions(lcp: np.ndarray, lo: int, hi: int, depth: int) -> Iterator[tuple[int, int, bool]]:
    """Runs [lo, hi) of rows; the flag says that all their pairs are candidates."""
    stack = [(lo, hi, depth)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= REGION or depth >= DEEP:
            yield lo, hi, hi - lo <= REGION
            continue
        cuts = np.flatnonzero(lcp[lo + 1 : hi] < depth + 1) + lo + 1
        edges = [lo, *cuts.tolist(), hi]
        stack += [(a, b, depth + 1) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the two-bit values of two sketches agree."""
    d = x ^ y
    return VALUES - _POP[(d | (d >> 1)) & 0x55].sum(axis=-1, dtype=np.int32)


def _pairs(label: np.ndarray, sketch: np.ndarray, n: np.ndarray, node: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    same = np.cumprod(label[1:] == label[:-1], axis=1).sum(axis=1)
    lcp = np.concatenate([[0], same])
    starts = np.flatnonzero(lcp < BASE)
    ends = np.append(starts[1:], len(label))
    left, right = [], []
    long = ends - starts > 1
    for lo, hi in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        for a, b, every in _label_regions(lcp, lo, hi, BASE):
            if every:
                i, j = np.triu_indices(b - a, 1)
                left.append(i + a)
                right.append(j + a)
            else:
                at = np.arange(a + 1, b)
                left += [at - 1, np.full(b - a - 1, a)]
                right += [at, at]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    share = num / den
    expected = share + (1 - share) / 4  # two bits agree by chance as well
    least = VALUES * expected - 5 * np.sqrt(VALUES * expected * (1 - expected))
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    ok = (node[i] != node[j]) & (small * den >= large * num) & (_agreement(sketch[i], sketch[j]) >= least)
    i, j = node[i[ok]], node[j[ok]]
    return np.minimum(i, j), np.maximum(i, j)


def _crowded(sets: DataFrame, roots: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int, num: int, den: int) -> tuple[DataFrame, str]:
    """Links (a, b) between the components of ``roots`` in crowded regions, from all pairs there."""
    spark = sets.sparkSession

    def bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint16).reshape(-1, VALUES)
            base = np.ascontiguousarray(sig).view(np.int64)  # BASE values of 16 bits for each tree
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(base[:, t]), batch["node"]], ["tree", "base", "node"])

    def side(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if small.count() <= _BROADCAST else small

    at = ["tree", "base"]
    spots = sets.select("sig", "node").mapInArrow(bases, "tree int, base long, node long")
    crowds, crowds_path = written(spots.groupBy(*at).count().where(F.col("count") > REGION).select(*at), "crowds")
    members = spots.join(side(crowds), at).join(roots, "node", "left").select(*at, "node", F.coalesce("root", "node").alias("root"))
    members, members_path = written(members, "members")
    unsettled, unsettled_path = written(members.groupBy(*at).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*at), "unsettled")
    rows, rows_path = written(members.join(side(unsettled), at), "rows")

    # Blocks of a region: large components have their own, the others share some.
    parts = rows.groupBy(*at, "root").count()
    large, large_path = written(parts.where(F.col("count") > BLOCK).select(*at, "root", F.col("root").alias("own")), "large")
    own = rows.join(side(large), [*at, "root"], "left")
    cells = own.groupBy(*at, "own").count().withColumn("salts", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    cells, cells_path = written(cells, "cells")
    block = F.xxhash64(*at, F.coalesce("own", F.lit(0)), F.col("own").isNull(), "salt").alias("block")
    blocks = cells.select(*at, "own", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(*at, "own", block)
    other = blocks.select(*at, F.col("own").alias("own2"), F.col("block").alias("block2"))
    meets = blocks.join(other, at).where("block <= block2 AND (own IS NULL OR own2 IS NULL OR own <> own2)").select("block", "block2", F.xxhash64("block", "block2").alias("task"))
    sides = meets.select("block", "task", F.lit(0).alias("side")).unionByName(meets.where("block <> block2").select(F.col("block2").alias("block"), "task", F.lit(1).alias("side")))
    sides, sides_path = written(sides, "sides")
    met = F.col("own").eqNullSafe(F.col("own2"))
    dealt = own.join(side(cells.toDF("tree", "base", "own2", "salts")), at).where(met)
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("node", "tree"), "salts").cast("int")).select("tree", "node", "root", block)
    dealt = dealt.join(side(sides), "block").drop("block")
    seen = rows.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1, tree)")).alias("seen"))
    held = seen.join(sets.select("node", "sig"), "node").join(texts_of(rows.select("node").distinct()), "node")
    held, held_path = written(held, "held")

    def compare(group: pa.Table) -> pa.Table:
        left, right = _across(group, shingle, num, den)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    links = dealt.join(held, "node").groupBy("task").applyInArrow(compare, "a long, b long").distinct()
    links, links_path = written(links, "links")
    drop(spark, crowds_path, members_path, unsettled_path, rows_path, large_path, cells_path, sides_path, held_path)
    return links, links_path


def _across(group: pa.Table, shingle: int, num: int, den: int) -> tuple[list[int], list[int]]:
    """Enough of the links between rows with different roots to join all that their links join.

    Pairs across the two sides, or all if there is one. Pairs that share an
    earlier crowded region have been met there.
    """
    tree, n = group["tree"][0].as_py(), group.num_rows
    order = np.argsort(group["side"].to_numpy(), kind="stable")
    group = group.take(pa.array(order))
    node, label, seen = (group[c].to_numpy() for c in ("node", "root", "seen"))
    label = np.unique(label, return_inverse=True)[1]
    sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(n, VALUES)
    first = int((group["side"].to_numpy() == 0).sum())
    share = num / den
    least = VALUES * share - 5 * np.sqrt(VALUES * share * (1 - share))
    earlier = (seen[:, None] >> np.arange(tree)) & 1 == 1
    flat = size = None
    left, right = [], []
    for i in range(first):
        j = np.arange(first if first < n else i + 1, n)
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        same = sig[j] == sig[i]
        ok = same.sum(axis=1) >= least
        j, same = j[ok], same[ok]
        if tree and len(j):
            j = j[~(same[:, : tree * BASE].reshape(len(j), tree, BASE).all(axis=2) & earlier[i]).any(axis=1)]
        if not len(j):
            continue
        if flat is None:
            sets = [shingle_set(t, shingle) for t in group["text"].to_pylist()]
            size = np.array([len(s) for s in sets])
            flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
            ends = np.concatenate([[0], np.cumsum(size)])
            mark = np.zeros(int(flat.max()) + 1, np.int32)
            forget()
        mark[flat[ends[i] : ends[i + 1]]] = 1
        both = np.add.reduceat(mark[flat], ends[:-1])[j]
        mark[flat[ends[i] : ends[i + 1]]] = 0
        j = j[den * both >= num * (size[i] + size[j] - both)]
        found, at = np.unique(label[j], return_index=True)
        left += [int(node[i])] * len(found)
        right += node[j[at]].tolist()
        label[np.isin(label, found)] = label[i]
    return left, right


def near_duplicates(docs: DataFrame, shingle: int = 3, num: int = 85, den: int = 100, rows: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept; with ``rows`` also tid and stays.

    Two documents are linked if den * |intersection| >= num * |union| of their
    shingle sets; component_id is the least doc_id that links reach. A null or
    empty text, or one without words, has no shingles and is linked with
    nothing. Repeated rows are copies like any other (rows that agree in doc_id
    get the same kept). A null doc_id takes part but never names a component; a
    component of such rows alone has a null component_id and they are kept. An
    empty table gives no rows; other columns aren't read.

    tid is the text's xxhash64. stays is true for the rows of one (doc_id, text)
    of each component (the least doc_id, nulls last, then tid) and for rows
    without shingles, so that doc_ids that are null or shared lose no text.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tid", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            n, node, sig = [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text, shingle)
                n.append(len(s))
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tid"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "tid", "n", "node", "sig"])
        forget()

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tid")
    signed, signed_path = written(docs.mapInArrow(sign, "doc_id long, tid long, n long, node long, sig binary"), "signatures")
    sets = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first(F.struct("doc_id", "tid")).alias("row"), F.min(place).alias("head"))
    sets, sets_path = written(sets, "sets")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint16).reshape(-1, VALUES)
            two = (sig & 3).astype(np.uint8).reshape(len(sig), -1, 4)
            sketch = np.ascontiguousarray(two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6)
            for t in range(TREES):
                label = sig[:, _ORDER[t]].astype(">u2")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), _fixed(label), _fixed(sketch), batch["n"], batch["node"]], ["tree", "label", "sketch", "n", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            # The last rows wait: their region may go on in the next batch.
            yield from _met(rows)
            rest = rows.slice(max(0, rows.num_rows - REGION))

    def _met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        if rows.num_rows < 2:
            return
        tree = rows["tree"].to_numpy().astype(np.uint16)
        label = np.frombuffer(b"".join(rows["label"].to_pylist()), ">u2").reshape(-1, DEEP).astype(np.uint16)
        label = np.column_stack([tree, label])
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(tree), -1)
        bounds = np.flatnonzero(np.diff(tree)) + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(tree)], strict=True):
            i, j = _pairs(label[a:b, 1:], sketch[a:b], rows["n"].to_numpy()[a:b], rows["node"].to_numpy()[a:b], num, den)
            if len(i):
                both = np.unique(np.column_stack([i, j]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    trees = sets.select("sig", "n", "node").mapInArrow(plant, "tree int, label binary, sketch binary, n long, node long")
    trees = trees.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    pairs, pairs_path = written(trees.mapInArrow(meet, "a long, b long").distinct(), "pairs")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """One text of each node."""
        rows = nodes.join(sets.select("node", "row.*"), "node").toDF("node", "id", "t")
        hit = docs.join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tid") == F.col("t")))
        return hit.groupBy("node").agg(F.first("text").alias("text"))

    # Texts of the sets that have a candidate, one of each.
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts, texts_path = written(texts_of(wanted), "texts")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            ok = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                s, t = shingle_set(x, shingle), shingle_set(y, shingle)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(den * both >= num * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        forget()

    def confirmed(some: DataFrame, what: str) -> tuple[DataFrame, str]:
        x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
        y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
        return written(some.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long"), what)

    first, first_path = confirmed(pairs.groupBy("b").agg(F.min("a").alias("a")), "links")
    roots, roots_path = components(first)
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    apart = pairs.join(ra, "a", "left").join(rb, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    second, second_path = confirmed(apart, "links")
    held, held_path = components(second.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    third, third_path = _crowded(sets, held, texts_of, shingle, num, den)
    final, final_path = components(third.unionByName(held.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = sets.select("node", "least", "head").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.join(named.groupBy("root").agg(F.min("least").alias("component_id"), F.min("head").alias("first")), "root").select("node", "component_id", "first")
    names, _ = written(names, "names")
    drop(spark, sets_path, pairs_path, texts_path, first_path, second_path, roots_path, held_path, third_path, final_path)
    out = signed.select("doc_id", "tid", F.col("n").alias("n_shingles"), "node").join(names, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    more = ["tid", ((F.col("n_shingles") == 0) | (place == F.col("first"))).alias("stays")] if rows else []
    kept = F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept, *more)


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    size = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
