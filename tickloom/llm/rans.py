"""Operator 2: token ids in a binary format with static range asymmetric numeral systems.

One frequency table, counted over all documents, serves every block. A block
holds whole documents in ascending order; its ids are dealt over ``lanes``
interleaved rANS states that share one stream of 32-bit words. Every
``CHECKPOINT`` steps the block lists the lanes' states and the place in the
stream, so that decoding may start there; each stretch between checkpoints has a
crc32. Blocks are rows of a Parquet table: Spark's commit protocol makes a lost
executor's blocks appear once, and any block decodes by itself with the
frequency table that stands beside them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import cuts, drop, shared_dir, ship, written

SCALE = 20  # bits of the frequency table's total
LOW = np.uint64(1 << 31)  # states are at least this
CHECKPOINT = 256  # steps between checkpoints
LANES = 512
BLOCK_IDS = 1 << 18
MAGIC = b"TLR1"
_HEAD = struct.Struct("<4sIIQII")  # magic, lanes, checkpoints, ids, words, crc32 of the table


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that add up to 2**scale; every id of the vocabulary keeps at least 1."""
    total = 1 << scale
    if len(counts) > total:
        raise ValueError("the vocabulary is larger than the table's total")
    counts = np.asarray(counts, np.float64) + 1e-9
    freq = np.maximum(1, np.floor(counts * (total - len(counts)) / counts.sum())).astype(np.int64)
    while (over := int(freq.sum()) - total) != 0:
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        else:
            room = freq[order] - 1
            take = np.minimum(room, np.maximum(0, over - np.concatenate([[0], np.cumsum(room)[:-1]])))
            freq[order] -= take
    return freq


class Table:
    """Frequencies, their sums before each id, and the id of every slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.scale = int(self.freq.sum()).bit_length() - 1
        self.most = self.freq << np.uint64(63 - self.scale)
        self.crc = zlib.crc32(np.asarray(freq, "<u4").tobytes())
        self.fill = int(np.argmax(self.freq))
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """Header; for each checkpoint its crc32, place and states; the words."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, table.fill, np.int64)
    padded[:n] = ids
    padded = padded.reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    scale, low32, shift = np.uint64(table.scale), np.uint64(0xFFFFFFFF), np.uint64(32)
    words: list[np.ndarray] = []
    states: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        s = padded[t]
        f = table.freq[s]
        over = x >= table.most[s]
        words.append((x[over] & low32).astype("<u4"))
        x = np.where(over, x >> shift, x)
        q = x // f
        x = (q << scale) + (x - q * f) + table.cum[s]
        if t % every == 0:
            states.append(x)
    words.reverse()
    states.reverse()
    places = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    stream = np.concatenate(words).tobytes() if words else b""
    out = [_HEAD.pack(MAGIC, lanes, len(states), n, len(stream) // 4, table.crc)]
    for i, state in enumerate(states):
        a, b = int(places[i * every]), int(places[min(steps, (i + 1) * every)])
        head = state.astype("<u8").tobytes()
        out.append(struct.pack("<IQ", zlib.crc32(stream[4 * a : 4 * b], zlib.crc32(head)), a) + head)
    return b"".join(out) + stream


def decode_block(data: bytes, table: Table, every: int = CHECKPOINT, stretches: range | None = None) -> np.ndarray:
    """The ids of a block, or those of some of its stretches between checkpoints."""
    magic, lanes, n_points, n, n_words, crc = _HEAD.unpack_from(data)
    if magic != MAGIC or crc != table.crc:
        raise ValueError("not a block of this frequency table")
    size = 12 + 8 * lanes
    base = _HEAD.size + n_points * size
    points = [struct.unpack_from("<IQ", data, _HEAD.size + i * size) for i in range(n_points)]
    steps = -(-n // lanes) if n else 0
    mask, scale, shift = np.uint64((1 << table.scale) - 1), np.uint64(table.scale), np.uint64(32)
    slots, out = table.slots, []
    for i in range(n_points) if stretches is None else stretches:
        at = _HEAD.size + i * size + 12
        head = data[at : at + 8 * lanes]
        a = points[i][1]
        b = points[i + 1][1] if i + 1 < n_points else n_words
        body = data[base + 4 * a : base + 4 * b]
        if zlib.crc32(body, zlib.crc32(head)) != points[i][0]:
            raise ValueError(f"stretch {i} of a block is damaged")
        words = np.frombuffer(body, "<u4").astype(np.uint64)
        x, k = np.frombuffer(head, "<u8").astype(np.uint64), 0
        for _ in range(i * every, min(steps, (i + 1) * every)):
            slot = x & mask
            s = slots[slot]
            out.append(s)
            x = table.freq[s] * (x >> scale) + slot - table.cum[s]
            low = x < LOW
            if m := int(np.count_nonzero(low)):
                x[low] = (x[low] << shift) | words[k : k + m]
                k += m
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    first = 0 if stretches is None else stretches.start * every * lanes
    return ids[: max(0, n - first)]


_BLOCK = "part int, at long, doc_ids array<long>, lengths array<long>, ids binary"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encode, sort by doc_id and write the format. Returns the path, which is all that ``read_tokens`` needs.

    Without a ``path`` the files are put in the shared folder, until the driver
    ends. A path holds three Parquet tables: ``table`` (id, freq: the frequency
    table), ``parts`` (part, n, start: the ids of each part of the files and
    those before it) and ``blocks`` (part, at, doc_ids, lengths, block).

    A null text is empty: it gets the end id alone. Rows with a null doc_id come
    first; rows that agree in doc_id are ordered by a hash of the text, equal
    ones are alike. An empty table makes no blocks. Other columns aren't read.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        at = 0
        names, lengths, ids, held = [], [], [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([at], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([b"".join(ids)], pa.binary()),
                ],
                ["part", "at", "doc_ids", "lengths", "ids"],
            )

        for batch in batches:
            doc_ids = iter(batch["doc_id"].to_pylist())
            for got, sizes in enc.encode(batch["text"]):
                begin = 0
                for n in sizes.tolist():
                    names.append(next(doc_ids))
                    lengths.append(n + 1)
                    ids += (got[begin : begin + n].tobytes(), end)
                    begin += n
                    held += n + 1
                    if held >= BLOCK_IDS:
                        yield block()
                        at += held
                        names, lengths, ids, held = [], [], [], 0
        if names:
            yield block()

    tokens, tokens_path = written(rows.select("doc_id", "text").mapInArrow(tokenise, _BLOCK), "tokens")
    enc = encoder(tokenizer)
    vocab, dtype = max(enc.vocab_size, end_id + 1), enc.dtype

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for x in batch["ids"]:
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=vocab)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    # One row for each id of the vocabulary at most.
    counted = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocab, np.int64)
    for r in counted.collect():
        counts[r["id"]] = r["n"]
    freq = quantise(counts)
    shared = spark.sparkContext.broadcast(freq)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in cuts(batches, 16):  # a row is a whole block
            out = [encode_block(np.frombuffer(x.as_buffer(), dtype), table) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays(
                [batch["part"], batch["at"], batch["doc_ids"], batch["lengths"], pa.array(out, pa.binary())],
                ["part", "at", "doc_ids", "lengths", "block"],
            )

    packed = tokens.mapInArrow(pack, _BLOCK.replace("ids binary", "block binary"))
    packed.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    # A row for each id of the vocabulary, and one for each partition of the writing stage.
    spark.createDataFrame(pd.DataFrame({"id": np.arange(vocab), "freq": freq})).coalesce(1).write.parquet(f"{path}/table")
    sums = tokens.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    parts = pd.DataFrame(sorted((r["part"], r["n"]) for r in sums), columns=["part", "n"]).astype("int64")
    parts["start"] = parts["n"].cumsum() - parts["n"]
    spark.createDataFrame(parts, "part long, n long, start long").coalesce(1).write.parquet(f"{path}/parts")
    drop(spark, tokens_path)
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids. Nothing but the path is needed."""
    ship(spark)
    freq = [r["freq"] for r in spark.read.parquet(f"{path}/table").orderBy("id").collect()]  # the vocabulary's size
    starts = spark.sparkContext.broadcast({r["part"]: r["start"] for r in spark.read.parquet(f"{path}/parts").collect()})
    shared = spark.sparkContext.broadcast(np.array(freq, np.int64))
    tables: list[Table] = []

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(Table(shared.value))
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_block(batch["block"][i].as_buffer().to_pybytes(), tables[0]).astype("<u4")
                lengths = batch["lengths"][i].values.to_numpy()
                ends = np.cumsum(lengths)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a block's ids don't fill its documents")
                begins = ends - lengths
                at = starts.value[batch["part"][i].as_py()] + batch["at"][i].as_py()
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [batch["doc_ids"][i].values, pa.array(begins + at), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    blocks = spark.read.schema(_BLOCK.replace("ids binary", "block binary")).parquet(f"{path}/blocks")
    return blocks.mapInArrow(unpack, schema)
