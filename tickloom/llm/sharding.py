"""Operator 9: uniform shuffle into shards of exact sizes.

A communication matrix says how many rows of each input partition go to each
cell (a slice of a shard). Its law is that of a uniform random permutation: row
sums are the partitions' row counts, column sums the cells' sizes. It is never
held whole: the matrix row of partition p is drawn by walking down a binary tree
over the partitions, splitting the cells' counts at every node by a multivariate
hypergeometric draw seeded by (seed, node). Two tasks that pass the same node
draw the same split, so a task that is run again repeats its result, and no
communication is needed. Each task then deals its rows by a local permutation,
the exchange brings a cell's rows together, and a second permutation inside the
cell gives the slots. Cells hold about ``cell_rows`` rows however large a shard
is, so no task gathers a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, ship

_POSITION = (1 << 33) - 1  # low bits of monotonically_increasing_id()


def cell_sizes(n_rows: int, n_shards: int, cell_rows: int) -> tuple[np.ndarray, int]:
    """Sizes of all cells, shard by shard, and how many cells a shard has."""
    per_shard = np.full(n_shards, n_rows // n_shards, np.int64)
    per_shard[: n_rows % n_shards] += 1
    k = max(1, -(-int(per_shard.max(initial=0)) // cell_rows))
    sizes = np.repeat(per_shard // k, k).reshape(n_shards, k)
    sizes += np.arange(k) < (per_shard % k)[:, None]
    return sizes.ravel(), k


def matrix_row(prefix: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Rows that partition ``part`` sends to each cell.

    ``prefix`` has the rows of all partitions before each, and the total last.
    """
    lo, hi, counts = 0, len(prefix) - 1, sizes
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = int(prefix[mid] - prefix[lo])
        rng = np.random.default_rng([seed, lo, hi])
        drawn = _hypergeometric(rng, counts, left)
        lo, hi, counts = (lo, mid, drawn) if part < mid else (mid, hi, counts - drawn)
    return counts


def _hypergeometric(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """Colours of ``n`` balls drawn from an urn: pairs of colour groups are split first, as a tree."""
    out = np.zeros_like(counts)
    stack = [(0, len(counts), n)]
    total = np.concatenate([[0], np.cumsum(counts)])
    while stack:
        a, b, k = stack.pop()
        if k == 0:
            continue
        if k == total[b] - total[a]:
            out[a:b] = counts[a:b]
        elif b - a == 1:
            out[a] = k
        else:
            m = (a + b) // 2
            left, right = int(total[m] - total[a]), int(total[b] - total[m])
            x = _split(rng, left, right, k)
            stack += [(m, b, k - x), (a, m, x)]
    return out


def _split(rng: np.random.Generator, good: int, bad: int, k: int) -> int:
    """A hypergeometric number; numpy's generator takes fewer than 10^9 balls of a colour."""
    if not good or not bad:
        return k if good else 0
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, k))
    return _split_large(rng, good, bad, k)


def _split_large(rng: np.random.Generator, good: int, bad: int, k: int) -> int:
    """Rejection from a normal-like hat (ratio of uniforms) on the exact log mass."""
    n, lg = good + bad, math.lgamma
    k_small, few, many = min(k, n - k), min(good, bad), max(good, bad)
    share = few / n
    centre = k_small * share + 0.5
    sd = math.sqrt((n - k_small) * k_small * share * (1 - share) / (n - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)
    mass = lambda z: -(lg(z + 1) + lg(few - z + 1) + lg(k_small - z + 1) + lg(many - k_small + z + 1))
    top = mass((k_small + 1) * (few + 1) // (n + 2))
    while True:
        u, v = 1 - rng.random(), rng.random()
        z = math.floor(centre + width * (v - 0.5) / u)
        if max(0, k_small - many) <= z <= min(k_small, few) and 2 * math.log(u) <= mass(z) - top:
            break
    if good > bad:
        z = k_small - z
    return z if k_small == k else good - z


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 9, cell_rows: int = 50_000) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0).

    Law ``rows``: shard sizes differ by one at most, and every assignment of rows
    to (shard, slot) is equally likely. ``docs`` must be a table scan (or another
    plan that gives the same partitions and row order each time it runs); a
    partition that changes between the two passes raises an error. Values aren't
    looked at, so nulls, empty texts and repeated rows are dealt like any row; an
    empty table gives no rows; a column that clashes with shard or slot gets
    replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("shard", "slot")
    counts = dict(docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    parts = np.zeros(max(counts, default=-1) + 1, np.int64)  # a number for each input partition
    for p, n in counts.items():
        parts[p] = n
    prefix = np.concatenate([[0], np.cumsum(parts)])
    sizes, k = cell_sizes(int(prefix[-1]), n_shards, cell_rows)
    known = spark.sparkContext.broadcast((prefix, sizes))
    rows: dict[int, np.ndarray] = {}

    @F.pandas_udf("int")
    def deal(ids: pd.Series) -> pd.Series:
        prefix, sizes = known.value
        at = ids.to_numpy()
        part = int(at[0] >> 33)
        if part not in rows:
            rows.clear()
            cells = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(prefix, sizes, part, seed))
            rows[part] = np.random.default_rng([seed, part, 1]).permutation(cells)
        pos = at & _POSITION
        if pos[-1] >= len(rows[part]):
            raise ValueError(f"partition {part} has more rows than when it was counted")
        return pd.Series(rows[part][pos])

    at, cell, order = (free_name(docs, x) for x in ("_at", "_cell", "_order"))
    # The start of cell j of a shard in closed form: sizes are q + 1 for the first r cells, q after.
    n = F.lit(int(prefix[-1]))
    s, j = F.floor(F.col(cell) / k), F.col(cell) % k
    in_shard = F.floor(n / n_shards) + F.when(s < n % n_shards, 1).otherwise(0)
    start = j * F.floor(in_shard / k) + F.least(j, in_shard % k)
    dealt = docs.withColumn(at, F.monotonically_increasing_id()).withColumn(cell, deal(F.col(at)))
    dealt = dealt.withColumn(order, F.xxhash64(F.lit(seed), F.col(at)))
    inner = Window.partitionBy(cell).orderBy(order, at)
    return dealt.withColumns(
        {"shard": s.cast("int"), "slot": (start + F.row_number().over(inner) - 1).cast("long")}
    ).drop(at, cell, order)
