"""Structured Streaming: bars, deduplication, order-book state and carried averages.

The same column builders as in batch; state lives in the engine's state store,
so a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.buckets import TRADES


def valid_trades(raw: DataFrame) -> DataFrame:
    """Raw text fields to trades: numbers that don't parse, or aren't positive, drop the row; so does an unknown aggressor.

    A time before 2000 is repaired with the receive time, not dropped.
    """
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    at = F.expr("try_cast(exch_ts_ms AS bigint)")
    fixed = F.when(at >= 946684800000, at).otherwise(F.col("ts_ms"))
    side = F.when(F.col("is_buyer_maker") == F.lit(True), "sell").when(F.col("is_buyer_maker") == F.lit(False), "buy")
    d = raw.withColumns({"price": number("price"), "qty": number("qty"), "ts": F.timestamp_millis(fixed), "side": side})
    return d.where("price > 0 AND qty > 0 AND side IS NOT NULL AND trade_id IS NOT NULL")


def split_symbol(symbol, quotes: tuple[str, ...] = ("USDT", "USDC", "USD", "BTC")):
    """Base and quote of a symbol such as ABCUSDT."""
    pattern = rf"^(.+?)({'|'.join(quotes)})$"
    return F.regexp_extract(symbol, pattern, 1), F.regexp_extract(symbol, pattern, 2)


def once(trades: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Each trade id once within the watermark."""
    return trades.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trade_id"])


def bars(trades: DataFrame, keys: list[str], width: str, delay: str) -> DataFrame:
    """All trade operators per key and tumbling window."""
    t = trades.withWatermark("ts", delay)
    g = t.groupBy(*keys, F.window("ts", width).alias("w")).agg(*(make().alias(op.split(".")[1]) for op, make in TRADES.items()))
    return g.select(*keys, F.col("w.start").alias("bucket"), *(op.split(".")[1] for op in TRADES))


def book(diffs: DataFrame, depth: int) -> DataFrame:
    """Order-book state per symbol from absolute diffs (qty 0 deletes a level): top levels after each batch.

    ``diffs``: symbol, seq, side (bid or ask), price, qty. A first update that
    doesn't follow the last one clears the book (a gap): it fills anew.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, prices, sides, qtys = state.get if state.exists else (None, [], [], [])
        levels = {(s, p): q for s, p, q in zip(sides, prices, qtys, strict=True)}
        for rows in frames:
            for r in rows.sort_values("seq", kind="stable").itertuples():
                if last is not None and r.seq > last + 1:
                    levels.clear()
                if last is None or r.seq >= last:
                    last = int(r.seq)
                    if r.qty > 0:
                        levels[r.side, r.price] = float(r.qty)
                    else:
                        levels.pop((r.side, r.price), None)
        state.update((last, [p for _, p in levels], [s for s, _ in levels], list(levels.values())))
        bids = sorted((p for s, p in levels if s == "bid"), reverse=True)[:depth]
        asks = sorted(p for s, p in levels if s == "ask")[:depth]
        if bids and asks and bids[0] < asks[0]:  # a crossed or empty book isn't emitted
            yield pd.DataFrame([{"symbol": key[0], "seq": last, "bids_px": bids, "bids_qty": [levels["bid", p] for p in bids], "asks_px": asks, "asks_qty": [levels["ask", p] for p in asks]}])

    out = "symbol string, seq long, bids_px array<double>, bids_qty array<double>, asks_px array<double>, asks_qty array<double>"
    kept = "last long, prices array<double>, sides array<string>, qtys array<double>"
    return diffs.groupBy("symbol").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def ema(values: DataFrame, span: float) -> DataFrame:
    """Exponential average carried over batches: columns key, t, x in; key, t, ema out."""
    a = 2.0 / (span + 1.0)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("t", kind="stable").itertuples():
            if r.x == r.x:
                y = float(r.x) if y is None else a * r.x + (1 - a) * y
            out.append((key[0], r.t, y))
        state.update((y,))
        yield pd.DataFrame(out, columns=["key", "t", "ema"])

    return values.groupBy("key").applyInPandasWithState(step, "key string, t long, ema double", "y double", "append", GroupStateTimeout.NoTimeout)


def run(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drain a stream into a table in memory (tests and small results)."""
    name = "live_" + uuid.uuid4().hex
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()
    return df.sparkSession.table(name)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour bars of the events stream; the same rows as in batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/events.parq*t"
    e = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    t = e.select("event_type", "ts", F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"))
    got = run(bars(t, ["event_type"], "6 hours", "1 hour"), "complete")
    sums = [op.split(".")[1] for op in TRADES]
    return got.select("event_type", F.unix_timestamp("bucket").alias("bucket"), *(F.round(c, 4).alias(c) for c in sums))


EVENT_BARS_SQL = """
WITH t AS (SELECT event_type, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS bucket, value AS v, user_id % 2 = 0 AS b FROM events)
SELECT event_type, bucket, count(*)::DOUBLE AS trade_count, count(*)::DOUBLE AS volume, round(sum(v), 4) AS notional,
  count(*) FILTER (b)::DOUBLE AS taker_buy_volume, count(*) FILTER (NOT b)::DOUBLE AS taker_sell_volume, (count(*) FILTER (b) - count(*) FILTER (NOT b))::DOUBLE AS signed_volume,
  round(coalesce(sum(v) FILTER (b), 0), 4) AS taker_buy_notional, round(coalesce(sum(v) FILTER (NOT b), 0), 4) AS taker_sell_notional,
  round(coalesce(sum(v) FILTER (b), 0) - coalesce(sum(v) FILTER (NOT b), 0), 4) AS signed_notional
FROM t GROUP BY event_type, bucket
"""
QUERIES = {"stream_bars": (event_bars, EVENT_BARS_SQL)}
