"""S0 trade operators: one hash aggregation per bucket gives them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


_NOTIONAL = lambda: _zero(F.col("qty")) * _zero(F.col("price"))
_SIGN = lambda: F.when(F.col("side") == "buy", 1.0).when(F.col("side") == "sell", -1.0).otherwise(0.0)
#: Operator to its aggregate over columns price, qty and side.
TRADES = {
    "trades.trade_count": lambda: F.count(F.lit(1)).cast("double"),
    "trades.volume": lambda: _zero(F.sum("qty")),
    "trades.notional": lambda: _zero(F.sum(_NOTIONAL())),
    "trades.taker_buy_volume": lambda: _zero(F.sum(F.when(F.col("side") == "buy", F.col("qty")))),
    "trades.taker_sell_volume": lambda: _zero(F.sum(F.when(F.col("side") == "sell", F.col("qty")))),
    "trades.signed_volume": lambda: _zero(F.sum(_SIGN() * F.col("qty"))),
    "trades.taker_buy_notional": lambda: _zero(F.sum(F.when(F.col("side") == "buy", _NOTIONAL()))),
    "trades.taker_sell_notional": lambda: _zero(F.sum(F.when(F.col("side") == "sell", _NOTIONAL()))),
    "trades.signed_notional": lambda: _zero(F.sum(_SIGN() * _NOTIONAL())),
}


def trade_bars(trades: DataFrame, keys: list[str], bucket: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """All trade operators per key and bucket (short names), and ``extra`` aggregates."""
    named = {op.split(".")[1]: make() for op, make in TRADES.items()}
    return trades.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(*(c.alias(n) for n, c in {**named, **(extra or {})}.items()))


def on_grid(bars: DataFrame, keys: list[str], step: str, zero: list[str]) -> DataFrame:
    """Every bucket from each key's first to last; columns of ``zero`` are 0 in added ones, others NULL."""
    ends = bars.groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = ends.select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias("bucket"))
    full = grid.join(bars, [*keys, "bucket"], "left")
    return full.fillna(0.0, zero)


def snapshots(book: DataFrame, keys: list[str], bucket: Column, at: str = "exch_ts_ms", seq: str = "seq") -> DataFrame:
    """The last order-book row of each bucket: latest time, then largest sequence number."""
    rest = [c for c in book.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(at, seq)).alias("s")
    return book.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(last).select(*keys, "bucket", "s.*")
