"""Streams drained in one go, against what batch gives."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.streaming import live


def stream(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_duplicates_go(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:02")]
    s = stream(spark, tmp_path, [rows], "trade_id string, s string").withColumn("ts", F.to_timestamp("s"))
    assert sorted(r["trade_id"] for r in live.run(live.once(s)).collect()) == ["a", "b"]


def test_validation(spark):
    rows = [("1", "5", "2", True, "946684800001", 7), ("2", "x", "2", True, "1", 7), ("3", "5", "-2", False, "1", 7), ("4", "5", "1", None, "1", 7), ("5", "5", "1", False, "1", 946684900000)]
    df = spark.createDataFrame(rows, "trade_id string, price string, qty string, is_buyer_maker boolean, exch_ts_ms string, ts_ms long")
    got = {r["trade_id"]: (r["side"], r["ts"].year) for r in live.valid_trades(df).collect()}
    assert got == {"1": ("sell", 2000), "5": ("buy", 2000)}
    base, quote = live.split_symbol(F.lit("ABCUSDT"))
    assert tuple(spark.range(1).select(base, quote).first()) == ("ABC", "USDT")


def test_book_state(spark, tmp_path):
    schema = "symbol string, seq long, side string, price double, qty double"
    first = [("X", 1, "bid", 99.0, 1.0), ("X", 1, "ask", 101.0, 2.0)]
    second = [("X", 2, "bid", 99.0, 0.0), ("X", 2, "bid", 98.0, 4.0)]
    gap = [("X", 9, "bid", 90.0, 1.0), ("X", 9, "ask", 91.0, 1.0)]
    out = live.run(live.book(stream(spark, tmp_path, [first, second, gap], schema), 5))
    got = {r["seq"]: (r["bids_px"], r["asks_px"]) for r in out.collect()}
    assert got[1] == ([99.0], [101.0]) and got[2] == ([98.0], [101.0]) and got[9] == ([90.0], [91.0])


def test_ema_is_carried(spark, tmp_path):
    x = [float((i * 7) % 11) for i in range(20)]
    parts = [[("k", i, v) for i, v in enumerate(x)][a:b] for a, b in ((0, 5), (5, 12), (12, 20))]
    s = stream(spark, tmp_path, parts, "key string, t long, x double")
    got = [r["ema"] for r in live.run(live.ema(s, 4)).orderBy("t").collect()]
    assert got == pytest.approx(pd.Series(x).ewm(span=4, adjust=False).mean().tolist())
