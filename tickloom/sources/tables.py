"""Views of the driver tables in the shapes that the engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSETS = ["a0", "a1", "a2"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from lineitem: asset, market (spot or fut), ts, price (whole), qty, side."""
    d = read(spark, sf_dir, "lineitem")
    return d.select(
        F.concat(F.lit("a"), F.col("l_partkey") % 3).alias("asset"),
        F.when(F.col("l_suppkey") % 2 == 0, "spot").otherwise("fut").alias("market"),
        F.col("l_shipdate").alias("ts"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.when(F.col("l_linestatus") == "O", "buy").when(F.col("l_returnflag") == "R", "sell").otherwise("unknown").alias("side"),
        F.floor(F.col("l_discount") * 100 + 1e-9).cast("int").alias("band"),
        F.col("l_orderkey").alias("order_id"),
    )
