"""Scans that stand schema drift, hour ranges, sampling of files, sinks, and feed continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, paths: list[str], columns: dict[str, str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Parquet files of differing schemas: wanted columns (name to type), older names by ``aliases``, NULL where a file has none."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    have = set(df.columns)
    old: dict[str, list[str]] = {}
    for was, now in (aliases or {}).items():
        old.setdefault(now, []).append(was)

    def column(name: str, kind: str) -> Column:
        found = [F.col(f"`{c}`") for c in [name, *old.get(name, [])] if c in have]
        return (F.coalesce(*found) if found else F.lit(None)).cast(kind).alias(name)

    return df.select(*(column(n, k) for n, k in columns.items()))


def hour_range(df: DataFrame, at: str, start: str, end: str, keys: list[str], require_complete: bool = False) -> DataFrame:
    """Rows of [start, end); with ``require_complete`` only keys that have every hour of it."""
    d = df.where((F.col(at) >= F.lit(start).cast("timestamp")) & (F.col(at) < F.lit(end).cast("timestamp")))
    if not require_complete:
        return d
    hours = F.expr(f"(unix_timestamp('{end}') - unix_timestamp('{start}')) / 3600")
    full = d.groupBy(*keys).agg(F.countDistinct(F.date_trunc("hour", at)).alias("_n")).where(F.col("_n") >= hours).select(*keys)
    return d.join(full, keys, "left_semi")


def sampled_files(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Rows of n files chosen by a seeded hash of their names (a sampling operator: n is its meaning)."""
    rows = df.withColumn("_file", F.input_file_name())
    names = rows.select("_file").distinct().orderBy(F.xxhash64("_file", F.lit(seed)), "_file").limit(n)
    return rows.join(F.broadcast(names), "_file", "left_semi").drop("_file")


def routed(df: DataFrame, path: str, at: str, keys: list[str]) -> None:
    """Append to a folder per key, date and hour; the commit protocol makes files appear whole."""
    d = df.withColumns({"date": F.to_date(at), "hour": F.hour(at)})
    d.repartition(*keys, "date", "hour").write.mode("append").partitionBy(*keys, "date", "hour").parquet(path)


def links(first: Column, last: Column, before: Column, snapshot: Column, futures: bool) -> Column:
    """Does a diff (first to last update id, id before it or NULL) join on to a snapshot?"""
    if futures:
        return ((first <= snapshot) & (snapshot <= last)) | F.coalesce(before == snapshot, F.lit(False))
    return (first <= snapshot + 1) & (snapshot + 1 <= last) & (before.isNull() | (before == snapshot))


def follows(first: Column, last: Column, before: Column, current: Column, futures: bool) -> Column:
    """Does a diff follow the book's current update id without a gap?"""
    near = (first == current + 1) | F.coalesce(before == current, F.lit(False))
    return near | ((first <= current + 1) & (current + 1 <= last)) if futures else near


def feed_report(rows: DataFrame, keys: list[str], at: str, value: str, gap: int = 3) -> DataFrame:
    """Per stream: rows, first and last time, rows a second, gaps over ``gap`` seconds, rows out of order, percentiles of a value."""
    t = F.unix_timestamp(at)
    w = Window.partitionBy(*keys).orderBy("_seq")
    d = rows.withColumn("_t", t).withColumn("_step", F.col("_t") - F.lag("_t").over(w))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("_t").alias("first"),
        F.max("_t").alias("last"),
        F.sum((F.col("_step") > gap).cast("int")).cast("long").alias("n_gaps"),
        F.sum((F.col("_step") < 0).cast("int")).cast("long").alias("n_late"),
        F.avg(value).alias("mean"),
        *(F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 99)),
    )
    return g.withColumn("per_second", F.try_divide(F.col("n_rows").cast("double"), (F.col("last") - F.col("first")).cast("double")))
