"""Tables over event paths, exit grids chosen on the past, signatures and families of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import first_at, tp_sl


def quantile_table(df: DataFrame, columns: list[str], shares: list[float], keys: list[str]) -> DataFrame:
    """Exact percentiles of each column, one row per column and share."""
    made = [F.struct(F.lit(c).alias("measure"), F.lit(s).alias("share"), F.percentile(c, F.lit(s)).alias("value")) for c in columns for s in shares]
    return df.groupBy(*keys).agg(F.array(*made).alias("p")).select(*keys, F.explode("p").alias("p")).select(*keys, "p.*")


def average_path(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Mean, deviation and count at each step of the paths."""
    steps = df.select(*keys, F.posexplode(path).alias("step", "v"))
    return steps.groupBy(*keys, "step").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def level_times(df: DataFrame, path: str, level_list: list[float], keys: list[str]) -> DataFrame:
    """How many paths reach each level, and when (steps from 1)."""
    made = [F.struct(F.lit(x).alias("level"), first_at(F.col(path), _at_least(x)).alias("t")) for x in level_list]
    d = df.select(*keys, F.explode(F.array(*made)).alias("h")).select(*keys, "h.*")
    return d.groupBy(*keys, "level").agg(F.avg(F.col("t").isNotNull().cast("double")).alias("hit_rate"), F.avg("t").alias("mean_t"), *(F.percentile("t", F.lit(p / 100)).alias(f"p{p}_t") for p in (25, 50, 75)))


def _at_least(x: float):
    return lambda v: v >= x


def sharpe(x: str) -> Column:
    sd = F.stddev_pop(x)
    return F.when(sd > 1e-12, F.avg(x) / sd * F.sqrt(F.count(x)))


def grid_cv(df: DataFrame, path: str, block: str, grid: list[tuple[float, float, int]], cost: float, folds: int, least: int = 30) -> DataFrame:
    """Take-profit and stop-loss pairs chosen by Sharpe on all blocks before, measured on the block itself.

    One aggregation per (block, parameters) holds the moments; folds add them up,
    so that no row is read once for each fold.
    """
    made = [F.struct(F.lit(i).alias("g"), (tp_sl(F.col(path), tp, sl, t) - cost).alias("pnl")) for i, (tp, sl, t) in enumerate(grid)]
    d = df.where(F.col(block).isNotNull()).select(block, F.explode(F.array(*made)).alias("r")).select(F.col(block).cast("long").alias("block"), "r.*")
    m = d.groupBy("block", "g").agg(F.count("pnl").alias("n"), F.sum("pnl").alias("s"), F.sum(F.col("pnl") * F.col("pnl")).alias("ss"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    past = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumns({f"{c}0": F.sum(c).over(past) for c in ("n", "s", "ss")})
    mean = F.col("s0") / F.col("n0")
    var = F.greatest(F.lit(0.0), F.col("ss0") / F.col("n0") - mean * mean)
    m = m.withColumn("train", F.when((F.col("n0") >= least) & (var > 1e-12), mean / F.sqrt(var) * F.sqrt("n0")))
    best = Window.partitionBy("block").orderBy(F.desc_nulls_last("train"), "g")
    m = m.where((F.col("block") >= 1) & (F.col("block") <= folds)).withColumn("_n", F.row_number().over(best)).where("_n = 1 AND train IS NOT NULL")
    return m.select("block", "g", "n", (F.col("s") / F.col("n")).alias("mean_pnl"), "win_rate", F.col("train").alias("train_sharpe"))


def embargoed(df: DataFrame, at: str, test_start, embargo: int) -> DataFrame:
    """Training rows: those at least ``embargo`` before the test begins."""
    return df.where(F.col(at) < test_start - embargo)


def ic_ratio(metrics: DataFrame, ic: str = "ic") -> DataFrame:
    """Mean over deviation of the folds' rank correlations, 0 without deviation."""
    sd = F.stddev_pop(ic)
    return metrics.agg(F.when(sd >= 1e-10, F.avg(ic) / sd).otherwise(0.0).alias("icir"))


def signature(df: DataFrame, group: str, columns: list[str], top: int = 50) -> DataFrame:
    """For each group the ``top`` columns whose mean is farthest from the overall mean, in overall deviations."""
    whole = df.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns))
    by = df.groupBy(group).agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    made = [F.struct(F.lit(c).alias("feature"), F.when(F.col(f"{c}.s") > 1e-12, (F.col(f"_{c}") - F.col(f"{c}.m")) / F.col(f"{c}.s")).alias("z")) for c in columns]
    d = by.crossJoin(F.broadcast(whole)).select(group, F.explode(F.array(*made)).alias("r")).select(group, "r.*")  # whole is one row
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(F.round(F.abs("z"), 9)), "feature")  # equal but for float noise: by name
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def family(names: DataFrame, families: DataFrame) -> DataFrame:
    """The family whose concept is the longest prefix of the name (a whole match is the longest), else NULL.

    Both are metadata tables, of a row per feature and per concept.
    """
    hit = F.col("feature").startswith(F.col("concept"))
    j = names.join(F.broadcast(families), hit, "left")
    return j.groupBy("feature").agg(F.max_by("family", F.length("concept")).alias("family"))


def tick_size(df: DataFrame, price: str, keys: list[str]) -> DataFrame:
    """Median of the lowest twentieth of the steps between different prices."""
    p = df.where(F.col(price).isNotNull()).select(*keys, F.round(price, 8).alias("p")).distinct()
    d = p.withColumn("d", F.col("p") - F.lag("p").over(Window.partitionBy(*keys).orderBy("p"))).where("d > 1e-12")
    low = d.groupBy(*keys).agg(F.percentile("d", F.lit(0.05)).alias("q"))
    return d.join(F.broadcast(low) if not keys else low, keys).where("d <= q").groupBy(*keys).agg(F.percentile("d", F.lit(0.5)).alias("tick"))
