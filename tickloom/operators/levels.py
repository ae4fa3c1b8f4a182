"""Reference levels: running day, week and month, and volume profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], order: str, price: str, period: Column, prefix: str, broadcast_open: bool = False) -> DataFrame:
    """Running high, low and open of each period, and the extrema of the period before.

    With ``broadcast_open`` every row of a period has the period's first value,
    else the first one so far.
    """
    df = df.withColumn("_p", period)
    w = Window.partitionBy(*keys, "_p").orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns(
        {
            f"{prefix}_high": F.max(price).over(so_far),
            f"{prefix}_low": F.min(price).over(so_far),
            f"{prefix}_open": F.first(price, ignorenulls=True).over(whole if broadcast_open else so_far),
        }
    )
    ends = df.groupBy(*keys, "_p").agg(F.max(price).alias("h"), F.min(price).alias("l"))
    before = Window.partitionBy(*keys).orderBy("_p")
    ends = ends.select(*keys, "_p", F.lag("h").over(before).alias(f"prev_{prefix}_high"), F.lag("l").over(before).alias(f"prev_{prefix}_low"))
    return df.join(ends, [*keys, "_p"], "left").drop("_p")


def monday(df: DataFrame, keys: list[str], order: str, price: str) -> DataFrame:
    """Monday's high and low: running on Monday, frozen for the rest of the week."""
    df = df.withColumn("_w", F.date_trunc("week", order))
    so_far = Window.partitionBy(*keys, "_w").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.when(F.weekday(order) == 0, F.col(price))
    return df.withColumns({"monday_high": F.max(on).over(so_far), "monday_low": F.min(on).over(so_far)}).drop("_w")


def complete_days(df: DataFrame, keys: list[str], day: Column, hour: Column, hours: int = 24) -> DataFrame:
    """Days on which every hour has data."""
    return df.groupBy(*keys, day.alias("day")).agg(F.countDistinct(hour).alias("n_hours")).where(F.col("n_hours") >= hours)


def volume_profile(ticks: DataFrame, keys: list[str], tick: str, price: str, qty: str, bins: int = 50, area: float = 0.7) -> DataFrame:
    """Point of control and value area of each (keys, tick) group of trades.

    The price range is cut into equal bins; the POC is the middle of the first
    bin with most volume; the value area grows from it toward the neighbour with
    more volume (the upper one on a tie) until it holds ``area`` of the volume.
    A single price is its own POC and area; without volume there is none.
    Volumes are summed per bin before anything is gathered: an array of ``bins``.
    """
    g = [*keys, tick]
    ends = ticks.groupBy(*g).agg(F.min(price).alias("lo"), F.max(price).alias("hi"))
    t = ticks.join(ends, g)
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(price) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    sums = t.withColumn("bin", place.cast("int")).groupBy(*g, "lo", "hi", "bin").agg(F.sum(qty).alias("v"))
    full = sums.groupBy(*g, "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    full = full.withColumn("v", v).withColumn("total", F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    vol = F.col("v")
    full = full.withColumn("top", (F.array_position("v", F.array_max("v")) - 1).cast("int"))
    at = lambda i: F.coalesce(F.get(vol, i), F.lit(-1.0))
    start = F.struct(F.col("top").alias("a"), F.col("top").alias("b"), at(F.col("top")).alias("s"))

    def grow(state, _):
        up, down = at(state["b"] + 1), F.when(state["a"] > 0, at(state["a"] - 1)).otherwise(F.lit(-1.0))
        done = (state["s"] >= F.col("total") * area) | ((up < 0) & (down < 0))
        higher = F.struct(state["a"].alias("a"), (state["b"] + 1).alias("b"), (state["s"] + up).alias("s"))
        lower = F.struct((state["a"] - 1).alias("a"), state["b"].alias("b"), (state["s"] + down).alias("s"))
        return F.when(done, state).when(up >= down, higher).otherwise(lower)

    full = full.withColumn("g", F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grow))
    step = (F.col("hi") - F.col("lo")) / bins
    one, some = F.col("hi") == F.col("lo"), F.col("total") > 0
    value = lambda x: F.when(some, F.when(one, F.col("lo")).otherwise(x))
    return full.select(
        *g,
        value(F.col("lo") + (F.col("top") + 0.5) * step).alias("poc"),
        value(F.col("lo") + (F.col("g.b") + 1) * step).alias("vah"),
        value(F.col("lo") + F.col("g.a") * step).alias("val"),
    )
