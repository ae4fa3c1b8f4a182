"""Evaluation: folds, metrics, threshold backtests, events, paths, exits and error control."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import correlation


def folds(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Expanding windows: n // (k + 1) rows make a block; fold i trains on blocks 0..i and tests on i + 1.

    Rows get ``block``; those after the last whole block get NULL.
    """
    ranked = global_rank(df, order)
    size = max(1, df.count() // (k + 1))
    block = F.floor(F.col("rank") / size)
    return ranked.withColumn("block", F.when(block <= k, block)).drop("rank")


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Row numbers from 0 over the whole order, without sorting all rows in one task.

    Rows are counted per value of the first order column (a time bucket), the
    counts are added up over the buckets, and rows are numbered inside theirs.
    """
    first = order[0]
    counts = df.groupBy(first).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(first).alias("_first"), F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(first).orderBy(*order)) - 1
    joined = df.withColumn("_inside", inside).join(starts, F.col(first).eqNullSafe(F.col("_first")))
    return joined.withColumn("rank", F.col("_start") + F.col("_inside")).drop("_first", "_start", "_inside")


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*keys).orderBy(x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def fold_metrics(pred: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """R2, errors, directional accuracy (both non-zero), Matthews coefficient of the signs and rank correlation."""
    d = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    d = d.withColumns({"_ry": average_rank(y, keys), "_rp": average_rank(p, keys)})
    e = F.col(y) - F.col(p)
    both = (F.col(y) != 0) & (F.col(p) != 0)
    hit = F.when(both, (F.signum(y) == F.signum(p)).cast("double"))
    side = lambda a, b: F.sum(F.when(F.signum(y) == a, 1.0).otherwise(0.0) * F.when(F.signum(p) == b, 1.0).otherwise(0.0))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("_v"),
        F.avg(hit).alias("da"),
        correlation(F.col("_ry"), F.col("_rp")).alias("ic"),
        side(1, 1).alias("_tp"),
        side(-1, -1).alias("_tn"),
        side(-1, 1).alias("_fp"),
        side(1, -1).alias("_fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("_tp", "_tn", "_fp", "_fn"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    g = g.withColumns({"r2": F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")), "rmse": F.sqrt("mse"), "mcc": F.when(below > 0, (tp * tn - fp * fn) / below).otherwise(0.0)})
    return g.select(*keys, "n", "r2", "mse", "mae", "rmse", "da", "ic", "mcc")


def threshold_backtest(pred: DataFrame, keys: list[str], thresholds: list[float], cost: float, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Long above, short below, flat within each threshold: trades, profit, win rate and Sharpe * sqrt(n)."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    d = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*keys, y, p, t)
    d = d.withColumn("s", F.when(F.col(p) > F.col("threshold"), 1.0).when(F.col(p) < -F.col("threshold"), -1.0).otherwise(0.0))
    d = d.withColumn("pnl", F.when(F.col("s") != 0, F.col("s") * F.col(y) - cost))
    g = d.groupBy(*keys, "threshold").agg(
        F.count("pnl").alias("n_trades"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("pnl"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg("pnl").alias("mean"),
        F.stddev_pop("pnl").alias("sd"),
    )
    return g.withColumn("sharpe", F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd") * F.sqrt("n_trades"))).drop("mean", "sd")


def breakout_counts(df: DataFrame, x: dict[str, str], thresholds: list[float]) -> DataFrame:
    """How often each column lies over and under each threshold."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("window"), F.col(c).alias("v")) for n, c in x.items())))
    d = df.select(rows.alias("r")).select("r.*").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    count = lambda c: F.sum(c.cast("int")).cast("long")
    return d.groupBy("window", "threshold").agg(count(F.coalesce(F.col("v") > F.col("threshold"), F.lit(False))).alias("up"), count(F.coalesce(F.col("v") < -F.col("threshold"), F.lit(False))).alias("down"))


def spaced(events: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Greedy non-overlapping events: the first, then each at least ``gap`` after the last one taken.

    A fold over a key's sorted event times (events are the breakouts, not the rows).
    """
    taken = F.aggregate(
        F.array_sort(F.collect_list(at)),
        F.array().cast("array<bigint>"),
        lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= gap), F.concat(a, F.array(x))).otherwise(a),
    )
    got = events.withColumn(at, F.col(at).cast("long")).groupBy(*keys).agg(taken.alias("_t")).select(*keys, F.explode("_t").alias(at))
    return events.withColumn(at, F.col(at).cast("long")).join(got, [*keys, at], "left_semi")


def paths(df: DataFrame, keys: list[str], order: str, ret: str, length: int, direction: Column) -> Column:
    """Cumulative bps of the ``length`` rows after the next one, in the event's direction (shorter near the end)."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, length)
    steps = F.collect_list(F.coalesce(F.col(ret), F.lit(0.0))).over(frame)
    sums = lambda v: F.aggregate(v, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x * 1e4)))
    return F.transform(sums(steps), lambda v: v * direction)


def excursion(path: Column) -> dict[str, Column]:
    """Best, worst and last value of a path, and the step (from 1) of the best."""
    some = F.size(path) > 0
    return {
        "mfe": F.when(some, F.array_max(path)),
        "mae": F.when(some, F.array_min(path)),
        "terminal": F.when(some, F.try_element_at(path, F.lit(-1))),
        "t_mfe": F.when(some, F.array_position(path, F.array_max(path))),
    }


def first_at(path: Column, hit) -> Column:
    """Step (from 1) at which a condition first holds, NULL if never."""
    steps = F.filter(F.transform(path, lambda v, i: F.when(hit(v), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(steps) > 0, F.array_min(steps))


def tp_sl(path: Column, tp: float, sl: float, timeout: int) -> Column:
    """Exit value: take profit or stop loss at first touch (profit wins a tie), else the value at the timeout."""
    cut = F.slice(path, 1, timeout)
    up, down = first_at(cut, lambda v: v >= tp), first_at(cut, lambda v: v <= -sl)
    never = F.lit(1 << 30)
    a, b = F.coalesce(up, never), F.coalesce(down, never)
    end = F.try_element_at(cut, F.lit(-1))
    return F.when(up.isNotNull() & (a <= b), F.lit(float(tp))).when(down.isNotNull(), F.lit(-float(sl))).otherwise(end)


def trailing(path: Column, offset: float, timeout: int) -> Column:
    """Armed once the best value exceeds the offset; exits at the current value when it falls that far from the best."""
    cut = F.slice(path, 1, timeout)
    state = F.struct(F.lit(float("-inf")).alias("top"), F.lit(None).cast("double").alias("out"))

    def step(s, v):
        top = F.greatest(s["top"], v)
        out = F.coalesce(s["out"], F.when((top > offset) & (v <= top - offset), v))
        return F.struct(top.alias("top"), out.alias("out"))

    return F.aggregate(cut, state, step, lambda s: F.coalesce(s["out"], F.try_element_at(cut, F.lit(-1))))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] | None = None) -> DataFrame:
    """q values: p * n / rank, made monotone from the right, 1 at most; a NULL stays NULL and doesn't count."""
    keys = keys or []
    ok = F.col(p).isNotNull()
    n = F.count(p).over(Window.partitionBy(*keys, ok))
    up = Window.partitionBy(*keys, ok).orderBy(p)
    df = df.withColumn("_q", F.when(ok, F.col(p) * n / F.row_number().over(up)))
    down = Window.partitionBy(*keys, ok).orderBy(F.desc(p), F.desc("_q")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_m", F.min("_q").over(down))
    tied = F.min("_m").over(Window.partitionBy(*keys, p))
    return df.withColumn("q", F.when(ok, F.least(F.lit(1.0), tied))).drop("_q", "_m")


def permutation_p(df: DataFrame, group: str, up: str, down: str, rounds: int, seed: int = 0) -> DataFrame:
    """Best group ratio of mean ``up`` to mean ``down`` against shuffled labels: (1 + hits) / (rounds + 1).

    Labels are dealt anew by matching two random orders of each round.
    """
    base = df.select(group, up, down).withColumn("_i", F.monotonically_increasing_id())
    best = lambda d, keys: d.groupBy(*keys, group).agg((F.avg(up) / F.avg(down)).alias("r")).groupBy(*keys).agg(F.max("r").alias("r"))
    real = best(base.withColumn("round", F.lit(-1)), ["round"])
    many = base.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = lambda salt: Window.partitionBy("round").orderBy(F.xxhash64("_i", "round", F.lit(salt)))
    labels = many.select("round", group, F.row_number().over(order(seed)).alias("_n"))
    values = many.select("round", up, down, F.row_number().over(order(seed + 1)).alias("_n"))
    null = best(labels.join(values, ["round", "_n"]), ["round"])
    obs = real.select(F.col("r").alias("observed"))
    return null.crossJoin(F.broadcast(obs)).groupBy("observed").agg(((F.sum((F.col("r") >= F.col("observed")).cast("int")) + 1) / (rounds + 1)).alias("perm_p"))


def bca(df: DataFrame, keys: list[str], x: str, rounds: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Bias-corrected, accelerated bootstrap interval of a mean, per key (a key's values are one sample)."""
    from statistics import NormalDist

    normal = NormalDist()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[x].dropna().to_numpy(float)
        out = {k: pdf[k].iloc[0] for k in keys} | {"n": len(v), "mean": float("nan"), "lo": float("nan"), "hi": float("nan")}
        if len(v) > 1:
            rng = np.random.default_rng(seed)
            boot = np.sort([v[rng.integers(0, len(v), len(v))].mean() for _ in range(rounds)])
            share = (np.count_nonzero(boot < v.mean()) + 0.5 * np.count_nonzero(boot == v.mean())) / rounds
            z0 = normal.inv_cdf(min(1 - 1e-6, max(1e-6, share)))
            jack = (v.sum() - v) / (len(v) - 1)
            d = jack.mean() - jack
            below = 6 * (d @ d) ** 1.5
            a = float((d**3).sum() / below) if below else 0.0
            ends = []
            for q in ((1 - level) / 2, (1 + level) / 2):
                z = z0 + normal.inv_cdf(q)
                ends.append(float(np.quantile(boot, normal.cdf(z0 + z / (1 - a * z)))))
            out |= {"mean": float(v.mean()), "lo": ends[0], "hi": ends[1]}
        return pd.DataFrame([out])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, mean double, lo double, hi double"])
    return df.select(*keys, x).groupBy(*keys).applyInPandas(one, schema)


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).count()
    total = lambda g: cells.groupBy(g).agg(F.sum("count").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("s"))
    both = cells.agg(F.sum(pairs(F.col("count"))).alias("ab"), F.sum("count").alias("n"))
    joined = both.crossJoin(total(a).withColumnRenamed("s", "sa")).crossJoin(total(b).withColumnRenamed("s", "sb"))
    expected = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2
    return joined.select(F.when(top != expected, (F.col("ab") - expected) / (top - expected)).otherwise(1.0).alias("ari"))


def maker_entry(df: DataFrame, path: Column, offset: float, wait: int) -> DataFrame:
    """A limit ``offset`` bps under the event fills at the first step within ``wait`` that reaches it."""
    fill = first_at(F.slice(path, 1, wait), lambda v: v <= -offset)
    d = df.withColumn("_p", path).withColumn("_f", fill)
    end = F.try_element_at(F.col("_p"), F.lit(-1))
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("_f").isNotNull().cast("double")).alias("fill_rate"),
        F.avg(F.when(F.col("_f").isNotNull(), end + offset)).alias("filled_mean"),
        F.avg(F.when(F.col("_f").isNull(), end)).alias("missed_mean"),
    )


ANNUAL = math.sqrt(252)
