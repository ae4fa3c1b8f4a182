"""Models walked forward: fit on the blocks before, predict the next, trade on the predictions.

A model is a plug-in: ``model_fn(seed)`` gives an object whose ``fit(train)``
returns one whose ``transform(test)`` adds ``y_pred``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import ari, global_rank


class Ridge:
    """Least squares with a penalty on the centred columns; a missing input takes the mean of the training rows.

    Moments are gathered in two aggregations; what the driver solves has the size of the columns only.
    """

    def __init__(self, columns: list[str], target: str = "y_true", penalty: float = 1.0):
        self.columns, self.target, self.penalty = columns, target, penalty

    def fit(self, train: DataFrame) -> Ridge:
        train = train.where(F.col(self.target).isNotNull())
        self.means = [m or 0.0 for m in train.agg(*(F.avg(c) for c in [*self.columns, self.target])).first()]
        x, n = self._centred(), len(self.columns)
        y = F.col(self.target) - self.means[-1]
        cells = [(i, j) for i in range(n) for j in range(i, n)]
        got = [v or 0.0 for v in train.agg(*(F.avg(x[i] * x[j]) for i, j in cells), *(F.avg(a * y) for a in x)).first()]
        a = np.zeros((n, n))
        for (i, j), v in zip(cells, got, strict=False):
            a[i, j] = a[j, i] = v
        self.weights = np.linalg.solve(a + self.penalty * np.eye(n), np.array(got[len(cells) :])).tolist()
        return self

    def _centred(self) -> list[Column]:
        return [F.coalesce(F.col(c) - m, F.lit(0.0)) for c, m in zip(self.columns, self.means, strict=False)]

    def transform(self, test: DataFrame) -> DataFrame:
        return test.withColumn("y_pred", sum((a * w for a, w in zip(self._centred(), self.weights, strict=True)), F.lit(self.means[-1])))


class Boosted:
    """Boosted trees; ``y_pred`` is the probability of label 1. A missing input takes the training rows' median."""

    def __init__(self, columns: list[str], target: str, seed: int = 0, rounds: int = 20, depth: int = 3):
        self.columns, self.target, self.seed, self.rounds, self.depth = columns, target, seed, rounds, depth

    def fit(self, train: DataFrame) -> Boosted:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import Imputer, VectorAssembler

        filled = [f"_{c}" for c in self.columns]
        steps = [
            Imputer(strategy="median", inputCols=self.columns, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_x"),
            GBTClassifier(featuresCol="_x", labelCol=self.target, predictionCol="_class", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed).setProbabilityCol("_both").setRawPredictionCol("_raw"),
        ]
        self.model = Pipeline(stages=steps).fit(train.where(F.col(self.target).isNotNull()))
        self.drop = [*filled, "_x", "_class", "_both", "_raw"]
        return self

    def transform(self, test: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.model.transform(test).withColumn("y_pred", vector_to_array("_both")[1]).drop(*self.drop)


class Bins:
    """Clusters one column by quantiles of the training rows: the simplest clusterer that can be carried over."""

    def __init__(self, column: str, shares: list[float]):
        self.column, self.shares = column, shares

    def fit(self, train: DataFrame) -> Bins:
        self.cuts = [c for c in train.agg(F.percentile(self.column, F.array(*map(F.lit, self.shares)))).first()[0] or []]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cluster", sum(((F.col(self.column) > c).cast("int") for c in self.cuts), F.lit(0)))


def cross_validate(df: DataFrame, order: list[str], k: int, model_fn: Callable, seeds: tuple[int, ...] = (0,), target: str = "y_true", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predictions out of sample over expanding folds and seeds: event_index (place in the whole order), fold, seed, target, y_pred.

    Rows without target are left out first. Blocks have n // (k + 1) rows; fold i
    trains on the blocks before i. Each fold reads ``df`` anew: hand in a table.
    """
    ranked = global_rank(df.where(F.col(target).isNotNull()), order)
    size = max(1, ranked.count() // (k + 1))
    block = F.floor(F.col("rank") / size)
    out = []
    for fold in range(1, k + 1):
        train, test = ranked.where(block < fold).drop("rank"), ranked.where(block == fold).withColumnRenamed("rank", "event_index")
        for seed in seeds:
            got = model_fn(seed).fit(train).transform(test)
            out.append(got.select("event_index", F.lit(fold).alias("fold"), F.lit(seed).alias("seed"), *keep, target, "y_pred"))
    return reduce(DataFrame.unionByName, out)


def stability(df: DataFrame, order: list[str], blocks: int, model_fn: Callable, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """Agreement of clusterings (adjusted Rand index): each block's own with the whole sample's, and with the block's before.

    For the latter the clusters learned on block b - 1 are assigned to block b,
    so that nothing of the whole sample leaks in. With several seeds, each
    seed's whole clustering is held against the first seed's as well.
    """
    ranked = global_rank(df, order)
    size = max(1, ranked.count() // blocks)
    d = ranked.withColumn("block", F.least(F.floor(F.col("rank") / size), F.lit(blocks - 1)))
    label = lambda model, rows, name: model.transform(rows).withColumnRenamed("cluster", name)
    out = []
    for seed in seeds:
        whole, before = model_fn(seed).fit(d), None
        for b in range(blocks):
            part = d.where(F.col("block") == b)
            own = model_fn(seed).fit(part)
            mine = label(own, part, "own")
            out.append(ari(label(whole, mine, "other"), "own", "other").select(F.lit("whole").alias("against"), F.lit(b).alias("block"), F.lit(seed).alias("seed"), "ari"))
            if before is not None:
                out.append(ari(label(before, mine, "other"), "own", "other").select(F.lit("before").alias("against"), F.lit(b).alias("block"), F.lit(seed).alias("seed"), "ari"))
            before = own
        if seed != seeds[0]:
            both = label(whole, label(model_fn(seeds[0]).fit(d), d, "own"), "other")
            out.append(ari(both, "own", "other").select(F.lit("seed").alias("against"), F.lit(None).cast("int").alias("block"), F.lit(seed).alias("seed"), "ari"))
    return reduce(DataFrame.unionByName, out)


def rolling_stability(df: DataFrame, order: list[str], blocks: int, width: int, model_fn: Callable, seed: int = 0) -> DataFrame:
    """Clusters learned on ``width`` blocks against those of the same blocks moved on by one, on the blocks both hold."""
    ranked = global_rank(df, order)
    size = max(1, ranked.count() // blocks)
    d = ranked.withColumn("block", F.least(F.floor(F.col("rank") / size), F.lit(blocks - 1)))
    models = [model_fn(seed).fit(d.where(F.col("block").between(s, s + width - 1))) for s in range(blocks - width + 1)]
    out = []
    for s, (a, b) in enumerate(zip(models, models[1:], strict=False), 1):
        shared = d.where(F.col("block").between(s, s + width - 2))
        both = b.transform(a.transform(shared).withColumnRenamed("cluster", "own")).withColumnRenamed("cluster", "other")
        out.append(ari(both, "own", "other").select(F.lit(s).alias("start"), "ari"))
    return reduce(DataFrame.unionByName, out)


def compare_directions(events: DataFrame, predictions: DataFrame, cluster: str = "cluster", direction: str = "direction", share: float = 0.6, least: int = 30) -> DataFrame:
    """A model's directional accuracy against the majority of each event's cluster, over the same events.

    A cluster's majority is that of the first ``share`` of the events by event_index
    (up on a tie); only later events count, and of them those with a prediction and a
    move. One row for all (cluster NULL) and one per cluster of ``least`` events.
    ``event_index`` must be unique on both sides.
    """
    ranked = global_rank(events.withColumn("_part", F.floor(F.col("event_index") / (1 << 16))), ["_part", "event_index"])
    cut = int(ranked.count() * share)
    way = ranked.where(F.col("rank") < cut).groupBy(cluster).agg(F.when(F.avg(direction) < 0, -1.0).otherwise(1.0).alias("_way"))
    later = ranked.where(F.col("rank") >= cut).select("event_index", cluster)
    d = later.join(way, cluster).join(predictions.select("event_index", "y_true", "y_pred"), "event_index").where("y_true <> 0")
    real = F.signum("y_true")
    d = d.withColumns({"_model": F.coalesce((F.signum("y_pred") == real).cast("double"), F.lit(0.0)), "_cluster": (F.col("_way") == real).cast("double")})
    by = d.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum("_model").alias("a"), F.sum("_cluster").alias("b"))
    kind = dict(by.dtypes)[cluster]
    whole = by.agg(F.lit(None).cast(kind).alias(cluster), F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).where("n > 0")
    both = whole.unionByName(by.where(F.col("n") >= least))
    return both.select(cluster, "n", (F.col("a") / F.col("n")).alias("model_da"), (F.col("b") / F.col("n")).alias("cluster_da"), ((F.col("b") - F.col("a")) / F.col("n")).alias("gain"))


def shortlist(results: DataFrame, ratio: str, accuracy: str, n: str) -> DataFrame:
    """Candidates worth a second look: ratio at least 1, accuracy over 0.55, at least 100 events. NULL isn't."""
    return results.where((F.col(ratio) >= 1) & (F.col(accuracy) > 0.55) & (F.col(n) >= 100))


def exit_steps(path: Column, mfe: Column, cost: float, least: float = 5.0, share: float = 0.6, hold: int = 3, ahead: int = 10) -> Column:
    """Steps a trade might have been left at, as (k, value, label); none where the best value doesn't pay.

    Label 1: the value is at least ``share`` of the best, over cost and ``least``, and the
    next steps don't rise by more than 15 %. The labels know what comes; inputs must not.
    """
    floor = cost + least

    def one(v, i):
        soon = F.array_max(F.slice(path, i + 2, ahead))
        near = F.coalesce(soon <= v * 1.15, F.lit(True))
        return F.struct((i + 1).alias("k"), v.alias("value"), ((v >= share * mfe) & (v > floor) & near).cast("int").alias("label"))

    steps = F.filter(F.transform(path, one), lambda s: s["k"] >= hold)
    return F.when(mfe >= floor, steps).otherwise(F.array().cast("array<struct<k:int,value:double,label:int>>"))


def leave_at(path: Column, scores: Column, threshold: float, sl: Column) -> Column:
    """Value at the first step whose score reaches the threshold, -sl if the path falls there first, else the last value."""
    steps = F.arrays_zip(path.alias("v"), scores.alias("s"))
    hit = F.get(F.filter(steps, lambda z: (z["v"] <= -sl) | (z["s"] >= threshold)), 0)
    return F.when(hit.isNull(), F.try_element_at(path, F.lit(-1))).when(hit["v"] <= -sl, -sl).otherwise(hit["v"])


def cell_rates(df: DataFrame, block: str, cell: str, label: str, folds: int) -> DataFrame:
    """(fold, cell, rate): smoothed share of label 1 in the blocks before each fold, from one count per (block, cell)."""
    m = df.where(F.col(label).isNotNull() & (F.col(block) < folds)).groupBy(block, cell).agg(F.count(label).alias("n"), F.sum(label).alias("s"))
    m = m.withColumn("fold", F.explode(F.sequence(F.col(block) + 1, F.lit(folds))))
    return m.groupBy("fold", cell).agg(((F.sum("s") + 1) / (F.sum("n") + 2)).alias("rate"))


def tradability(events: DataFrame, path: str, block: str, cell: str, step_cell: Callable[[Column, Column], Column], folds: int, entries: list[float], leaves: list[float], costs: dict[str, float], paid: float) -> DataFrame:
    """Net result per trade of entering by predicted continuation or reversal and leaving by fixed or learned exits.

    Per fold, all from the blocks before it: the share of continuations per
    ``cell`` (the entry model), medians and 75 % quantiles of best and worst values
    (take profit, stop loss), and the share of good steps per ``step_cell`` (the exit
    model, with the 75 % stop behind it). Means are over folds, n is summed.
    ``step_cell`` must give a bounded number of cells, since a fold's cells travel as
    one map. Quantiles are exact: they hold a fold's different values in one task.
    """
    p = F.col(path)
    e = events.where((F.size(p) > 0) & (F.col(block) <= folds)).withColumn(block, F.col(block).cast("int"))
    e = e.withColumns({"_up": (F.try_element_at(p, F.lit(-1)) > 0).cast("int"), "_mfe": F.array_max(p), "_mae": -F.array_min(p)})
    used = e.select(block, cell, path, "_up", "_mfe", "_mae", F.explode(F.sequence(F.greatest(F.lit(1), F.col(block)), F.lit(folds))).alias("fold"))
    train, test = F.col(block) < F.col("fold"), F.col(block) == F.col("fold")
    rates = cell_rates(e, block, cell, "_up", folds)
    half = lambda c, q: F.percentile(c, F.lit(q))
    marks = used.where(train).groupBy("fold").agg(*(half(c, q).alias(f"{n}{int(q * 100)}") for n, c in (("tp", "_mfe"), ("sl", "_mae")) for q in (0.5, 0.75)))
    scored = used.join(rates, ["fold", cell], "left").withColumn("proba", F.coalesce("rate", F.lit(0.5)))
    sign = F.when(F.col("proba") >= 0.5, 1.0).otherwise(-1.0)
    scored = scored.withColumn("traded", F.transform(p, lambda v: v * sign))
    t = F.col("traded")
    steps = scored.where(train).select("fold", F.explode(exit_steps(t, F.array_max(t), paid)).alias("s"))
    good = steps.groupBy("fold", step_cell(F.col("s.k"), F.col("s.value")).alias("c")).agg(((F.sum("s.label") + 1) / (F.count("s.label") + 2)).alias("r"))
    table = good.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("c", "r"))).alias("good"))
    trades = scored.where(test).join(F.broadcast(marks), "fold").join(table, "fold", "left")
    trades = trades.withColumn("scores", F.transform(t, lambda v, i: F.coalesce(F.try_element_at(F.col("good"), step_cell(i + 1, v)), F.lit(0.0))))
    made = []
    for et in entries:
        take = (F.col("proba") >= et) | (F.col("proba") <= 1 - et)
        made += [F.when(take, F.struct(F.lit(et).alias("entry"), F.lit(f"tp{a}_sl{b}").alias("exit"), tp_sl_at(t, F.col(f"tp{a}"), F.col(f"sl{b}")).alias("gross"))) for a in (50, 75) for b in (50, 75)]
        made += [F.when(take, F.struct(F.lit(et).alias("entry"), F.lit(f"leave{x}").alias("exit"), leave_at(t, F.col("scores"), x, F.col("sl75")).alias("gross"))) for x in leaves]
    g = trades.select("fold", F.explode(F.array(*made)).alias("m")).where("m IS NOT NULL").select("fold", "m.*")
    paying = F.explode(F.array(*(F.struct(F.lit(n).alias("cost"), F.lit(c).alias("paid")) for n, c in costs.items())))
    net = g.withColumn("c", paying).select("fold", "entry", "exit", "c.cost", (F.col("gross") - F.col("c.paid")).alias("net"))
    by_fold = net.groupBy("entry", "exit", "cost", "fold").agg(F.count("net").alias("n"), F.avg("net").alias("net"), F.avg((F.col("net") > 0).cast("double")).alias("win"))
    return by_fold.groupBy("entry", "exit", "cost").agg(F.sum("n").alias("n"), F.avg("net").alias("mean_net"), F.avg("win").alias("win"))


def tp_sl_at(path: Column, tp: Column, sl: Column) -> Column:
    """As ``tp_sl`` without a timeout, for levels that are columns."""
    hit = F.get(F.filter(path, lambda v: (v >= tp) | (v <= -sl)), 0)
    return F.when(hit.isNull(), F.try_element_at(path, F.lit(-1))).when(hit >= tp, tp).otherwise(-sl)
