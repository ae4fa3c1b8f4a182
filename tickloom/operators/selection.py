"""Feature reduction: correlations, greedy drops, collinearity, importance verdicts and transforms."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import correlation


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]], least: int = 30) -> DataFrame:
    """Pearson per pair over the rows where both are there: one aggregation for all pairs.

    NULL with fewer than ``least`` rows or no variance; cut to [-1, 1].
    """
    made = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        n = F.count(x)
        r = correlation(x, y)
        told = (n >= least) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
        made.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), F.when(told & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("rho")))
    return df.agg(F.array(*made).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def group_summary(pairs: DataFrame, key: str) -> DataFrame:
    r = F.abs("rho")
    return pairs.groupBy(key).agg(
        F.count("rho").alias("n_pairs"),
        F.avg(r).alias("mean_abs"),
        F.percentile(r, F.lit(0.5)).alias("median_abs"),
        F.max(r).alias("max_abs"),
        F.sum((r > 0.95).cast("int")).cast("long").alias("over_95"),
        F.sum((r > 0.85).cast("int")).cast("long").alias("over_85"),
    )


def drop_by_order(pairs: list[tuple[str, str, float]], order: dict[str, int], threshold: float) -> list[str]:
    """From the strongest pair down: the member later in ``order`` goes unless either is gone."""
    gone: list[str] = []
    for a, b, r in sorted(pairs, key=lambda p: (-abs(p[2]), p[0], p[1])):
        if abs(r) > threshold and a not in gone and b not in gone:
            gone.append(a if order[a] > order[b] else b)
    return gone


def drop_most_paired(pairs: list[tuple[str, str, float]], threshold: float, strict: bool = True) -> list[str]:
    """The feature in most remaining pairs over the threshold goes, again and again."""
    left = [(a, b) for a, b, r in pairs if (abs(r) > threshold if strict else abs(r) >= threshold)]
    gone: list[str] = []
    while left:
        counts: dict[str, int] = {}
        for pair in left:
            for x in pair:
                counts[x] = counts.get(x, 0) + 1
        worst = max(sorted(counts), key=counts.__getitem__)
        gone.append(worst)
        left = [p for p in left if worst not in p]
    return gone


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation: diagonal of the inverse correlation matrix, eigenvalues lifted where it is near singular, 1 at least."""
    rows = pair_correlations(df, list(combinations(columns, 2)), 2).collect()  # one for each pair of columns
    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for r in rows:
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["rho"] or 0.0
    values, vectors = np.linalg.eigh(m)
    if values.min() < 1e-6:
        m = vectors @ np.diag(np.maximum(values, 1e-4)) @ vectors.T
    return {c: max(1.0, float(v)) for c, v in zip(columns, np.diag(np.linalg.inv(m)), strict=True)}


def log1p_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """What the log1p rules look at, for all columns in one aggregation; skewness is bias-corrected."""
    made = []
    for c in columns:
        x = F.col(c)
        n = F.count(x).cast("double")
        g = F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
        made.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.sum((x < 0).cast("int")).cast("long").alias("negative"), F.countDistinct(x).alias("n_unique"), F.percentile(x, F.lit(0.99)).alias("p99"), g.alias("skew")))
    return df.agg(F.array(*made).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def log1p_class(profile: DataFrame, least: int = 100) -> DataFrame:
    """Ordered rules: too few rows, negatives, few values, then by skewness 3.0 and 1.5."""
    c = F.when(F.col("n") < least, "too_few").when(F.col("negative") > 0, "negative").when(F.col("n_unique") <= 3, "discrete")
    return profile.withColumn("class", c.when(F.col("skew") > 3.0, "apply").when(F.col("skew") > 1.5, "candidate").otherwise("keep"))


def weak_verdict(gains: DataFrame) -> DataFrame:
    """Per asset and feature: weak if gain over null is 1 or less on every target seen."""
    g = gains.withColumn("over", F.when(F.col("null_gain") > 0, F.col("gain") / F.col("null_gain")).when(F.col("gain") > 0, F.lit(float("inf"))).otherwise(0.0))
    return g.groupBy("asset", "feature").agg(F.count(F.lit(1)).alias("n_targets"), F.max("over").alias("best"), (F.max("over") <= 1).alias("weak"))


_WINDOW = re.compile(r"_(\d+s|fut|spot|ask|bid|\d+bps|a\d)$")


def base_concept(name: str) -> str:
    """Windows, scope and depth tokens stripped from the end until nothing changes."""
    while (short := _WINDOW.sub("", name)) != name:
        name = short
    return name


def keep_list(features: DataFrame, *drops: DataFrame) -> DataFrame:
    """Features in no drop list."""
    for d in drops:
        features = features.join(d.select("feature").distinct(), "feature", "left_anti")
    return features


def audit(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One pass: rows that break each rule (an expression that should hold; NULL isn't a breach)."""
    made = [F.struct(F.lit(n).alias("rule"), F.sum((~F.coalesce(F.expr(e), F.lit(True))).cast("int")).cast("long").alias("n_bad")) for n, e in rules.items()]
    return df.agg(F.array(*made).alias("p")).select(F.explode("p").alias("p")).select("p.*")
