"""Putting the model's table together: merges, gates, column choice from a catalog, and stream statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# -- rows -------------------------------------------------------------------
def collapse(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key: of every column the last value that isn't NULL."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest))


def merge_health(parts: list[DataFrame], keys: list[str], flags: list[str]) -> DataFrame:
    """Full outer join of the sources' health; a flag that a source lacks is 0."""
    merged = reduce(lambda a, b: a.join(b, keys, "full"), parts)
    return merged.withColumns({c: F.coalesce(c, F.lit(0)) for c in flags})


def with_context(bars: DataFrame, context: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """Bars with their bucket's context; what is missing takes the fill."""
    return bars.join(context, keys, "left").fillna(fill)


def merge_stages(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner join by time; columns take the frame's name as suffix."""
    named = [df.select(key, *(F.col(c).alias(f"{c}_{tag}") for c in df.columns if c != key)) for tag, df in frames.items()]
    return reduce(lambda a, b: a.join(b, key), named)


def usable(df: DataFrame, *flags: str) -> DataFrame:
    """Rows where every stream's flag is 1 (one flag: the gate of a single stream)."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == 1 for c in flags]))


# -- columns ----------------------------------------------------------------
def target_column(token: str, asset: str, families: dict[str, tuple[str, tuple[str, ...]]], default: str = "ret") -> str:
    """Column of a token ``<family>_<horizon>``, or of a bare horizon of the default family."""
    family, _, horizon = token.rpartition("_")
    family = family or default
    if family not in families or horizon not in families[family][1]:
        raise ValueError(f"no target {token!r}")
    return families[family][0].format(horizon=horizon, asset=asset)


def null_shares(df: DataFrame, columns: list[str], most: float = 0.95) -> DataFrame:
    """feature, share of NULLs, and kept (less than ``most``), in one pass."""
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return row.unpivot([], columns, "feature", "share").withColumn("kept", F.col("share") < most)


def axes(names: DataFrame, column: str = "feature") -> DataFrame:
    """Stem, depth, window and scope of a name; several tokens of an axis are joined by ``|``."""
    # How names spell the axes.
    kinds = [("depth", r"_(\d+bps|struct\d+)(?=_|$)"), ("window", r"_(\d+[smhd])(?=_|$)"), ("scope", r"_(fut|spot)(?=_|$)")]
    out = names.withColumn("stem", F.col(column))
    for kind, pattern in kinds:
        out = out.withColumn(kind, F.array_join(F.regexp_extract_all("stem", F.lit(pattern), F.lit(1)), "|")).withColumn("stem", F.regexp_replace("stem", pattern, ""))
    return out


def structural_drops(catalog: DataFrame, side: str = "mid", depth: str = "10bps", window: str = "60s") -> DataFrame:
    """Names of size-weighted prices (stem lwp_<side>) that aren't the one of their kind that is kept."""
    level = F.col("stem").rlike("^lwp_(mid|ask|bid)$") & (F.col("depth") != "") & (F.col("window") != "") & (F.col("scope") != "")
    kept = (F.col("stem") == f"lwp_{side}") & (F.col("depth") == depth) & (F.col("window") == window)
    return catalog.where(level & ~kept).select("feature")


def absolute_drops(catalog: DataFrame) -> DataFrame:
    """Names that carry an absolute price: levels, profiles but their migration, touch prices of a second, moving averages."""
    # Groups and names.
    touch = (F.col("kind") == "Price") & F.col("feature").rlike("^(best_bid|best_ask|mid|vwap)_(fut|spot)_1s$")
    profile = (F.col("kind") == "Volume Profile Artefact") & ~F.col("feature").startswith("poc_migration")
    trend = (F.col("kind") == "Trend") & F.col("feature").rlike(r"^ema_\d")
    return catalog.where((F.col("kind") == "Level Artefact") | profile | touch | trend).select("feature")


def bundle_drops(catalog: DataFrame, bundles: dict[str, list[str]], out: list[str]) -> DataFrame:
    """Names of the bundles that an ablation leaves out; a bundle lists stems."""
    stems = [s for b in out for s in bundles[b]]
    return catalog.where(F.col("stem").isin(stems)).select("feature")


def merge_drops(layers: dict[str, DataFrame]) -> DataFrame:
    """feature and layer: a name belongs to the first layer that drops it, so that merging again changes nothing."""
    tagged = [df.select("feature", F.lit(i).alias("place"), F.lit(name).alias("layer")) for i, (name, df) in enumerate(layers.items())]
    return reduce(DataFrame.unionByName, tagged).groupBy("feature").agg(F.min_by("layer", "place").alias("layer"))


def keep_list(catalog: DataFrame, drops: DataFrame, vif: DataFrame, most: float = 10.0) -> DataFrame:
    """Names that stay, with the least VIF over assets, and the profiles that may use them."""
    least = vif.groupBy("feature").agg(F.min("vif").alias("vif"))
    kept = catalog.join(drops, "feature", "left_anti").join(least, "feature", "left")
    return kept.withColumns({"use_tree": F.lit(True), "use_linear": F.coalesce(F.col("vif") < most, F.lit(False))})


def apply_log1p(df: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """log1p of the columns whose minimum isn't below zero; the others stay."""
    least = df.agg(*(F.min(c).alias(c) for c in columns)).first()  # a number for each column
    fit = [c for c in columns if least[c] is not None and least[c] >= -tolerance]
    return df.withColumns({c: F.log1p(F.greatest(F.col(c), F.when(F.col(c).isNotNull(), 0.0))) for c in fit})


def consensus(scores: DataFrame, r2: DataFrame) -> DataFrame:
    """Per feature the mean, weighted, least and most percentile rank over targets; weights are R2 above zero, equal if none is."""
    total = F.sum("w").over(Window.partitionBy())  # a row for each target
    weights = r2.select("target", F.greatest(F.col("r2"), F.lit(0.0)).alias("w"))
    weights = weights.withColumn("w", F.when(total > 0, F.col("w") / total).otherwise(1 / F.count("*").over(Window.partitionBy())))
    p = scores.withColumn("pct", 100 * (1 - F.col("rank") / F.count("*").over(Window.partitionBy("target")))).join(F.broadcast(weights), "target")
    out = p.groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.avg("pct").alias("mean_pct"), F.sum(F.col("pct") * F.col("w")).alias("weighted_pct"), F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"), F.count("*").alias("n_targets"))
    return out.withColumn("never_important", F.col("max_pct") < 20)


# -- evaluation -------------------------------------------------------------
def simple_backtest(df: DataFrame, keys: list[str], predicted: str, actual: str, spread_bps: float, share: float = 0.5, year: float = 365 * 24 * 3600.0) -> DataFrame:
    """Signal beyond a share of the spread, whole spread as cost, Sharpe ratio over ``year`` bars."""
    spread = spread_bps / 1e4
    p, y = F.col(predicted), F.col(actual)
    d = df.where(p.isNotNull() & y.isNotNull()).withColumn("s", F.when(p > spread * share, 1).when(p < -spread * share, -1).otherwise(0))
    net = F.when(F.col("s") != 0, F.col("s") * y - spread)
    return d.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("s") * y) * 1e4, F.lit(0.0)).alias("gross_bps"),
        F.coalesce(F.sum(net) * 1e4, F.lit(0.0)).alias("net_bps"),
        F.coalesce(F.when(F.stddev_pop(net) > 0, F.avg(net) / F.stddev_pop(net) * F.sqrt(F.lit(year))), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.avg(F.when(F.col("s") != 0, (F.signum(p) == F.signum(y)).cast("double"))), F.lit(0.0)).alias("hit_rate"),
        F.count(net).alias("n_trades"),
        F.avg((F.abs(p) > spread).cast("double")).alias("bridge_rate"),
    )


def strategies(df: DataFrame, keys: list[str], back: str, ahead: str, name: Column, fee: float, seed: int = 42) -> DataFrame:
    """Momentum (sign of the return before) and random (a sign from a seeded hash of ``name``), side by side."""
    drawn = F.when(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 1) < "8", -1).otherwise(1)
    sides = F.array(F.struct(F.lit("momentum").alias("strategy"), F.signum(back).cast("int").alias("s")), F.struct(F.lit("random").alias("strategy"), drawn.alias("s")))
    d = df.where(F.col(ahead).isNotNull()).select(*keys, ahead, F.explode(sides).alias("x")).select(*keys, ahead, "x.*").where("s <> 0")
    pnl = F.col("s") * F.col(ahead) - fee
    return d.groupBy("strategy", *keys).agg(
        F.count("*").alias("n_trades"),
        F.avg(pnl).alias("pnl"),
        F.avg((pnl > 0).cast("double")).alias("win_rate"),
        F.avg((F.col("s") == F.signum(ahead)).cast("double")).alias("dir_acc"),
        (F.avg(pnl) / (F.stddev_pop(pnl) + 1e-12) * F.sqrt(F.count("*"))).alias("sharpe"),
    )


def resolve_k(k: int, n: int, rows: int = 100) -> int:
    """Clusters that n rows can tell apart."""
    return max(2, min(k, n // rows))


def directed_accuracy(df: DataFrame, cluster: str, train: Column, direction: str, ret: str, cost: float, least_train: int = 10, least_test: int = 30, least_accuracy: float = 0.55) -> DataFrame:
    """Clusters whose majority direction in the training rows holds in the others, with their return there."""
    up = F.avg(F.when(train, (F.col(direction) > 0).cast("double")))
    majority = F.when(up > 0.5, 1).otherwise(-1)
    by = df.groupBy(cluster).agg(F.count(F.when(train, 1)).alias("n_train"), F.count(F.when(~train, 1)).alias("n_test"), majority.alias("majority"), F.avg(F.when(~train & (F.col(direction) != 0), (F.col(direction) > 0).cast("double"))).alias("up"), F.avg(F.when(~train, F.col(ret))).alias("r"))
    enough = F.col("n_test") >= least_test
    out = by.where(F.col("n_train") >= least_train).withColumns({"da_oos": F.when(enough, F.when(F.col("majority") > 0, F.col("up")).otherwise(1 - F.col("up"))), "pnl_oos": F.when(enough, F.col("r") * F.col("majority") - cost)})
    return out.drop("up", "r").withColumn("good", F.coalesce((F.col("da_oos") > least_accuracy) & (F.col("pnl_oos") > 0), F.lit(False)))


def screen(results: DataFrame, config: list[str], score: str, tie: str, least: float, across: str, values: list[str]) -> DataFrame:
    """Best result of each config that reaches ``least``, with the values of ``across`` as columns."""
    best = results.where(F.col(score) >= least).groupBy(*config, across).agg(F.max_by(score, F.struct(score, tie)).alias("best"))
    return best.groupBy(*config).pivot(across, values).agg(F.max("best"))


# -- streams ----------------------------------------------------------------
def moving_counts(events: DataFrame, ts: str, keys: list[str], span: str, step: str) -> DataFrame:
    """Rows and mean value in windows of ``span`` that begin every ``step``; the same on a stream with a watermark."""
    w = F.window(ts, span, step)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def parsed(events: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column's fields as columns; text that isn't JSON gives NULL."""
    return events.withColumn("_json", F.from_json(column, schema)).select("*", "_json.*").drop("_json")


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trades by side, and range and volume of those with a price and a quantity above zero."""
    good = (F.col("price") > 0) & (F.col("qty") > 0)
    worth = F.when(good, F.col("price") * F.col("qty"))
    sides = {f"n_{s}": F.count(F.when(F.col("side") == s, 1)) for s in ("buy", "sell", "unknown")}
    priced = F.when(F.col("price") > 0, F.col("price"))
    return trades.groupBy(*keys).agg(*(c.alias(n) for n, c in sides.items()), F.min(priced).alias("least"), F.max(priced).alias("most"), F.sum(worth).alias("total"), F.avg(worth).alias("mean"))


def book_stats(book: DataFrame, keys: list[str], bid: str, ask: str, wanted: str, actual: str, least: float = 0.5) -> DataFrame:
    """Crossed rows, spread in basis points of the others, and rows whose depth falls short."""
    valid = (F.col(bid) > 0) & (F.col(ask) > 0)
    spread = F.when(valid & (F.col(bid) < F.col(ask)), (F.col(ask) - F.col(bid)) / ((F.col(ask) + F.col(bid)) / 2) * 1e4)
    short = (F.col(wanted) > 0) & (F.col(actual) < F.floor(F.col(wanted) * least))
    at = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    return book.groupBy(*keys).agg(F.count(F.when(valid & (F.col(bid) >= F.col(ask)), 1)).alias("crossed"), F.avg(spread).alias("mean"), *(F.percentile(spread, F.lit(q)).alias(n) for n, q in at.items()), F.count(F.when(short, 1)).alias("short"))
