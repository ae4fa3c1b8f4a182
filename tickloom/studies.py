"""Queries of the selection and evaluation operators, with their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import BARS_SQL, bars
from .operators import evaluate, exits, selection
from .sources import feeds, tables

COLUMNS = ["trade_count", "volume", "px", "gap", "b1", "b5"]
#: Path values are multiples of 0.5, so that these lie between them.
L, TP, SL, OFFSET = 10, 600.25, 500.25, 400.25


def _r(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.round(F.col(c).cast("double"), digits).alias(c) for c in df.columns))


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(selection.pair_correlations(bars(spark, sf_dir), list(combinations(COLUMNS, 2))), "a", "b", "n")


CORRELATIONS_SQL = f"WITH {BARS_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS rho FROM bars" for a, b in combinations(COLUMNS, 2))


def correlation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = selection.pair_correlations(bars(spark, sf_dir), list(combinations(COLUMNS, 2)))
    return _r(selection.group_summary(pairs, "a"), "a", "n_pairs", "over_95", "over_85")


GROUPS_SQL = f"SELECT a, count(rho) AS n_pairs, round(avg(abs(rho)), 6) AS mean_abs, round(median(abs(rho)), 6) AS median_abs, round(max(abs(rho)), 6) AS max_abs, count(*) FILTER (abs(rho) > 0.95) AS over_95, count(*) FILTER (abs(rho) > 0.85) AS over_85 FROM ({CORRELATIONS_SQL.replace('round(corr', '(corr').replace(', 6) AS rho', ') AS rho')}) GROUP BY a"


def log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = selection.log1p_class(selection.log1p_profile(bars(spark, sf_dir), COLUMNS))
    return _r(p, "feature", "n", "negative", "n_unique", "class")


LOG1P_SQL = f"WITH {BARS_SQL}, p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, count(*) FILTER ({c} < 0) AS negative, count(DISTINCT {c}) AS n_unique, quantile_cont({c}, 0.99) AS p99, skewness({c}) AS skew FROM bars" for c in COLUMNS) + ") SELECT feature, n, negative, n_unique, round(p99, 6) AS p99, round(skew, 6) AS skew, CASE WHEN n < 100 THEN 'too_few' WHEN negative > 0 THEN 'negative' WHEN n_unique <= 3 THEN 'discrete' WHEN skew > 3.0 THEN 'apply' WHEN skew > 1.5 THEN 'candidate' ELSE 'keep' END AS class FROM p"

RULES = {"price": "px > 0", "range": "hi >= lo", "mid": "abs(px - (hi + lo) / 2) < 1e-9", "balance": "buy + sell <= volume + 1e-9", "signed": "abs(signed_volume - (buy - sell)) < 1e-9", "bands": "b1 <= b2 AND b2 <= b5", "busy": "trade_count >= 3"}


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.audit(bars(spark, sf_dir), RULES)


AUDIT_SQL = f"WITH {BARS_SQL}, b AS (SELECT *, buy - sell AS signed_volume FROM bars) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({e}, true)) AS n_bad FROM b" for n, e in RULES.items())


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tomorrow's move against a naive guess: the reverse of today's."""
    w = Window.partitionBy("asset").orderBy("bucket")
    b = bars(spark, sf_dir).select("asset", "bucket", "px")
    return b.withColumns({"y_true": F.lead("px").over(w) - F.col("px"), "y_pred": (F.lag("px").over(w) - F.col("px")) / 2})


_PRED_SQL = f"{BARS_SQL}, pred AS (SELECT asset, bucket, lead(px) OVER w - px AS y_true, (lag(px) OVER w - px) / 2 AS y_pred FROM bars WINDOW w AS (PARTITION BY asset ORDER BY bucket))"
K = 4


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.folds(_predictions(spark, sf_dir), ["bucket", "asset"], K).where("block >= 1")
    return _r(evaluate.fold_metrics(p, ["block"]), "block", "n")


METRICS_SQL = f"""
WITH {_PRED_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY bucket, asset) - 1 AS i, (SELECT count(*) FROM pred) // {K + 1} AS size FROM pred),
f AS (SELECT CAST(i // size AS BIGINT) AS block, y_true AS y, y_pred AS p FROM n WHERE i // size BETWEEN 1 AND {K} AND y_true IS NOT NULL AND y_pred IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY y) + (count(*) OVER (PARTITION BY block, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY block ORDER BY p) + (count(*) OVER (PARTITION BY block, p) - 1) / 2.0 AS rp FROM f),
g AS (SELECT block, count(*) AS n, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v, avg(CASE WHEN y <> 0 AND p <> 0 THEN (sign(y) = sign(p))::INT END) AS da, corr(ry, rp) AS ic,
  count(*) FILTER (y > 0 AND p > 0)::DOUBLE AS tp, count(*) FILTER (y < 0 AND p < 0)::DOUBLE AS tn, count(*) FILTER (y < 0 AND p > 0)::DOUBLE AS fp, count(*) FILTER (y > 0 AND p < 0)::DOUBLE AS fn FROM r GROUP BY block)
SELECT block, n, round(1 - mse / v, 6) AS r2, round(mse, 6) AS mse, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse, round(da, 6) AS da, round(ic, 6) AS ic,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM g
"""
THRESHOLDS = [0.0, 50.0, 150.0, 400.0]


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(evaluate.threshold_backtest(_predictions(spark, sf_dir), ["asset"], THRESHOLDS, 2.0), "asset", "n_trades")


BACKTEST_SQL = f"""
WITH {_PRED_SQL}, x AS (SELECT asset, y_true AS y, y_pred AS p, unnest([{', '.join(map(str, THRESHOLDS))}]) AS threshold FROM pred WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
s AS (SELECT asset, threshold, CASE WHEN p > threshold THEN y - 2.0 WHEN p < -threshold THEN -y - 2.0 END AS pnl FROM x)
SELECT asset, CAST(threshold AS DOUBLE) AS threshold, count(pnl) AS n_trades, round(coalesce(sum(pnl), 0), 6) AS pnl, round(avg((pnl > 0)::INT), 6) AS win_rate,
  round(CASE WHEN stddev_pop(pnl) > 1e-12 THEN avg(pnl) / stddev_pop(pnl) * sqrt(count(pnl)) END, 6) AS sharpe FROM s GROUP BY asset, threshold
"""


def breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    return evaluate.breakout_counts(p, {"true": "y_true", "pred": "y_pred"}, THRESHOLDS)


BREAKOUTS_SQL = f"""
WITH {_PRED_SQL}, v AS (SELECT 'true' AS "window", y_true AS v FROM pred UNION ALL SELECT 'pred', y_pred FROM pred)
SELECT "window", CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (v > threshold) AS up, count(*) FILTER (v < -threshold) AS down
FROM (SELECT *, unnest([{', '.join(map(str, THRESHOLDS))}]) AS threshold FROM v) GROUP BY 1, 2
"""
MOVE, GAP = 300.0, 7


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the price moved by more than MOVE, with the path of the days that follow."""
    w = Window.partitionBy("asset").orderBy("bucket")
    b = bars(spark, sf_dir).select("asset", "bucket", "px").withColumn("i", (F.row_number().over(w)).cast("long"))
    b = b.withColumn("move", F.col("px") - F.lag("px").over(w)).withColumn("ret", (F.lead("px").over(w) - F.col("px")) / 10000)
    b = b.withColumn("path", evaluate.paths(b, ["asset"], "bucket", "ret", L, F.signum("move")))
    return b.where(F.abs("move") > MOVE)


def excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    p = F.col("path")
    made = evaluate.excursion(p) | {
        "t_up": evaluate.first_at(p, lambda v: v >= 200.25),
        "exit": evaluate.tp_sl(p, TP, SL, L),
        "trail": evaluate.trailing(p, OFFSET, L),
    }
    return _r(e.select("asset", F.col("bucket").cast("string").alias("bucket"), *(c.alias(n) for n, c in made.items())), "asset", "bucket")


_EVENTS_SQL = f"""{BARS_SQL}, n AS (SELECT asset, bucket, px, row_number() OVER w AS i, px - lag(px) OVER w AS move, lead(px) OVER w - px AS nxt FROM bars WINDOW w AS (PARTITION BY asset ORDER BY bucket)),
ev AS (SELECT * FROM n WHERE abs(move) > {MOVE}),
st AS (SELECT e.asset, e.bucket, n.i - e.i AS k, CASE WHEN n.i IS NOT NULL THEN sign(e.move) * sum(coalesce(n.nxt, 0)) OVER (PARTITION BY e.asset, e.i ORDER BY n.i) END AS v FROM ev e LEFT JOIN n ON n.asset = e.asset AND n.i > e.i AND n.i <= e.i + {L})"""
EXCURSIONS_SQL = f"""
WITH {_EVENTS_SQL}, tr AS (SELECT *, max(v) OVER (PARTITION BY asset, bucket ORDER BY k) AS top FROM st),
g AS (SELECT asset, bucket, max(v) AS mfe, min(v) AS mae, arg_max(v, k) AS terminal, arg_max(k, (v, -k)) AS t_mfe, min(k) FILTER (v >= 200.25) AS t_up,
  min(k) FILTER (v >= {TP}) AS u, min(k) FILTER (v <= -{SL}) AS d, arg_min(v, k) FILTER (top > {OFFSET} AND v <= top - {OFFSET}) AS tr FROM tr GROUP BY asset, bucket)
SELECT asset, CAST(bucket AS VARCHAR) AS bucket, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(terminal, 6) AS terminal, CAST(t_mfe AS DOUBLE) AS t_mfe, CAST(t_up AS DOUBLE) AS t_up,
  round(CASE WHEN u IS NOT NULL AND u <= coalesce(d, 9999) THEN {TP} WHEN d IS NOT NULL THEN -{SL} ELSE terminal END, 6) AS exit, round(coalesce(tr, terminal), 6) AS trail FROM g
"""


def spaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.spaced(_events(spark, sf_dir).select("asset", "i", "move"), ["asset"], "i", GAP).select("asset", "i", "move")


SPACED_SQL = f"""
WITH RECURSIVE {_EVENTS_SQL.strip()}, taken AS (
  SELECT asset, min(i) AS i FROM ev GROUP BY asset
  UNION ALL
  SELECT t.asset, (SELECT min(e.i) FROM ev e WHERE e.asset = t.asset AND e.i >= t.i + {GAP}) AS i FROM taken t WHERE t.i IS NOT NULL)
SELECT asset, i, move FROM taken JOIN ev USING (asset, i)
"""


def maker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(evaluate.maker_entry(_events(spark, sf_dir), F.col("path"), 150.25, 4), "n")


MAKER_SQL = f"""
WITH {_EVENTS_SQL}, g AS (SELECT asset, bucket, bool_or(k <= 4 AND v <= -150.25) AS hit, arg_max(v, k) AS last FROM st GROUP BY asset, bucket)
SELECT count(*) AS n, round(avg(coalesce(hit, false)::INT), 6) AS fill_rate, round(avg(last + 150.25) FILTER (coalesce(hit, false)), 6) AS filled_mean, round(avg(last) FILTER (NOT coalesce(hit, false)), 6) AS missed_mean FROM g
"""


SHARES = [0.1, 0.5, 0.9]


def path_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    made = evaluate.excursion(F.col("path"))
    d = e.select("asset", *(made[c].alias(c) for c in ("mfe", "mae", "terminal")))
    return _r(exits.quantile_table(d, ["mfe", "mae", "terminal"], SHARES, ["asset"]), "asset", "measure", "share")


PATH_QUANTILES_SQL = f"WITH {_EVENTS_SQL}, g AS (SELECT asset, bucket, max(v) AS mfe, min(v) AS mae, arg_max(v, k) AS terminal FROM st GROUP BY asset, bucket) " + " UNION ALL ".join(
    f"SELECT asset, '{c}' AS measure, CAST({s} AS DOUBLE) AS share, round(quantile_cont({c}, {s}), 6) AS value FROM g GROUP BY asset" for c in ("mfe", "mae", "terminal") for s in SHARES
)


def average_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(exits.average_path(_events(spark, sf_dir), "path", ["asset"]), "asset", "step", "n")


AVERAGE_PATHS_SQL = f"WITH {_EVENTS_SQL} SELECT asset, CAST(k - 1 AS INT) AS step, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM st WHERE k IS NOT NULL GROUP BY asset, k"
LEVELS = [100.25, 400.25]


def level_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(exits.level_times(_events(spark, sf_dir), "path", LEVELS, ["asset"]), "asset", "level")


LEVEL_TIMES_SQL = f"""
WITH {_EVENTS_SQL}, h AS (SELECT asset, bucket, level, min(k) FILTER (v >= level) AS t FROM st, (SELECT unnest({LEVELS}::DOUBLE[]) AS level) GROUP BY ALL)
SELECT asset, level, round(avg((t IS NOT NULL)::INT), 6) AS hit_rate, round(avg(t), 6) AS mean_t, round(quantile_cont(t, 0.25), 6) AS p25_t, round(quantile_cont(t, 0.5), 6) AS p50_t, round(quantile_cont(t, 0.75), 6) AS p75_t FROM h GROUP BY ALL
"""
GRID = [(200.25, 200.25, 5), (400.25, 200.25, 10), (200.25, 400.25, 10), (600.25, 600.25, 10)]


def exit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by the day's place in its asset's series."""
    e = _events(spark, sf_dir).withColumn("block", F.floor(F.col("i") / 500))
    return _r(exits.grid_cv(e, "path", "block", GRID, 2.0, 4), "block", "g", "n")


_GRID_SQL = ", ".join(f"({i}, {tp}, {sl}, {t})" for i, (tp, sl, t) in enumerate(GRID))
EXIT_GRID_SQL = f"""
WITH {_EVENTS_SQL}, gr(g, tp, sl, lim) AS (VALUES {_GRID_SQL}),
x AS (SELECT asset, bucket, g, tp, sl, min(k) FILTER (v >= tp AND k <= lim) AS u, min(k) FILTER (v <= -sl AND k <= lim) AS d, arg_max(v, k) FILTER (k <= lim) AS e FROM st, gr GROUP BY ALL),
y AS (SELECT CAST(ev.i // 500 AS BIGINT) AS block, g, CASE WHEN u IS NOT NULL AND u <= coalesce(d, 9999) THEN tp WHEN d IS NOT NULL THEN -sl ELSE e END - 2.0 AS pnl FROM x JOIN ev USING (asset, bucket)),
m AS (SELECT block, g, count(pnl) AS n, sum(pnl) AS s, sum(pnl * pnl) AS ss, avg((pnl > 0)::INT) AS win_rate FROM y GROUP BY ALL),
p AS (SELECT *, sum(n) OVER w AS n0, sum(s) OVER w AS s0, sum(ss) OVER w AS ss0 FROM m WINDOW w AS (PARTITION BY g ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tr AS (SELECT *, CASE WHEN n0 >= 30 AND ss0 / n0 - (s0 / n0) ** 2 > 1e-12 THEN s0 / n0 / sqrt(ss0 / n0 - (s0 / n0) ** 2) * sqrt(n0) END AS train FROM p WHERE block BETWEEN 1 AND 4)
SELECT block, g, n, round(s / n, 6) AS mean_pnl, round(win_rate, 6) AS win_rate, round(train, 6) AS train_sharpe FROM tr WHERE train IS NOT NULL QUALIFY row_number() OVER (PARTITION BY block ORDER BY train DESC, g) = 1
"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(exits.signature(bars(spark, sf_dir), "asset", COLUMNS, 3), "asset", "feature", "place")


SIGNATURES_SQL = f"WITH {BARS_SQL}, z AS (" + " UNION ALL ".join(f"SELECT asset, '{c}' AS feature, (avg({c}) - (SELECT avg({c}) FROM bars)) / (SELECT stddev_pop({c}) FROM bars) AS z FROM bars GROUP BY asset" for c in COLUMNS) + ") SELECT asset, feature, round(z, 6) AS z, CAST(row_number() OVER (PARTITION BY asset ORDER BY round(abs(z), 9) DESC, feature) AS INT) AS place FROM z QUALIFY place <= 3"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(exits.tick_size(tables.read(spark, sf_dir, "part"), "p_retailprice", ["p_size"]), "p_size")


TICKS_SQL = """
WITH p AS (SELECT DISTINCT p_size, round(p_retailprice, 8) AS p FROM part), d AS (SELECT p_size, p - lag(p) OVER (PARTITION BY p_size ORDER BY p) AS d FROM p),
q AS (SELECT p_size, quantile_cont(d, 0.05) AS q FROM d WHERE d > 1e-12 GROUP BY p_size)
SELECT p_size, round(median(d), 6) AS tick FROM d JOIN q USING (p_size) WHERE d > 1e-12 AND d <= q GROUP BY p_size
"""


def feeds_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_seq", F.col("event_id") + 10_000_000 * (F.col("event_id") % 7))
    return _r(feeds.feed_report(e, ["event_type"], "ts", "value", 3600), "event_type", "n_rows", "first", "last", "n_gaps", "n_late")


FEEDS_SQL = """
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id + 10000000 * (event_id % 7) AS s FROM events),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY event_type ORDER BY s) AS step FROM e)
SELECT event_type, count(*) AS n_rows, min(t) AS first, max(t) AS last, count(*) FILTER (step > 3600) AS n_gaps, count(*) FILTER (step < 0) AS n_late, round(avg(value), 6) AS mean,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) / (max(t) - min(t))::DOUBLE, 6) AS per_second FROM d GROUP BY event_type
"""


def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    p = F.when(F.col("n") % 11 != 0, F.pmod(F.col("n") * 7919 + F.col("user_id") * 31, F.lit(997)) / 997.0)
    return _r(evaluate.benjamini_hochberg(e.withColumn("p", p), "p", ["event_type"]), "event_type", "user_id", "n")


FALSE_DISCOVERY_SQL = """
WITH e AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT *, CASE WHEN n % 11 <> 0 THEN ((n * 7919 + user_id * 31) % 997) / 997.0 END AS p FROM e),
r AS (SELECT *, p * count(p) OVER (PARTITION BY event_type) / row_number() OVER (PARTITION BY event_type, p IS NULL ORDER BY p) AS raw FROM p),
m AS (SELECT a.event_type, a.user_id, min(b.raw) AS q FROM r a JOIN r b ON a.event_type = b.event_type AND b.p >= a.p GROUP BY ALL)
SELECT event_type, user_id, n, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1, q) END, 6) AS q FROM p LEFT JOIN m USING (event_type, user_id)
"""


def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 5 + F.col("label") % 2).alias("other"))
    return _r(evaluate.ari(e, "label", "other"))


RAND_SQL = """
WITH e AS (SELECT label AS a, vec_id % 5 + label % 2 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM e GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS ab, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa,
  (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb, (SELECT sum(n) FROM c) AS n)
SELECT round((ab - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 6) AS ari FROM s
"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impute, scale, PCA and k-means over the embeddings, then each cluster's size, purity and silhouette."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    e = tables.read(spark, sf_dir, "embeddings").withColumn("raw", array_to_vector(F.col("embedding").cast("array<double>")))
    steps = [StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=8, inputCol="scaled", outputCol="x"), KMeans(k=8, featuresCol="x", predictionCol="cluster", seed=1, maxIter=20)]
    got = Pipeline(stages=steps).fit(e).transform(e)
    fit = ClusteringEvaluator(featuresCol="x", predictionCol="cluster").evaluate(got)
    c = got.groupBy("cluster", "label").count()
    g = c.groupBy("cluster").agg(F.sum("count").alias("n"), (F.max("count") / F.sum("count")).alias("purity"))
    return g.withColumn("silhouette", F.lit(fit))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.when(F.col("y_true") * F.col("y_pred") != 0, (F.signum("y_true") == F.signum("y_pred")).cast("double"))
    return evaluate.bca(_predictions(spark, sf_dir).withColumn("hit", hit), ["asset"], "hit", rounds=500)


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = excursions(spark, sf_dir).withColumn("down", F.abs("mae"))
    return evaluate.permutation_p(e, "asset", "mfe", "down", 50)


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees' gain against their gain on a shuffled target, share by feature, and the verdict."""
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    p = _predictions(spark, sf_dir).join(bars(spark, sf_dir).select("asset", "bucket", "volume", "b1", "gap"), ["asset", "bucket"]).where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    names = ["y_pred", "volume", "b1", "gap"]
    p = Imputer(strategy="median", inputCols=names, outputCols=[f"{n}_i" for n in names]).fit(p).transform(p)
    p = VectorAssembler(inputCols=[f"{n}_i" for n in names], outputCol="x").transform(p)
    w = lambda salt: Window.partitionBy("asset").orderBy(F.xxhash64("bucket", F.lit(salt)))
    shuffled = p.select("asset", "x", F.row_number().over(w(1)).alias("n")).join(p.select("asset", "y_true", F.row_number().over(w(2)).alias("n")), ["asset", "n"])
    gain = [GBTRegressor(featuresCol="x", labelCol="y_true", maxIter=8, maxDepth=3, seed=1).fit(d).featureImportances.toArray().tolist() for d in (p, shuffled)]
    rows = spark.createDataFrame([("all", n, float(a), float(b)) for n, a, b in zip(names, *gain, strict=True)], "asset string, feature string, gain double, null_gain double")
    return selection.weak_verdict(rows)


def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge per expanding fold (median impute, scale), scored on the next block."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    p = _predictions(spark, sf_dir).join(bars(spark, sf_dir).select("asset", "bucket", "volume", "b1"), ["asset", "bucket"]).where("y_true IS NOT NULL AND y_pred IS NOT NULL").withColumnRenamed("y_pred", "last_move")
    p = evaluate.folds(p, ["bucket", "asset"], 2).where("block IS NOT NULL").cache()
    out = []
    for k in (1, 2):
        steps = [VectorAssembler(inputCols=["last_move", "volume", "b1"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LinearRegression(featuresCol="x", labelCol="y_true", predictionCol="y_pred", regParam=1.0, elasticNetParam=0.0)]
        out.append(Pipeline(stages=steps).fit(p.where(F.col("block") < k)).transform(p.where(F.col("block") == k)).select("block", "y_true", "y_pred"))
    return evaluate.fold_metrics(out[0].unionByName(out[1]), ["block"])


def collinearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.vif(bars(spark, sf_dir), COLUMNS)
    return spark.createDataFrame(list(found.items()), "feature string, vif double")


QUERIES = {
    "select_correlations": (correlations, CORRELATIONS_SQL),
    "select_groups": (correlation_groups, GROUPS_SQL),
    "select_log1p": (log1p, LOG1P_SQL),
    "select_vif": (collinearity, None),
    "select_importance": (importance, None),
    "audit_rules": (audit, AUDIT_SQL),
    "eval_folds": (fold_metrics, METRICS_SQL),
    "eval_backtest": (backtest, BACKTEST_SQL),
    "eval_breakouts": (breakouts, BREAKOUTS_SQL),
    "eval_excursions": (excursions, EXCURSIONS_SQL),
    "eval_spaced": (spaced_events, SPACED_SQL),
    "eval_path_quantiles": (path_quantiles, PATH_QUANTILES_SQL),
    "eval_average_path": (average_paths, AVERAGE_PATHS_SQL),
    "eval_level_times": (level_times, LEVEL_TIMES_SQL),
    "eval_exit_grid": (exit_grid, EXIT_GRID_SQL),
    "eval_signatures": (signatures, SIGNATURES_SQL),
    "audit_ticks": (ticks, TICKS_SQL),
    "source_feeds": (feeds_report, FEEDS_SQL),
    "eval_maker": (maker, MAKER_SQL),
    "eval_fdr": (false_discovery, FALSE_DISCOVERY_SQL),
    "eval_ari": (rand_index, RAND_SQL),
    "eval_clusters": (clusters, None),
    "eval_bca": (bootstrap, None),
    "eval_permutation": (permutation, None),
    "eval_ridge": (ridge, None),
}
