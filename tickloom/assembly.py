"""Queries that put the model's table together, choose its columns and evaluate on it, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import BARS_SQL, bars
from .functions.num import correlation
from .operators import assemble
from .sources import tables
from .studies import _r

KEYS = ["asset", "bucket"]


def _series():
    return Window.partitionBy("asset").orderBy("bucket")


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "lineitem")
    d = d.select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("bucket"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("qty"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"),
    )
    out = assemble.collapse(d, ["l_suppkey", "bucket"], F.struct("pos", "price", "qty"))
    return _r(out.withColumn("bucket", F.col("bucket").cast("string")), "l_suppkey", "bucket", "pos")


COLLAPSED_SQL = """
WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS bucket, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS qty,
                  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price FROM lineitem)
SELECT l_suppkey, CAST(bucket AS VARCHAR) AS bucket, max(pos) AS pos, round(CAST(arg_max(qty, (pos, price, qty)) FILTER (qty IS NOT NULL) AS DOUBLE), 6) AS qty,
       round(CAST(arg_max(price, (pos, price, qty)) FILTER (price IS NOT NULL) AS DOUBLE), 6) AS price
FROM d GROUP BY ALL
"""


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with both markets' health and the week's day, the gate, and the return ahead as target."""
    b = bars(spark, sf_dir)
    parts = [b.where(F.col(m) > 0).select(*KEYS, (F.col(m) >= 40).cast("int").alias(f"ok_{m}")) for m in ("spot", "fut")]
    health = assemble.merge_health(parts, KEYS, ["ok_spot", "ok_fut"]).withColumn("day", F.weekday("bucket"))
    d = assemble.with_context(b, health, KEYS, {"ok_spot": 0, "ok_fut": 0, "day": -1})
    d = d.withColumn("target", F.ln(F.lead("px").over(_series()) / F.col("px")))
    d = assemble.usable(d, "ok_spot", "ok_fut").where(F.col("target").isNotNull())
    return _r(d.select("asset", F.col("bucket").cast("string").alias("bucket"), "day", "px", "volume", "target"), "asset", "bucket", "day")


DATASET_SQL = f"""
WITH {BARS_SQL}, h AS (SELECT asset, bucket, coalesce(a.ok, 0) AS ok_spot, coalesce(b.ok, 0) AS ok_fut FROM
  (SELECT asset, bucket, (spot >= 40)::INT AS ok FROM bars WHERE spot > 0) a FULL JOIN (SELECT asset, bucket, (fut >= 40)::INT AS ok FROM bars WHERE fut > 0) b USING (asset, bucket)),
d AS (SELECT bars.*, coalesce(ok_spot, 0) AS ok_spot, coalesce(ok_fut, 0) AS ok_fut, CASE WHEN ok_spot IS NULL THEN -1 ELSE CAST(isodow(bucket) - 1 AS INT) END AS day,
             ln(lead(px) OVER (PARTITION BY asset ORDER BY bucket) / px) AS target FROM bars LEFT JOIN h USING (asset, bucket))
SELECT asset, CAST(bucket AS VARCHAR) AS bucket, CAST(day AS INT) AS day, round(px, 6) AS px, round(CAST(volume AS DOUBLE), 6) AS volume, round(target, 6) AS target
FROM d WHERE ok_spot = 1 AND ok_fut = 1 AND target IS NOT NULL
"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    frames = {a: b.where(F.col("asset") == a).select("bucket", "px", "volume") for a in ("a0", "a1")}
    out = assemble.merge_stages(frames, "bucket")
    return _r(out.withColumn("bucket", F.col("bucket").cast("string")), "bucket")


STAGES_SQL = f"""
WITH {BARS_SQL} SELECT CAST(bucket AS VARCHAR) AS bucket, round(x.px, 6) AS px_a0, round(CAST(x.volume AS DOUBLE), 6) AS volume_a0, round(y.px, 6) AS px_a1, round(CAST(y.volume AS DOUBLE), 6) AS volume_a1
FROM bars x JOIN bars y USING (bucket) WHERE x.asset = 'a0' AND y.asset = 'a1'
"""

SPARSE = ["px", "gap", "volume", "rare"]


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("rare", F.when(F.col("trade_count") % 97 == 1, F.col("px")))
    return _r(assemble.null_shares(b, SPARSE), "feature", "kept")


SPARSE_SQL = f"WITH {BARS_SQL}, b AS (SELECT *, CASE WHEN trade_count % 97 = 1 THEN px END AS rare FROM bars) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(({c} IS NULL)::INT), 6) AS share, avg(({c} IS NULL)::INT) < 0.95 AS kept FROM b" for c in SPARSE
)

#: A catalog by rule: kinds by stem, and the axes that names combine.
STEMS = {"lwp_mid": "Price", "lwp_ask": "Price", "lwp_bid": "Price", "mid": "Price", "best_bid": "Price", "ema_50": "Trend", "ema_slope": "Trend", "dist_high": "Level Artefact", "poc": "Volume Profile Artefact", "poc_migration": "Volume Profile Artefact", "imbalance": "Book"}
DEPTHS, SCOPES, WINDOWS = ["", "_1bps", "_10bps", "_2bps_5bps", "_struct50"], ["_fut", "_spot"], ["", "_1s", "_60s"]
BUNDLES = {"book": ["imbalance"], "trend": ["ema_50", "ema_slope"]}


def catalog_frame(spark: SparkSession) -> DataFrame:
    stems = spark.createDataFrame(list(STEMS.items()), "s string, kind string")
    for name, values in (("d", DEPTHS), ("c", SCOPES), ("w", WINDOWS)):
        stems = stems.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return assemble.axes(stems.select(F.concat("s", "d", "c", "w").alias("feature"), "kind"))


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog_frame(spark)
    drops = assemble.merge_drops({"structural": assemble.structural_drops(c), "absolute": assemble.absolute_drops(c), "bundle": assemble.bundle_drops(c, BUNDLES, ["book"])})
    vif = c.select("feature", F.explode(F.array(F.struct(F.lit("a0").alias("asset"), F.length("feature").cast("double").alias("vif")), F.struct(F.lit("a1").alias("asset"), F.lit(12.0).alias("vif")))).alias("x")).select("feature", "x.*")
    kept = assemble.keep_list(c, drops, vif).select("feature", "vif", "use_linear", "use_tree")
    return c.join(drops, "feature", "left").join(kept, "feature", "left")


_PRUNED_ROWS = lambda values, name: f"(VALUES {', '.join(f'({chr(39)}{v}{chr(39)})' for v in values)}) {name}(v)"
PRUNED_SQL = f"""
WITH n AS (SELECT s || d.v || c.v || w.v AS feature, kind, s FROM (VALUES {', '.join(f"('{s}', '{k}')" for s, k in STEMS.items())}) st(s, kind), {_PRUNED_ROWS(DEPTHS, 'd')}, {_PRUNED_ROWS(SCOPES, 'c')}, {_PRUNED_ROWS(WINDOWS, 'w')}),
a AS (SELECT feature, kind, s AS stem, array_to_string(regexp_extract_all(feature, '_([0-9]+bps|struct[0-9]+)', 1), '|') AS depth,
             regexp_extract(feature, '_([0-9]+s)$', 1) AS "window", CASE WHEN feature LIKE '%_fut%' THEN 'fut' ELSE 'spot' END AS scope FROM n),
l AS (SELECT feature, CASE WHEN stem IN ('lwp_mid', 'lwp_ask', 'lwp_bid') AND depth <> '' AND "window" <> '' AND NOT (stem = 'lwp_mid' AND depth = '10bps' AND "window" = '60s') THEN 'structural'
        WHEN kind = 'Level Artefact' OR stem = 'poc' OR (stem IN ('mid', 'best_bid') AND depth = '' AND "window" = '1s') OR stem = 'ema_50' THEN 'absolute' WHEN stem = 'imbalance' THEN 'bundle' END AS layer FROM a)
SELECT a.*, layer, CASE WHEN layer IS NULL THEN CAST(least(length(feature), 12) AS DOUBLE) END AS vif, CASE WHEN layer IS NULL THEN least(length(feature), 12) < 10 END AS use_linear,
       CASE WHEN layer IS NULL THEN true END AS use_tree FROM a JOIN l USING (feature)
"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("ret", F.col("hi") - F.col("px") - 100)
    out = assemble.apply_log1p(b, ["volume", "gap", "ret"])
    return _r(out.groupBy("asset").agg(*(F.avg(c).alias(c) for c in ("volume", "gap", "ret"))), "asset")


LOGGED_SQL = f"""
WITH {BARS_SQL}, b AS (SELECT *, hi - px - 100 AS ret FROM bars)
SELECT asset, round(avg(ln(1 + volume)), 6) AS volume, round(avg(ln(1 + gap)), 6) AS gap, round(avg(CASE WHEN (SELECT min(ret) FROM b) >= 0 THEN ln(1 + ret) ELSE ret END), 6) AS ret FROM b GROUP BY asset
"""

GAINS = ["volume", "buy", "sell", "spot", "b1"]


def agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared correlations with each asset's price stand for gains."""
    row = bars(spark, sf_dir).groupBy("asset").agg(*((correlation(F.col(c), F.col("px")) ** 2).alias(c) for c in GAINS))
    scores = row.withColumnRenamed("asset", "target").unpivot(["target"], GAINS, "feature", "gain")
    scores = scores.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round("gain", 12)), "feature")))
    r2 = row.select(F.col("asset").alias("target"), (F.col("volume") - 1e-4).alias("r2"))
    return _r(assemble.consensus(scores, r2), "feature", "n_targets", "never_important")


AGREED_SQL = f"""
WITH {BARS_SQL}, g AS (SELECT asset, {', '.join(f'corr({c}, px) ** 2 AS {c}' for c in GAINS)} FROM bars GROUP BY asset),
s AS ({' UNION ALL '.join(f"SELECT asset AS target, '{c}' AS feature, {c} AS gain FROM g" for c in GAINS)}),
r AS (SELECT *, 100 * (1 - row_number() OVER (PARTITION BY target ORDER BY round(gain, 12) DESC, feature) / CAST(count(*) OVER (PARTITION BY target) AS DOUBLE)) AS pct FROM s),
w AS (SELECT asset AS target, greatest(volume - 1e-4, 0) AS w0, sum(greatest(volume - 1e-4, 0)) OVER () AS t, count(*) OVER () AS n FROM g)
SELECT feature, round(avg(gain), 6) AS mean_gain, round(avg(pct), 6) AS mean_pct, round(sum(pct * CASE WHEN t > 0 THEN w0 / t ELSE 1.0 / n END), 6) AS weighted_pct,
       round(min(pct), 6) AS min_pct, round(max(pct), 6) AS max_pct, count(*) AS n_targets, max(pct) < 20 AS never_important FROM r JOIN w USING (target) GROUP BY feature
"""


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bars(spark, sf_dir).withColumns({"back": F.ln(F.col("px") / F.lag("px").over(_series())), "ahead": F.ln(F.lead("px").over(_series()) / F.col("px"))})
    return d.withColumn("block", F.year("bucket").cast("long"))


_RETURNS_SQL = f"{BARS_SQL}, d AS (SELECT *, ln(px / lag(px) OVER a) AS back, ln(lead(px) OVER a / px) AS ahead, year(bucket) AS block FROM bars WINDOW a AS (PARTITION BY asset ORDER BY bucket))"


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _returns(spark, sf_dir).withColumn("predicted", -0.4 * F.col("back"))
    return _r(assemble.simple_backtest(d, ["asset"], "predicted", "ahead", 100.0), "asset", "n_trades", digits=4)


BACKTEST_SQL = f"""
WITH {_RETURNS_SQL}, e AS (SELECT *, -0.4 * back AS p FROM d WHERE back IS NOT NULL AND ahead IS NOT NULL), s AS (SELECT *, CASE WHEN p > 0.005 THEN 1 WHEN p < -0.005 THEN -1 ELSE 0 END AS s FROM e),
q AS (SELECT *, CASE WHEN s <> 0 THEN s * ahead - 0.01 END AS net FROM s)
SELECT asset, round(sum(s * ahead) * 1e4, 4) AS gross_bps, round(sum(net) * 1e4, 4) AS net_bps, round(avg(net) / stddev_pop(net) * sqrt(365 * 24 * 3600.0), 4) AS sharpe,
       round(avg((sign(p) = sign(ahead))::INT) FILTER (s <> 0), 4) AS hit_rate, count(net) AS n_trades, round(avg((abs(p) > 0.01)::INT), 4) AS bridge_rate FROM q GROUP BY asset
"""


def rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _returns(spark, sf_dir).withColumns({"back": F.col("back") * 1e4, "ahead": F.col("ahead") * 1e4})
    name = F.concat("asset", F.lit("/"), F.col("bucket").cast("string"))
    return _r(assemble.strategies(d, ["block"], "back", "ahead", name, 5.0), "strategy", "block", "n_trades", digits=4)


RIVALS_SQL = f"""
WITH {_RETURNS_SQL}, s AS (SELECT 'momentum' AS strategy, block, ahead * 1e4 AS y, CAST(sign(back) AS INT) AS s FROM d UNION ALL
  SELECT 'random', block, ahead * 1e4, CASE WHEN md5('42:' || asset || '/' || CAST(bucket AS VARCHAR))[1] < '8' THEN -1 ELSE 1 END FROM d),
q AS (SELECT *, s * y - 5 AS pnl FROM s WHERE y IS NOT NULL AND s <> 0)
SELECT strategy, block, count(*) AS n_trades, round(avg(pnl), 4) AS pnl, round(avg((pnl > 0)::INT), 4) AS win_rate, round(avg((s = sign(y))::INT), 4) AS dir_acc,
       round(avg(pnl) / (stddev_pop(pnl) + 1e-12) * sqrt(count(*)), 4) AS sharpe FROM q GROUP BY ALL
"""


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by volume; training rows are those before 1996."""
    d = _returns(spark, sf_dir).where("ahead IS NOT NULL").withColumns({"cluster": F.floor(F.col("volume") / 100).cast("long"), "way": F.signum("ahead"), "bps": F.col("ahead") * 1e4})
    return _r(assemble.directed_accuracy(d, "cluster", F.col("block") < 1996, "way", "bps", 2.0), "cluster", "n_train", "n_test", "majority", "good")


HELD_OUT_SQL = f"""
WITH {_RETURNS_SQL}, e AS (SELECT CAST(floor(volume / 100) AS BIGINT) AS cluster, sign(ahead) AS way, ahead * 1e4 AS bps, block < 1996 AS tr FROM d WHERE ahead IS NOT NULL),
b AS (SELECT cluster, count(*) FILTER (tr) AS n_train, count(*) FILTER (NOT tr) AS n_test, CASE WHEN avg((way > 0)::INT) FILTER (tr) > 0.5 THEN 1 ELSE -1 END AS majority,
             avg((way > 0)::INT) FILTER (NOT tr AND way <> 0) AS up, avg(bps) FILTER (NOT tr) AS r FROM e GROUP BY cluster),
o AS (SELECT cluster, n_train, n_test, majority, CASE WHEN n_test >= 30 THEN CASE WHEN majority > 0 THEN up ELSE 1 - up END END AS da, CASE WHEN n_test >= 30 THEN r * majority - 2.0 END AS pnl FROM b WHERE n_train >= 10)
SELECT cluster, n_train, n_test, CAST(majority AS INT) AS majority, round(da, 6) AS da_oos, round(pnl, 6) AS pnl_oos, coalesce(da > 0.55 AND pnl > 0, false) AS good FROM o
"""


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year the mean return after rises beyond a threshold, the best of three, by asset."""
    limits = F.explode(F.array(*(F.lit(x) for x in (0.0, 0.05, 0.1)))).alias("limit")
    d = _returns(spark, sf_dir).select("asset", "block", "back", "ahead", limits).where("back > limit AND ahead IS NOT NULL")
    results = d.groupBy("asset", "block", "limit").agg(F.round(F.avg("ahead"), 9).alias("score"))
    return _r(assemble.screen(results, ["block"], "score", "limit", -10.0, "asset", ["a0", "a1", "a2"]), "block")


SCREENED_SQL = f"""
WITH {_RETURNS_SQL}, r AS (SELECT asset, block, l.v AS lim, round(avg(ahead), 9) AS score FROM d, (VALUES (0.0), (0.05), (0.1)) l(v) WHERE back > l.v AND ahead IS NOT NULL GROUP BY ALL),
b AS (SELECT asset, block, max(score) AS best FROM r WHERE score >= -10 GROUP BY ALL)
SELECT block, {', '.join(f"round(max(best) FILTER (asset = '{a}'), 6) AS {a}" for a in ('a0', 'a1', 'a2'))} FROM b GROUP BY block
"""


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = assemble.parsed(tables.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "props", "k INT")
    out = assemble.moving_counts(e.withColumn("value", F.col("k").cast("double")), "ts", ["event_type"], "2 hours", "30 minutes")
    return _r(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "start", "event_type", "n")


MOVING_SQL = """
WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') AS t FROM events),
w AS (SELECT event_type, k, t - INTERVAL 30 MINUTE * i AS start FROM e, range(0, 4) r(i))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(k), 6) AS mean FROM w GROUP BY ALL
"""


def raw_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = assemble.trade_stats(tables.trades(spark, sf_dir), ["asset", "market"])
    return _r(t, "asset", "market", "n_buy", "n_sell", "n_unknown", digits=4)


RAW_STATS_SQL = f"""
WITH {BARS_SQL} SELECT asset, CASE WHEN m = 0 THEN 'spot' ELSE 'fut' END AS market, {', '.join(f"count(*) FILTER (side = '{s}') AS n_{s}" for s in ('buy', 'sell', 'unknown'))},
  round(CAST(min(price) FILTER (price > 0) AS DOUBLE), 4) AS least, round(CAST(max(price) FILTER (price > 0) AS DOUBLE), 4) AS most,
  round(CAST(sum(price * qty) FILTER (price > 0 AND qty > 0) AS DOUBLE), 4) AS total, round(CAST(avg(price * qty) FILTER (price > 0 AND qty > 0) AS DOUBLE), 4) AS mean FROM t GROUP BY ALL
"""


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumns({"bid": F.col("lo"), "ask": F.when(F.col("trade_count") % 11 != 0, F.col("hi")).otherwise(F.col("lo"))})
    return _r(assemble.book_stats(b, ["asset"], "bid", "ask", "b10", "b2"), "asset", "crossed", "short")


BOOK_SQL = f"""
WITH {BARS_SQL}, b AS (SELECT *, lo AS bid, CASE WHEN trade_count % 11 <> 0 THEN hi ELSE lo END AS ask FROM bars), s AS (SELECT *, CASE WHEN bid > 0 AND bid < ask THEN (ask - bid) / ((ask + bid) / 2) * 1e4 END AS sp FROM b)
SELECT asset, count(*) FILTER (bid > 0 AND ask > 0 AND bid >= ask) AS crossed, round(avg(sp), 6) AS mean, round(quantile_cont(sp, 0.5), 6) AS p50, round(quantile_cont(sp, 0.9), 6) AS p90, round(quantile_cont(sp, 0.99), 6) AS p99,
       count(*) FILTER (b10 > 0 AND b2 < floor(b10 * 0.5)) AS short FROM s GROUP BY asset
"""

QUERIES = {
    "assembly_collapse": (collapsed, COLLAPSED_SQL),
    "assembly_dataset": (dataset, DATASET_SQL),
    "assembly_stages": (stages, STAGES_SQL),
    "assembly_sparse": (sparse, SPARSE_SQL),
    "select_pruned": (pruned, PRUNED_SQL),
    "select_log1p_apply": (logged, LOGGED_SQL),
    "select_consensus": (agreed, AGREED_SQL),
    "eval_simple_backtest": (backtest, BACKTEST_SQL),
    "eval_strategies": (rivals, RIVALS_SQL),
    "eval_held_out_clusters": (held_out, HELD_OUT_SQL),
    "eval_screen": (screened, SCREENED_SQL),
    "stream_moving_counts": (moving, MOVING_SQL),
    "source_trade_stats": (raw_stats, RAW_STATS_SQL),
    "source_book_stats": (book, BOOK_SQL),
}
