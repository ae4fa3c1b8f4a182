"""Queries of the S0 stage, context, reference levels and cross-asset operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import BARS_SQL, W, Sql, bars
from .operators import book, buckets, context, cross, joins, levels
from .plans.spec import Feature, compute
from .sources import tables


def _rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Keys as they are (dates as text), every other column a rounded double."""
    kinds = dict(df.dtypes)
    key = lambda c: F.col(c).cast("string").alias(c) if kinds[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c)
    return df.select(*map(key, keys), *(F.round(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keys))


def trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = buckets.trade_bars(tables.trades(spark, sf_dir), ["asset", "market"], F.to_date("ts"))
    sums = [op.split(".")[1] for op in buckets.TRADES]
    return _rounded(buckets.on_grid(b, ["asset", "market"], "1 day", sums), ["asset", "market", "bucket"])


TRADE_BARS_SQL = """
WITH t AS (
  SELECT 'a' || (l_partkey % 3) AS asset, CASE WHEN l_suppkey % 2 = 0 THEN 'spot' ELSE 'fut' END AS market, CAST(l_shipdate AS DATE) AS bucket,
         round(l_extendedprice / l_quantity) AS p, l_quantity AS q,
         CASE WHEN l_linestatus = 'O' THEN 'buy' WHEN l_returnflag = 'R' THEN 'sell' ELSE 'unknown' END AS side FROM lineitem),
e AS (SELECT asset, market, min(bucket) AS lo, max(bucket) AS hi FROM t GROUP BY ALL),
g AS (SELECT asset, market, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS bucket FROM e)
SELECT asset, market, CAST(bucket AS VARCHAR) AS bucket, count(q)::DOUBLE AS trade_count, coalesce(sum(q), 0) AS volume, coalesce(sum(q * p), 0) AS notional,
  coalesce(sum(q) FILTER (side = 'buy'), 0) AS taker_buy_volume, coalesce(sum(q) FILTER (side = 'sell'), 0) AS taker_sell_volume,
  coalesce(sum(q) FILTER (side = 'buy'), 0) - coalesce(sum(q) FILTER (side = 'sell'), 0) AS signed_volume,
  coalesce(sum(q * p) FILTER (side = 'buy'), 0) AS taker_buy_notional, coalesce(sum(q * p) FILTER (side = 'sell'), 0) AS taker_sell_notional,
  coalesce(sum(q * p) FILTER (side = 'buy'), 0) - coalesce(sum(q * p) FILTER (side = 'sell'), 0) AS signed_notional
FROM g LEFT JOIN t USING (asset, market, bucket) GROUP BY asset, market, bucket
"""

FIXED, ALPHAS = (500.0, 2000.0), (0.25,)


def book_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book per asset and day: prices under the mean price are bids, the others asks."""
    t = tables.trades(spark, sf_dir).withColumn("bucket", F.to_date("ts"))
    ref = t.groupBy("asset", "bucket").agg((F.sum("price") / F.count("price")).alias("ref"))
    t = t.join(ref, ["asset", "bucket"])
    rows = lambda c, k: F.array_sort(F.collect_list(F.when(c, F.struct(k.alias("k"), F.col("qty").alias("q")))))
    b = t.groupBy("asset", "bucket").agg(rows(F.col("price") < F.col("ref"), -F.col("price")).alias("b"), rows(F.col("price") >= F.col("ref"), F.col("price")).alias("a"))
    b = b.select(
        "asset",
        "bucket",
        F.transform("b", lambda v: -v["k"]).alias("bids_px"),
        F.transform("b", lambda v: v["q"]).alias("bids_qty"),
        F.transform("a", lambda v: v["k"]).alias("asks_px"),
        F.transform("a", lambda v: v["q"]).alias("asks_qty"),
    )
    return _rounded(book.with_book_features(b, FIXED, ALPHAS).drop("bids_px", "bids_qty", "asks_px", "asks_qty"), ["asset", "bucket"])


def _book_sql() -> str:
    windows = [(f"{b:g}bps", f"{b}") for b in FIXED] + [(f"alpha{a:g}".replace(".", "_"), f"{a} * bps_sym") for a in ALPHAS]
    cols, last = [], []
    for tag, hi in windows:
        for s in ("bid", "ask"):
            inside = f"side = '{s}' AND d >= 0 AND d <= {hi}"
            raw = f"coalesce(sum(p * q) FILTER ({inside}), 0)"
            cols.append(f"CASE WHEN mid IS NULL THEN NULL ELSE {raw} END AS r_{s}_{tag}")
            cols.append(f"sum(p * q) FILTER ({inside}) / sum(q) FILTER ({inside}) AS \"lwp_{s}_{tag}\"")
            cols.append(f"arg_max(d, (p * q, -i)) FILTER ({inside}) AS \"max_liq_{s}_{tag}\"")
        b, a = (f"r_{s}_{tag}" for s in ("bid", "ask"))
        last += [f"round(coalesce({b}, 0), 6) AS \"notional_bid_{tag}\"", f"round(coalesce({a}, 0), 6) AS \"notional_ask_{tag}\""]
        last.append(f"round(CASE WHEN {b} + {a} > 0 THEN ({b} - {a}) / ({b} + {a} + 1e-12) END, 6) AS \"imbalance_{tag}\"")
        last.append(f"round((\"lwp_bid_{tag}\" + \"lwp_ask_{tag}\") / 2, 6) AS \"lwp_mid_{tag}\"")
        for s in ("bid", "ask"):
            last += [f"round(\"lwp_{s}_{tag}\", 6) AS \"lwp_{s}_{tag}\"", f"round(\"max_liq_{s}_{tag}\", 6) AS \"max_liq_{s}_{tag}\""]
    return f"""
WITH t0 AS (SELECT 'a' || (l_partkey % 3) AS asset, CAST(l_shipdate AS DATE) AS bucket, round(l_extendedprice / l_quantity) AS p, l_quantity AS q FROM lineitem),
t1 AS (SELECT *, CASE WHEN p < sum(p) OVER w / count(p) OVER w THEN 'bid' ELSE 'ask' END AS side FROM t0 WINDOW w AS (PARTITION BY asset, bucket)),
t2 AS (SELECT *, row_number() OVER (PARTITION BY asset, bucket, side ORDER BY CASE WHEN side = 'bid' THEN -p ELSE p END, q) AS i,
       max(p) FILTER (side = 'bid') OVER w AS best_bid, min(p) FILTER (side = 'ask') OVER w AS best_ask,
       min(p) FILTER (side = 'bid') OVER w AS last_bid, max(p) FILTER (side = 'ask') OVER w AS last_ask FROM t1 WINDOW w AS (PARTITION BY asset, bucket)),
t3 AS (SELECT *, CASE WHEN best_bid > 0 AND best_ask > 0 THEN (best_bid + best_ask) / 2 END AS mid FROM t2),
t4 AS (SELECT *, (mid - last_bid) / mid * 10000 AS max_bps_bid, (last_ask - mid) / mid * 10000 AS max_bps_ask,
       (CASE WHEN side = 'bid' THEN mid - p ELSE p - mid END) / mid * 10000 AS d FROM t3),
t5 AS (SELECT *, CASE WHEN max_bps_bid IS NOT NULL AND max_bps_ask IS NOT NULL THEN least(max_bps_bid, max_bps_ask) END AS bps_sym FROM t4),
g AS (SELECT asset, bucket, best_bid, best_ask, mid, best_ask - best_bid AS spread, bps_sym, max_bps_bid, max_bps_ask, {', '.join(cols)}
      FROM t5 GROUP BY asset, bucket, best_bid, best_ask, mid, bps_sym, max_bps_bid, max_bps_ask)
SELECT asset, CAST(bucket AS VARCHAR) AS bucket, best_bid, best_ask, round(mid, 6) AS mid, spread, round(bps_sym, 6) AS bps_sym,
       round(max_bps_bid, 6) AS max_bps_bid, round(max_bps_ask, 6) AS max_bps_ask, {', '.join(last)} FROM g
"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    return e.select("event_id", *(c.cast("int").alias(n) for n, c in context.calendar(F.col("ts")).items()))


CALENDAR_SQL = f"""
WITH e AS (SELECT event_id, ts, hour(ts) AS h, hour(ts) * 60 + minute(ts) AS m, strftime(ts, '%Y-%m-%d') IN ({', '.join(f"'{d}'" for d in context.US_HOLIDAYS)}) AS hol FROM events)
SELECT event_id, (h >= 22 OR h < 7)::INT AS session_sydney, (h < 9)::INT AS session_tokyo, (h >= 22 OR h < 9)::INT AS session_asia,
  (h >= 8 AND h < 16)::INT AS session_london, (h >= 13 AND h < 21)::INT AS session_newyork, (h >= 13 AND h < 16)::INT AS session_overlap_flag,
  hol::INT AS us_holiday, (m >= 870 AND m < 1260 AND isodow(ts) <= 5 AND NOT hol)::INT AS us_rth FROM e
"""
HOUR = 3600


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type is a source, an hour a bucket; value over 200 stands for a crossed book."""
    e = tables.read(spark, sf_dir, "events")
    rows = e.select("event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 97 == 0).cast("int").alias("reconnect"), (F.col("value") > 200).alias("crossed"))
    one = context.source_health(rows, ["event_type"], HOUR, 2 * HOUR)
    axis = one.select("bucket").distinct()
    h = context.aggregate_health(one, axis, ["event_type"])
    other = F.col("invalid_ts_combos") + F.col("reconnect_combos") + F.col("gap_combos") + F.col("crossed_combos")
    h = h.withColumn("soft", context.soft_health(F.col("health_flag"), F.col("missing_combos"), other)).withColumn("all", F.lit(1))
    u = context.usability(h, ["all"], "bucket", "soft", window=12, share=0.6, streak=3).drop("all")
    ints = [c for c in u.columns if c not in ("usability_bad_ratio_win",)]
    return u.select(*(F.col(c).cast("long").alias(c) for c in ints), F.round("usability_bad_ratio_win", 6).alias("usability_bad_ratio_win"))


HEALTH_SQL = f"""
WITH r AS (SELECT event_type, CAST(floor(epoch(ts) / {HOUR}) * {HOUR} AS BIGINT) AS bucket, epoch(ts) AS t, (user_id % 97 = 0)::INT AS rec, value > 200 AS cr FROM events),
s0 AS (SELECT event_type, bucket, min(t) >= 946684800 AS ok_ts, max(rec) = 0 AS ok_rec, NOT bool_or(cr) AS ok_cr FROM r GROUP BY ALL),
s AS (SELECT *, coalesce(bucket - lag(bucket) OVER (PARTITION BY event_type ORDER BY bucket) <= {2 * HOUR}, true) AS ok_gap FROM s0),
f AS (SELECT a.bucket, b.event_type, s.ok_ts IS NOT NULL AS has, ok_ts, ok_rec, ok_cr, ok_gap FROM (SELECT DISTINCT bucket FROM s) a
      CROSS JOIN (SELECT DISTINCT event_type FROM s) b LEFT JOIN s ON s.bucket = a.bucket AND s.event_type = b.event_type),
h AS (SELECT bucket, count(*) AS total_combos, count(*) FILTER (NOT coalesce(ok_ts AND ok_rec AND ok_cr AND ok_gap, false)) AS bad_combos,
      count(*) FILTER (NOT has) AS missing_combos, count(*) FILTER (has AND NOT ok_ts) AS invalid_ts_combos, count(*) FILTER (has AND NOT ok_rec) AS reconnect_combos,
      count(*) FILTER (has AND NOT ok_gap) AS gap_combos, count(*) FILTER (has AND NOT ok_cr) AS crossed_combos FROM f GROUP BY bucket),
m AS (SELECT *, (missing_combos > 0)::INT + 2 * (invalid_ts_combos > 0)::INT + 4 * (reconnect_combos > 0)::INT + 8 * (gap_combos > 0)::INT + 16 * (crossed_combos > 0)::INT AS bad_bitmask,
      CASE WHEN missing_combos > 0 THEN 1 WHEN invalid_ts_combos > 0 THEN 2 WHEN reconnect_combos > 0 THEN 3 WHEN gap_combos > 0 THEN 4 WHEN crossed_combos > 0 THEN 5 WHEN bad_combos > 0 THEN 9 ELSE 0 END AS reason_code,
      (bad_combos = 0)::INT AS health_flag,
      CASE WHEN bad_combos = 0 THEN 1 WHEN missing_combos <= 1 AND invalid_ts_combos + reconnect_combos + gap_combos + crossed_combos = 0 THEN 1 ELSE 0 END AS soft FROM h),
u0 AS (SELECT *, 1 - soft AS bad, sum(soft) OVER (ORDER BY bucket) AS run, row_number() OVER (ORDER BY bucket) AS n FROM m),
u1 AS (SELECT *, sum(bad) OVER (PARTITION BY run ORDER BY bucket) AS streak FROM u0),
u2 AS (SELECT *, sum(bad) OVER w AS usability_bad_count_win, max(streak) OVER w AS usability_max_bad_streak_win, (n < 12)::INT AS usability_warmup_flag
       FROM u1 WINDOW w AS (ORDER BY bucket ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT bucket, total_combos, bad_combos, missing_combos, invalid_ts_combos, reconnect_combos, gap_combos, crossed_combos, bad_bitmask::BIGINT AS bad_bitmask, reason_code::BIGINT AS reason_code,
  health_flag::BIGINT AS health_flag, soft::BIGINT AS soft, usability_bad_count_win::BIGINT AS usability_bad_count_win, usability_max_bad_streak_win::BIGINT AS usability_max_bad_streak_win,
  usability_warmup_flag::BIGINT AS usability_warmup_flag, round(usability_bad_count_win / 12.0, 6) AS usability_bad_ratio_win,
  (CASE WHEN n < 12 THEN 4 WHEN bad = 1 THEN 1 WHEN usability_max_bad_streak_win > 3 THEN 3 WHEN 1 - usability_bad_count_win / 12.0 < 0.6 THEN 2 ELSE 0 END)::BIGINT AS unusable_reason_code,
  (n >= 12 AND usability_max_bad_streak_win <= 3 AND 1 - usability_bad_count_win / 12.0 >= 0.6)::BIGINT AS data_usability_flag FROM u2
"""


def reference_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).select("asset", "bucket", "gap")
    b = levels.running(b, ["asset"], "bucket", "gap", F.date_trunc("week", "bucket"), "week", broadcast_open=True)
    b = levels.running(b, ["asset"], "bucket", "gap", F.date_trunc("month", "bucket"), "month")
    return _rounded(levels.monday(b, ["asset"], "bucket", "gap"), ["asset", "bucket"])


def _levels_sql() -> str:
    cols = []
    for p in ("week", "month"):
        w = f"(PARTITION BY asset, date_trunc('{p}', bucket) ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        o = w.replace("CURRENT ROW", "UNBOUNDED FOLLOWING") if p == "week" else w
        cols += [f"max(gap) OVER {w} AS {p}_high", f"min(gap) OVER {w} AS {p}_low", f"first_value(gap IGNORE NULLS) OVER {o} AS {p}_open"]
    w = "(PARTITION BY asset, date_trunc('week', bucket) ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols += [f"max(CASE WHEN isodow(bucket) = 1 THEN gap END) OVER {w} AS monday_high", f"min(CASE WHEN isodow(bucket) = 1 THEN gap END) OVER {w} AS monday_low"]
    prev = ", ".join(
        f"{p} AS (SELECT asset, k, lag(h) OVER v AS prev_{p}_high, lag(l) OVER v AS prev_{p}_low FROM (SELECT asset, date_trunc('{p}', bucket) AS k, max(gap) AS h, min(gap) AS l FROM bars GROUP BY ALL) WINDOW v AS (PARTITION BY asset ORDER BY k))"
        for p in ("week", "month")
    )
    names = ["gap", *(f"{p}_{k}" for p in ("week", "month") for k in ("high", "low", "open")), *(f"prev_{p}_{k}" for p in ("week", "month") for k in ("high", "low")), "monday_high", "monday_low"]
    return f"""WITH {BARS_SQL}, b AS (SELECT asset, bucket, gap, {', '.join(cols)} FROM bars), {prev}
SELECT b.asset, CAST(b.bucket AS VARCHAR) AS bucket, {', '.join(names)} FROM b
JOIN week ON week.asset = b.asset AND week.k = date_trunc('week', b.bucket) JOIN month ON month.asset = b.asset AND month.k = date_trunc('month', b.bucket)"""


def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.trades(spark, sf_dir).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return _rounded(levels.volume_profile(t, ["asset"], "month", "price", "qty"), ["asset", "month"])


PROFILE_SQL = """
WITH RECURSIVE t AS (SELECT 'a' || (l_partkey % 3) AS asset, strftime(l_shipdate, '%Y-%m') AS month, round(l_extendedprice / l_quantity) AS p, l_quantity AS q FROM lineitem),
e AS (SELECT asset, month, min(p) AS lo, max(p) AS hi, sum(q) AS total FROM t GROUP BY ALL),
b AS (SELECT asset, month, CASE WHEN hi > lo THEN least(CAST(floor((p - lo) / (hi - lo) * 50) AS INT), 49) ELSE 0 END AS bin, sum(q) AS v FROM t JOIN e USING (asset, month) GROUP BY ALL),
f AS (SELECT asset, month, i AS bin, coalesce(v, 0) AS v FROM (SELECT asset, month, unnest(range(50)) AS i FROM e) g LEFT JOIN b USING (asset, month) WHERE b.bin = g.i OR b.bin IS NULL
      UNION ALL SELECT asset, month, i, 0 FROM (SELECT asset, month, unnest(range(50)) AS i FROM e) g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.asset = g.asset AND b.month = g.month AND b.bin = g.i)),
l AS (SELECT asset, month, list(v ORDER BY bin) AS v FROM f GROUP BY ALL),
s AS (SELECT asset, month, lo, hi, total, v, list_position(v, list_max(v)) - 1 AS top FROM l JOIN e USING (asset, month)),
g AS (
  SELECT asset, month, top AS a, top AS b, v[top + 1] AS s, 0 AS it FROM s
  UNION ALL
  SELECT asset, month, CASE WHEN done OR up >= down THEN a ELSE a - 1 END, CASE WHEN NOT done AND up >= down THEN b + 1 ELSE b END,
         CASE WHEN done THEN s WHEN up >= down THEN s + up ELSE s + down END, it + 1
  FROM (SELECT g.*, coalesce(v[b + 2], -1) AS up, CASE WHEN a > 0 THEN v[a] ELSE -1 END AS down,
               g.s >= total * 0.7 OR (v[b + 2] IS NULL AND a = 0) AS done FROM g JOIN s USING (asset, month) WHERE it < 50))
SELECT asset, month, round(CASE WHEN hi = lo THEN lo ELSE lo + (top + 0.5) * (hi - lo) / 50 END, 6) AS poc,
       round(CASE WHEN hi = lo THEN lo ELSE lo + (b + 1) * (hi - lo) / 50 END, 6) AS vah, round(CASE WHEN hi = lo THEN lo ELSE lo + a * (hi - lo) / 50 END, 6) AS val
FROM g JOIN s USING (asset, month) WHERE it = 50
"""

SPAN, HALF = 30, 15


def recursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = [Feature("ema", "S1", "derived.ema", ("gap",), {"span_s": SPAN}), Feature("participation", "S1", "derived.participation_rate_1s", ("gap",), {"ewma_halflife_s": HALF})]
    return _rounded(compute(bars(spark, sf_dir), f, ["asset"], ["bucket"]).select("asset", "bucket", "ema", "participation"), ["asset", "bucket"])


RECURSIONS_SQL = f"""
WITH RECURSIVE {BARS_SQL.strip()}, n AS (SELECT asset, bucket, gap, row_number() OVER (PARTITION BY asset ORDER BY bucket) AS i FROM bars),
e AS (
  SELECT asset, bucket, i, gap, gap AS ema, coalesce(gap, 0) AS num, (gap IS NOT NULL)::DOUBLE AS den FROM n WHERE i = 1
  UNION ALL
  SELECT n.asset, n.bucket, n.i, n.gap, CASE WHEN n.gap IS NULL THEN e.ema WHEN e.ema IS NULL THEN n.gap ELSE 2.0 / {SPAN + 1} * n.gap + (1 - 2.0 / {SPAN + 1}) * e.ema END,
         e.num * exp(-ln(2) / {HALF}) + coalesce(n.gap, 0), e.den * exp(-ln(2) / {HALF}) + (n.gap IS NOT NULL)::DOUBLE
  FROM e JOIN n ON n.asset = e.asset AND n.i = e.i + 1)
SELECT asset, CAST(bucket AS VARCHAR) AS bucket, round(ema, 6) AS ema, round(gap / (num / nullif(den, 0) + 1e-12), 6) AS participation FROM e
"""


def _cross_features() -> list[Feature]:
    w = {"window_s": W}
    f = lambda n, op, deps, p=None: Feature(n, "S6", op, deps, p or {})
    return [
        f("diff", "derived.cross_asset_diff", ("px_a0", "px_a1")),
        f("sub", "derived.sub", ("gap_a0", "px_a1")),
        f("z", "derived.robust_zscore", ("px_a0",), {**w, "zscore_clip": 20}),
        f("dev", "derived.bps_mid_dev", ("hi_a0", "px_a0")),
        f("spread", "derived.bps_spread", ("lo_a1", "px_a0")),
        f("beta", "derived.rolling_ols_beta", ("px_a0", "px_a1"), w),
        f("residual", "derived.beta_residual", ("px_a0", "px_a1", "beta")),
        f("lag_corr", "derived.cross_lag_corr", ("px_a0", "px_a1"), {**w, "lag_s": 2}),
        f("on_a", "derived.regime_align", ("buy_a0", "sell_a0")),
        f("xor", "derived.regime_xor", ("buy_a0", "gap_a1")),
    ]


def cross_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).select("asset", "bucket", "px", "gap", "hi", "lo", "buy", "sell")
    wide = cross.side_by_side(b, "asset", ["a0", "a1"]).withColumn("pair", F.lit("a0a1"))
    f = _cross_features()
    return _rounded(compute(wide, f, ["pair"], ["bucket"]).select("bucket", *(x.name for x in f)), ["bucket"], 5)


def _cross_sql() -> str:
    s = Sql()
    f = s.frame(-(W - 1))
    z = s.z("px", 20, eps="1e-8")
    beta = s.hold(s.clip(f"CASE WHEN count(*) OVER {f} >= {W} THEN covar_samp(px, px1) OVER {f} / (var_samp(px1) OVER {f} + 1e-12) END", -5, 5), 0)
    lead = s.hold(s.lag("px", 2), 0)
    cols = [
        ("diff", "px - px1"), ("sub", "gap - px1"), ("z", z), ("dev", "(hi - px) / px * 10000.0"), ("spread", "lo1 / px * 10000.0"), ("beta", beta), ("residual", f"px - {beta} * px1"),
        ("lag_corr", f"CASE WHEN count({lead}) OVER {f} >= {W} THEN corr({lead}, px1) OVER {f} END"),
        ("on_a", "CASE WHEN buy <> 0 AND sell <> 0 THEN 1 ELSE 0 END"), ('"xor"', "abs(buy - gap1)"),
    ]
    base = BARS_SQL.replace("bars AS (", "bars0 AS (") + ", bars AS (SELECT x.*, y.px AS px1, y.gap AS gap1, y.lo AS lo1 FROM bars0 x JOIN bars0 y USING (bucket) WHERE x.asset = 'a0' AND y.asset = 'a1')"
    return s.query(base, cols, 5).replace("SELECT asset, CAST(bucket", "SELECT CAST(bucket")


def as_of_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).select("asset", "bucket", "px").withColumn("t", F.unix_date("bucket").cast("long"))
    return _rounded(joins.backward_return_bps(b, ["asset"], "t", "px", 5, 2).select("asset", "bucket", "back_bps"), ["asset", "bucket"])


AS_OF_SQL = f"""
WITH {BARS_SQL}, b AS (SELECT asset, bucket, px, bucket - 5 AS want FROM bars)
SELECT b.asset, CAST(b.bucket AS VARCHAR) AS bucket, round(CASE WHEN b.want - c.bucket <= 2 THEN (b.px / c.px - 1) * 10000.0 END, 6) AS back_bps
FROM b ASOF LEFT JOIN bars c ON b.asset = c.asset AND c.bucket <= b.want
"""


def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").select("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / HOUR).alias("hour")).distinct()
    return context.islands(e, ["event_type"], "hour", 1).select("event_type", "run_id", "first", "last", "n")


ISLANDS_SQL = f"""
WITH e AS (SELECT DISTINCT event_type, CAST(floor(epoch(ts) / {HOUR}) AS BIGINT) AS hour FROM events),
n AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY event_type ORDER BY hour) <= 1 THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY hour) AS run_id FROM n)
SELECT event_type, run_id::BIGINT AS run_id, min(hour) AS first, max(hour) AS last, count(*) AS n FROM r GROUP BY event_type, run_id
"""


def qc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("src", F.col("user_id") % 3)
    s = context.segments(e, ["src"], 86400, 20)
    return s.select("src", "segment", "n_rows", "max_gap", F.col("n_errors").cast("long").alias("n_errors"), F.round("value_p50", 6).alias("value_p50"), F.round("value_p99", 6).alias("value_p99"), "issues")


SEGMENTS_SQL = """
WITH e AS (SELECT user_id % 3 AS src, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type, value FROM events),
s AS (SELECT *, CAST(floor((t - min(t) OVER (PARTITION BY src)) / 86400) AS BIGINT) AS segment FROM e),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY src, segment ORDER BY t) AS gap FROM s),
a AS (SELECT src, segment, count(*) AS n_rows, max(gap) AS max_gap, count(*) FILTER (event_type = 'error') AS n_errors, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM g GROUP BY ALL)
SELECT src, segment, n_rows, max_gap, n_errors, round(p50, 6) AS value_p50, round(p99, 6) AS value_p99,
       array_to_string(list_filter([CASE WHEN max_gap > 25920 THEN 'gap' END, CASE WHEN n_errors > 0 THEN 'reconnect' END, CASE WHEN p99 > 4 * p50 THEN 'tail' END], lambda x: x IS NOT NULL), ',') AS issues
FROM a WHERE n_rows >= 20
"""


def last_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").select("event_type", "event_id", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    s = buckets.snapshots(e, ["event_type"], F.floor(F.col("t") / HOUR), at="t", seq="event_id")
    return s.select("event_type", "bucket", "event_id", F.round("value", 6).alias("value"))


SNAPSHOTS_SQL = f"""
SELECT event_type, CAST(floor(floor(epoch(ts)) / {HOUR}) AS BIGINT) AS bucket, arg_max(event_id, (floor(epoch(ts)), event_id)) AS event_id,
       round(arg_max(value, (floor(epoch(ts)), event_id)), 6) AS value FROM events GROUP BY 1, 2
"""

QUERIES = {
    "s0_trade_bars": (trade_bars, TRADE_BARS_SQL),
    "s0_book": (book_features, _book_sql()),
    "s0_snapshots": (last_snapshots, SNAPSHOTS_SQL),
    "context_calendar": (calendar, CALENDAR_SQL),
    "context_health": (health, HEALTH_SQL),
    "context_islands": (event_islands, ISLANDS_SQL),
    "context_segments": (qc_segments, SEGMENTS_SQL),
    "levels_running": (reference_levels, _levels_sql()),
    "levels_profile": (volume_profile, PROFILE_SQL),
    "s1_recursions": (recursions, RECURSIONS_SQL),
    "s6_cross": (cross_assets, _cross_sql()),
    "join_as_of": (as_of_returns, AS_OF_SQL),
}
