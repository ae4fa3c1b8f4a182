"""Registered feature sets: each is a list of (name, stage, operator, inputs, parameters, SQL).

The SQL is what DuckDB computes for the same column over the same bars, written
by hand; ``{..}`` are helpers of ``Sql`` below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.num import no_nan
from .operators.buckets import trade_bars
from .plans.spec import Chunks, Feature, compute
from .sources import tables

W = 20
BARS_SQL = """
t AS (
  SELECT 'a' || (l_partkey % 3) AS asset, l_suppkey % 2 AS m, CAST(l_shipdate AS DATE) AS bucket,
         round(l_extendedprice / l_quantity) AS price, l_quantity AS qty, CAST(floor(l_discount * 100 + 1e-9) AS INT) AS band,
         CASE WHEN l_linestatus = 'O' THEN 'buy' WHEN l_returnflag = 'R' THEN 'sell' ELSE 'unknown' END AS side
  FROM lineitem),
bars AS (
  SELECT asset, bucket, CAST(count(*) AS DOUBLE) AS trade_count, sum(qty) AS volume, sum(qty * price) AS notional,
         coalesce(sum(qty) FILTER (side = 'buy'), 0) AS buy, coalesce(sum(qty) FILTER (side = 'sell'), 0) AS sell,
         min(price) AS lo, max(price) AS hi, (min(price) + max(price)) / 2 AS px,
         coalesce(sum(qty) FILTER (m = 0), 0) AS spot, coalesce(sum(qty) FILTER (m = 1), 0) AS fut,
         coalesce(sum(qty) FILTER (band <= 2), 0) AS b1, coalesce(sum(qty) FILTER (band <= 4), 0) AS b2,
         coalesce(sum(qty) FILTER (band <= 7), 0) AS b5, sum(qty) AS b10,
         CASE WHEN count(*) % 7 = 0 THEN NULL ELSE (min(price) + max(price)) / 2 END AS gap
  FROM t GROUP BY ALL)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per asset with every trade operator, and a few bands and a series with holes."""
    t = tables.trades(spark, sf_dir)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("qty"))), F.lit(0.0))
    extra = {
        "lo": F.min("price"),
        "hi": F.max("price"),
        "spot": total(F.col("market") == "spot"),
        "fut": total(F.col("market") == "fut"),
        "b1": total(F.col("band") <= 2),
        "b2": total(F.col("band") <= 4),
        "b5": total(F.col("band") <= 7),
        "b10": F.sum("qty"),
    }
    b = trade_bars(t, ["asset"], F.to_date("ts"), extra)
    px = (F.col("lo") + F.col("hi")) / 2
    return no_nan(b).withColumns({"px": px, "gap": F.when(F.col("trade_count") % 7 != 0, px), "buy": F.col("taker_buy_volume"), "sell": F.col("taker_sell_volume")})


class Sql:
    """Text of window expressions, nested ones as columns of earlier CTEs."""

    def __init__(self):
        self.levels: list[dict[str, str]] = []

    def hold(self, text: str, level: int = 0) -> str:
        while len(self.levels) <= level:
            self.levels.append({})
        for name, known in self.levels[level].items():
            if known == text:
                return name
        name = f"h{level}_{len(self.levels[level])}"
        self.levels[level][name] = text
        return name

    A = "(PARTITION BY asset ORDER BY bucket)"

    @staticmethod
    def frame(a: int, b: int = 0) -> str:
        at = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
        return f"(PARTITION BY asset ORDER BY bucket ROWS BETWEEN {at(a)} AND {at(b)})"

    def lag(self, x: str, n: int = 1) -> str:
        return f"lag({x}, {n}) OVER {self.A}"

    def roll(self, fn: str, x: str, w: int = W, least: int | None = None) -> str:
        f = self.frame(-(w - 1))
        return f"(CASE WHEN count({x}) OVER {f} >= {w if least is None else least} THEN {fn}({x}) OVER {f} END)"

    @staticmethod
    def clip(x: str, lo: float, hi: float) -> str:
        return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END)"

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) END)"

    @staticmethod
    def eps(a: str, b: str, eps: str = "1e-12") -> str:
        return f"(({a}) / (({b}) + {eps}))"

    def bps(self, x: str, ref: str) -> str:
        return self.clip(f"{self.eps(x, ref)} * 10000.0", -100000.0, 100000.0)

    def mad(self, x: str, w: int = W, least: int | None = None, level: int = 0) -> tuple[str, str]:
        med = self.hold(self.roll("median", x, w, least), level)
        dev = self.hold(f"abs({x} - {med})", level + 1)
        return med, self.hold(self.roll("median", dev, w, least), level + 2)

    def z(self, x: str, bound: float, w: int = W, least: int | None = None, eps: str | None = None, level: int = 0) -> str:
        med, mad = self.mad(x, w, least, level)
        raw = f"(({x} - {med}) / (1.4826 * {mad} + {eps}))" if eps else f"(CASE WHEN {mad} > 0 THEN ({x} - {med}) / (1.4826 * {mad}) END)"
        return raw if not bound else self.clip(raw, -bound, bound)

    def same_sign(self, x: str) -> str:
        return f"(CASE WHEN sign({x}) = sign({self.lag(x)}) THEN 1.0 ELSE 0.0 END)"

    def query(self, base: str, columns: list[tuple[str, str]], digits: int = 6) -> str:
        ctes, last = [base], "bars"
        for i, level in enumerate(self.levels):
            held = "".join(f", {text} AS {name}" for name, text in level.items())
            ctes.append(f"l{i} AS (SELECT *{held} FROM {last})")
            last = f"l{i}"
        out = ", ".join(f"round(CAST({text} AS DOUBLE), {digits}) AS {name}" for name, text in columns)
        return f"WITH {', '.join(ctes)} SELECT asset, CAST(bucket AS VARCHAR) AS bucket, {out} FROM {last}"


def _s1(s: Sql):
    d = s.div
    yield "add", "derived.add", ("buy", "sell"), {}, "buy + sell"
    yield "sub", "derived.sub", ("buy", "sell"), {}, "buy - sell"
    yield "ratio", "derived.ratio", ("buy", "sell"), {}, s.clip(d("buy", "sell"), -1e6, 1e6)
    yield "count_ratio", "derived.count_ratio", ("b1", "sell"), {}, f"CASE WHEN b1 > 1e-12 THEN {s.clip(d('b1', 'sell'), 0, 1e6)} ELSE 0 END"
    yield "share", "derived.share", ("spot", "fut"), {}, s.eps("spot", "spot + fut")
    yield "log_return", "derived.log_return", ("px",), {}, f"ln(px / {s.lag('px')})"
    yield "dist_high", "range.dist_to_high_bps", ("px", "hi"), {}, s.bps("hi - px", "px")
    yield "dist_low", "range.dist_to_low_bps", ("px", "lo"), {}, s.bps("px - lo", "px")
    yield "ext_position", "range.ext_position", ("px", "lo", "hi"), {}, s.clip(s.eps("px - lo", "hi - lo"), 0, 1)
    yield "ext_range", "range.ext_range_bps", ("hi", "lo"), {}, s.clip(s.eps("hi - lo", "(hi + lo) / 2") + " * 10000.0", 0, 100000.0)
    yield "level_dist", "range.dist_to_level_bps", ("gap", "lo"), {}, s.bps("gap - lo", "gap")
    yield "above", "derived.above_level", ("gap", "lo"), {}, "CASE WHEN gap > lo THEN 1 ELSE 0 END"
    yield "below", "derived.below_level", ("gap", "hi"), {}, "CASE WHEN gap < hi THEN 1 ELSE 0 END"
    yield "fib", "derived.fib_dist_bps", ("gap", "lo", "hi"), {"fib_level": 0.618}, s.bps("gap - (lo + 0.618 * (hi - lo))", "gap")
    yield "va", "derived.price_vs_va", ("gap", "hi", "lo"), {}, "CASE WHEN gap < lo THEN 0 WHEN gap > hi THEN 2 ELSE 1 END"
    yield "basis", "derived.basis", ("spot", "fut"), {}, "spot - fut"
    yield "activity_share", "deriv.spot_fut_taker_activity_share_1s", ("spot", "b1", "fut", "b2"), {}, s.eps("spot + b1", "spot + b1 + fut + b2")
    yield "avg_size", "trades.avg_trade_size", ("volume", "trade_count"), {}, d("volume", "trade_count")
    yield "taker_imbalance", "trades.taker_imbalance", ("buy", "sell"), {}, s.eps("buy - sell", "buy + sell")
    yield "vwap", "trades.vwap", ("notional", "volume"), {}, d("notional", "volume")
    yield "book_asymmetry", "l2.book_asymmetry", ("b1", "b2"), {}, s.eps("b1 - b2", "b1 + b2")
    yield "liq_sum", "l2.liq_sum", ("b1", "b2"), {}, "b1 + b2"
    yield "mid_touch", "l2.mid_touch", ("hi", "lo"), {}, "(hi + lo) / 2"
    yield "queue_imbalance", "l2.queue_imbalance_1s", ("b1", "b5"), {}, s.eps("b1 - b5", "b1 + b5")
    yield "queue_log", "l2.queue_pressure_log_1s", ("b1", "b5"), {}, "ln((b1 + 1e-12) / (b5 + 1e-12))"
    yield "update_count", "l2.l2_update_count", ("b1", "b10"), {}, f"CASE WHEN abs(b1 - {s.lag('b1')}) > 1e-12 OR abs(b10 - {s.lag('b10')}) > 1e-12 THEN 1 ELSE 0 END"
    for side in ("ask", "bid"):
        yield f"gradient_{side}", f"l2.depth_gradient_{side}", ("b1", "b5"), {}, s.clip("(b5 - b1) / (abs(b5) + 1e-12)", 0, 1)
        yield f"concentration_{side}", f"l2.liq_concentration_{side}", ("b1", "b5"), {}, s.clip("b1 / (abs(b5) + 1e-12)", 0, 1)
        yield f"absorb_refill_{side}", f"l2.absorb_refill_{side}", ("b1", "b5"), {}, "b1 * b5"
        yield f"absorp_ratio_{side}", f"l2.aggr_absorp_ratio_{side}", ("b5", "b1"), {}, s.clip(d("b5", "b1"), 0, 1e6)
        yield f"add_rate_{side}", f"l2.add_rate_{side}", ("gap",), {}, f"coalesce(CASE WHEN gap > {s.lag('gap')} THEN gap - {s.lag('gap')} ELSE 0 END, 0)"
        yield f"cancel_rate_{side}", f"l2.cancel_rate_{side}", ("gap",), {}, f"coalesce(CASE WHEN gap < {s.lag('gap')} THEN {s.lag('gap')} - gap ELSE 0 END, 0)"


def _s1_rolling(s: Sql):
    w = {"window_s": W}
    f, ahead = s.frame(-(W - 1)), s.frame(0, W - 1)
    yield "roll_mean", "derived.roll_mean", ("gap",), {"window_s": 3}, s.roll("avg", "gap", 3)
    yield "roll_sum", "derived.roll_sum", ("volume",), w, s.roll("sum", "volume")
    yield "z", "derived.robust_zscore", ("px",), w, s.z("px", 100, eps="1e-12")
    yield "z_diff", "derived.zscore_diff", ("buy", "sell"), w, s.z("(buy - sell)", 100, eps="1e-12")
    yield "range_pct", "derived.range_pct", ("gap",), w, s.eps(f"max(gap) OVER {f} - min(gap) OVER {f}", f"(max(gap) OVER {f} + min(gap) OVER {f}) / 2")
    yield "range_pos", "derived.range_pos", ("gap",), w, s.eps(f"gap - min(gap) OVER {f}", f"max(gap) OVER {f} - min(gap) OVER {f}")
    yield "mae", "derived.mae_fwd", ("px",), w, s.clip(s.eps(f"px - min(px) OVER {ahead}", "px") + " * 10000.0", 0, 100000.0)
    yield "mfe", "derived.mfe_fwd", ("px",), w, s.clip(s.eps(f"max(px) OVER {ahead} - px", "px") + " * 10000.0", 0, 100000.0)
    yield "target", "derived.ret_fwd", ("px",), w, f"ln(lead(px, {W}) OVER {s.A} / px)"
    r = s.hold(f"ln(px / {s.lag('px')})", 0)
    g = s.frame(1, W)
    yield "rv", "derived.rv_fwd", ("px",), w, f"CASE WHEN count({r}) OVER {g} >= {W} THEN sqrt(sum({r} * {r}) OVER {g}) END"
    down = s.hold(f"CASE WHEN {s.lag('lo')} > {s.lag('b10')} AND lo <= b10 THEN 1 ELSE 0 END", 0)
    yield "low_break", "derived.break_flag_low", ("lo", "b10"), w, f"max({down}) OVER {f} * CASE WHEN lo < b10 THEN 1 ELSE 0 END"
    high = s.hold(f"CASE WHEN {s.lag('b10')} < {s.lag('lo')} AND b10 >= lo THEN 1 ELSE 0 END", 0)
    yield "high_break", "derived.break_flag_high", ("b10", "lo"), w, f"max({high}) OVER {f} * CASE WHEN b10 > lo THEN 1 ELSE 0 END"
    yield "reclaim", "derived.reclaim_flag", ("b10", "lo"), w, f"max({high}) OVER {f} * CASE WHEN b10 > lo THEN 1 ELSE 0 END"
    yield "migration", "derived.poc_migration_bps", ("gap",), {"shift_s": 3}, s.bps(f"gap - {s.lag('gap', 3)}", s.lag("gap", 3))
    yield "slope", "derived.ema_slope_bps", ("px",), {"shift_s": 5}, s.bps(f"px - {s.lag('px', 5)}", s.lag("px", 5))
    yield "price_vs", "derived.price_vs_ema_bps", ("px", "lo"), {}, s.bps("px - lo", "lo")
    yield "trend", "derived.trend_align", ("hi", "gap", "lo"), {}, "CASE WHEN hi > gap AND gap > lo THEN 1 WHEN hi < gap AND gap < lo THEN -1 ELSE 0 END"
    yield "basis_mid", "deriv.basis_mid", ("gap", "lo"), w, f"avg(gap - lo) OVER {f}"
    yield "basis_bps", "derived.basis_bps", ("gap", "lo"), w, f"avg({s.eps('gap - lo', 'lo')} * 10000.0) OVER {f}"
    cv = lambda x: s.hold(f"stddev_pop({x}) OVER {f} / (abs(avg({x}) OVER {f}) + 1e-12)", 0)
    a, b = cv("b1"), cv("b5")
    yield "cluster", "l2.liq_cluster_asymmetry", ("b1", "b5"), w, s.eps(f"{b} - {a}", f"{b} + {a}")
    yield "queue", "l2.queue_pressure", ("b1", "b5"), w, f"avg({s.eps('b1 - b5', 'b1 + b5')}) OVER {f}"
    yield "net", "l2.net_pressure", ("b1", "buy", "b2", "sell", "b5", "spot"), w, f"avg({s.div('(b1 - buy) - (b2 - sell)', 'b5 + spot')}) OVER {f}"
    rate = s.hold(s.clip(s.eps("b1 + b2", "buy + sell"), 0, 1e6), 0)
    for name in ("fill_rate_ahead", "pull_rate", "refill_rate"):
        yield name, f"l2.{name}", ("b1", "b2", "buy", "sell"), w, f"avg({rate}) OVER {f}"


def _s2(s: Sql):
    w = {"window_s": W}
    f = s.frame(-(W - 1))
    quiet = lambda n, d: f"(CASE WHEN coalesce(abs({d}), 0) <= 1e-12 AND coalesce(abs({n}), 0) <= 1e-12 THEN 0 WHEN abs({d}) > 1e-12 THEN {s.clip(f'({n}) / ({d})', 0, 1e6)} END)"
    yield "mean2", "derived.roll_mean", ("gap", "lo"), {"window_s": W, "min_periods": 5}, s.roll("avg", s.hold("CASE WHEN gap IS NULL THEN lo ELSE (gap + lo) / 2 END"), W, 5)
    yield "sum", "derived.roll_sum", ("gap",), {"window_s": 4}, s.roll("sum", "gap", 4)
    yield "median_gap", "derived.roll_median", ("px",), w, s.roll("median", "px")
    yield "mad_gap", "derived.mad", ("px",), w, s.mad("px")[1]
    yield "z", "derived.robust_zscore", ("gap",), {"window_s": W, "min_periods": 5}, s.z("gap", 20, W, 5)
    med, mad = s.mad("px")
    yield "shock", "derived.shock_detect", ("px", "median_gap", "mad_gap"), w, s.clip(f"(CASE WHEN {mad} > 0 THEN (px - {med}) / (1.4826 * {mad}) END)", -50, 50)
    yield "joint", "derived.shock", ("b1", "b2"), {}, "sqrt(b1 * b1 + b2 * b2)"
    yield "ofi", "derived.ofi_shock", ("buy",), w, s.clip(s.div(f"buy - {s.roll('avg', 'buy')}", s.roll("stddev_samp", "buy")), -100, 100)
    yield "d1_px", "derived.d1", ("px",), {}, f"px - {s.lag('px')}"
    d1 = s.hold(f"px - {s.lag('px')}")
    yield "d2_px", "derived.d2", ("d1_px",), {}, f"{d1} - {s.lag(d1)}"
    yield "product", "derived.product", ("b1", "gap"), {}, "b1 * gap"
    yield "ratio", "derived.ratio", ("b2", "b1"), {}, s.div("b2", "b1")
    yield "asymmetry", "derived.asymmetry", ("b1", "b2"), {}, s.eps("b1 - b2", "b1 + b2")
    yield "churn", "l2.churn_ask", ("b1", "b2", "sell"), {}, quiet("b1 + b2", "sell")
    yield "churn2", "l2.churn_bid", ("b1", "b2"), {}, "b1 + b2"
    yield "net_add", "l2.net_add_pressure", ("b1", "b2", "b5", "b10"), {}, "(b1 - b2) - (b5 - b10)"
    yield "net_cancel", "l2.net_cancel_pressure", ("b1", "b2"), {}, "b1 - b2"
    yield "pull", "l2.pull_rate", ("b1", "b2", "buy", "sell"), w, f"avg({s.hold(quiet('b1 + b2', 'buy + sell'))}) OVER {f}"
    yield "refill", "l2.refill_rate", ("b2", "b1"), {}, s.clip(s.div("b2", "b1"), 0, 1e6)
    yield "behind", "l2.refill_rate_behind", ("b2", "b1"), {}, s.div("b2", "b1")
    yield "c_ahead", "l2.cancel_rate_ahead", ("b5", "b1"), {}, s.div("b5", "b1")
    yield "c_behind", "l2.cancel_rate_behind", ("b10", "b1"), {}, s.div("b10", "b1")
    yield "vol_asym", "derived.z_volume_asym", ("spot", "fut"), w, s.clip(s.div(f"(spot - fut) - {s.roll('avg', '(spot - fut)')}", s.roll("stddev_samp", "(spot - fut)")), -100, 100)
    yield "absorption", "trades.trade_absorption_ratio_1s", ("b1", "sell"), {}, "CASE WHEN sell <= 1e-12 AND b1 <= 1e-12 THEN 0 WHEN sell > 1e-12 THEN b1 / sell END"
    before = s.hold(s.lag("px"))
    yield "autocorr", "derived.autocorr", ("px",), w, f"CASE WHEN count(px) OVER {f} >= {max(10, W // 2)} THEN corr(px, {before}) OVER {s.frame(-(W - 2))} END"
    yield "ret_1", "derived.ret_vwap", ("px", "gap"), w, f"avg(ln(px / gap)) OVER {f}"
    yield "per_liquidity", "derived.impact_per_liquidity", ("b1", "b2"), w, f"avg(b1 * b2) OVER {f}"
    yield "per_signed", "derived.impact_per_signed", ("b1", "sell"), w, f"avg({s.hold(s.div('b1', 'sell'))}) OVER {f}"
    over2 = lambda x: f"{x} > {s.roll('avg', x)} + 2 * {s.roll('stddev_samp', x)}"
    yield "regime", "derived.breakout_regime_flag", ("volume", "trade_count"), w, f"CASE WHEN {s.roll('avg', 'volume')} IS NOT NULL THEN CASE WHEN {over2('volume')} AND {over2('trade_count')} THEN 1 ELSE 0 END END"
    sd = "(buy - sell)"
    held = s.hold(f"CASE WHEN row_number() OVER {s.A} > 1 THEN {s.same_sign(sd)} END")
    yield "signed", "derived.sub", ("buy", "sell"), {}, sd
    yield "consistency", "derived.dir_consistency", ("signed",), w, s.roll("avg", held)
    pos, neg = (s.roll("sum", f"(CASE WHEN {sd} {c} 0 THEN 1.0 ELSE 0.0 END)") for c in "><")
    yield "one_way", "derived.unidir_ratio", ("signed",), w, f"greatest({pos}, {neg}) / nullif({pos} + {neg}, 0)"
    yield "slope", "derived.depth_slope", ("b1", "b2", "b5", "b10"), {}, "(b1 * (1 - 4.5) + b2 * (2 - 4.5) + b5 * (5 - 4.5) + b10 * (10 - 4.5)) / 49.0"
    yield "curvature", "derived.depth_curvature", ("b1", "b2", "b5", "b10"), {}, "((b5 - 2 * b2 + b1) + (b10 - 2 * b5 + b2)) / 2"
    yield "touch_dev", "derived.mid_touch_dev", ("hi", "lo"), {}, s.div("hi - lo", "lo") + " * 10000.0"
    yield "deviation", "derived.price_deviation_bps", ("hi", "lo"), {}, s.div("hi - lo", "hi") + " * 10000.0"
    acc = s.hold(f"gap - 2 * {s.lag('gap')} + {s.lag('gap', 2)}")
    yield "acceleration", "derived.price_acceleration", ("gap",), w, f"avg({acc}) OVER {f}"
    rv = s.hold(s.roll("sum", "buy * buy"), 0)
    g = s.frame(-(6 * W - 1))
    yield "z_rv", "derived.z_rv", ("buy",), w, f"CASE WHEN count({rv}) OVER {g} >= {W} THEN {s.clip(s.div(f'{rv} - avg({rv}) OVER {g}', f'stddev_samp({rv}) OVER {g}'), -20, 20)} END"


def _s3(s: Sql):
    w = {"window_s": W}
    f = s.frame(-(W - 1))
    sd, q = "(buy - sell)", max(2, W // 4)
    same = s.hold(s.same_sign(sd))
    yield "signed", "derived.sub:S4", ("buy", "sell"), {}, sd
    yield "ratio", "derived.ratio", ("b2", "sell"), {}, "b2 / (abs(sell) + 1e-12)"
    yield "persist", "derived.signal_persist", ("signed",), w, s.roll("avg", same)
    yield "flips", "derived.signal_flip_rate", ("signed",), w, s.roll("sum", f"(1 - {same})") + f" / {W}.0"
    yield "cross_persist", "s3.cross_persist", ("signed",), w, s.roll("avg", same)
    yield "z", "derived.robust_zscore", ("px",), w, s.z("px", 20)
    yield "logratio", "derived.logratio", ("signed", "b2"), {}, f"sign({sd}) * ln(abs({sd}) + 1e-12) - sign(b2) * ln(abs(b2) + 1e-12)"
    yield "mid", "s3.absorb_refill_mid", ("b1", "b2"), {}, "(b1 + b2) / 2"
    yield "asym", "s3.absorption_asymmetry", ("b1", "b2"), {}, s.eps("b1 - b2", "b1 + b2")
    middle = s.hold(s.roll("median", "px", W, 10))
    yield "break_flag", "s3.absorption_break_flag", ("b1", "b2", "px"), {"window_s": W, "min_periods": 10}, f"CASE WHEN {middle} IS NOT NULL THEN CASE WHEN b1 > 2.0 AND abs(b2) > 0.3 AND px < {middle} THEN 1 ELSE 0 END END"
    yield "tar_bps", "s3.trade_absorption_ratio_bps", ("gap",), {}, "gap"
    yield "div", "s3.cross_div", ("spot", "fut"), {}, "spot - fut"
    yield "share", "s3.cross_share", ("spot", "fut"), {}, s.eps("spot", "spot + fut")
    yield "delta", "s3.cross_div_delta", ("spot", "fut"), {}, f"(spot - fut) - {s.lag('(spot - fut)')}"
    d1 = s.hold(f"px - {s.lag('px')}")
    yield "d1_px", "s3.temporal_d1", ("px",), {}, d1
    yield "d2_px", "s3.temporal_d2", ("px", "d1_px"), {}, f"{d1} - {s.lag(d1)}"
    med = s.hold(s.roll("median", "gap", W, q))
    dev = s.hold(f"abs(gap - {med})", 1)
    mad = s.hold(s.roll("median", dev, W, q), 2)
    yield "median_gap", "s3.roll_median", ("gap",), w, med
    yield "mad_gap", "s3.roll_mad", ("gap", "median_gap"), w, mad
    yield "shock", "s3.shock", ("gap", "median_gap", "mad_gap"), w, s.clip(f"(CASE WHEN {mad} > 0 THEN (gap - {med}) / (1.4826 * {mad}) END)", -50, 50)
    yield "agree", "s3.dir_consistency_persist", ("signed", "gap"), {}, f"CASE WHEN gap IS NOT NULL THEN CASE WHEN sign({sd}) = sign(gap) THEN 1 ELSE 0 END END"
    yield "dir_asym", "s3.dir_consistency_asym", ("b1", "b2"), {}, "b1 - b2"
    yield "refill_pull", "s3.refill_vs_pull_ratio", ("b1", "sell"), {}, f"CASE WHEN sell <= 1e-12 AND b1 <= 1e-12 THEN 1 WHEN sell > 1e-12 THEN {s.clip('b1 / sell', 0, 1e6)} END"
    yield "coherence", "s3.qp_depth_coherence", ("signed", "b2", "b5", "b10"), {}, f"CASE WHEN sign({sd}) <> 0 AND sign({sd}) = sign(b2) AND sign(b2) = sign(b5) AND sign(b5) = sign(b10) THEN 1 ELSE 0 END"
    yield "slope", "s3.qp_depth_slope", ("b1", "b2", "b5", "b10"), {}, "(b1 * (1 - 4.5) + b2 * (2 - 4.5) + b5 * (5 - 4.5) + b10 * (10 - 4.5)) / 49.0"
    yield "curvature", "s3.qp_depth_curvature", ("b1", "b2", "b5", "b10"), {}, "((b5 - 2 * b2 + b1) + (b10 - 2 * b5 + b2)) / 2"
    yield "vacuum", "s3.vacuum_score", ("b1", "gap"), {}, "b1 - gap"
    yield "mean", "derived.roll_mean", ("gap",), {"window_s": 3}, s.roll("avg", "gap", 3)
    yield "sum", "derived.roll_sum", ("b1",), w, s.roll("sum", "b1")
    vals = {x: s.hold(f"list({x}) FILTER ({x} IS NOT NULL) OVER {f}") for x in ("b1", "b2", "b5", "gap")}
    size = s.hold(f"count(*) OVER {f}")
    rank = lambda x: f"(CASE WHEN coalesce(len({vals[x]}), 0) >= 5 THEN CASE WHEN {x} IS NULL THEN 0.5 / {size} ELSE (len(list_filter({vals[x]}, lambda v: v < {x})) + (len(list_filter({vals[x]}, lambda v: v = {x})) + 1) / 2.0) / {size} END END)"
    yield "break_score", "s3.absorption_break", ("b1", "b2", "b5", "gap"), {"window_s": W, "min_periods": 5}, f"0.35 * {rank('b1')} + 0.25 * {rank('b2')} + 0.25 * {rank('b5')} - 0.15 * {rank('gap')}"


def _s4(s: Sql):
    import math

    w = {"window_s": W}
    f = s.frame(-(W - 1))
    sd, q = "(buy - sell)", max(2, W // 4)
    same = s.hold(s.same_sign(sd))
    yield "signed", "derived.sub", ("buy", "sell"), {}, sd
    d1 = s.hold(f"px - {s.lag('px')}")
    yield "d1_px", "derived.d1", ("px",), {}, d1
    yield "d2_px", "derived.d2", ("px", "d1_px"), {}, f"{d1} - {s.lag(d1)}"
    med = s.hold(s.roll("median", "gap", W, q))
    dev = s.hold(f"abs(gap - {med})", 1)
    mad = s.hold(s.roll("median", dev, W, q), 2)
    yield "median_gap", "derived.rolling_median", ("gap",), w, med
    yield "mad_gap", "derived.rolling_mad", ("gap", "median_gap"), w, mad
    yield "shock", "derived.robust_shock", ("gap", "median_gap", "mad_gap"), w, s.clip(f"(CASE WHEN {mad} > 0 THEN abs(gap - {med}) / (1.4826 * {mad}) END)", -50, 50)
    yield "market_div", "derived.cross_market_div", ("fut", "b10"), {}, s.eps("fut", "b10")
    yield "ratio", "derived.ratio", ("b2", "sell"), {}, "CASE WHEN abs(sell) >= 1e-6 THEN b2 / (abs(sell) + 1e-12) END"
    pairs = [("signed", "b2"), ("signed", "b5"), ("signed", "gap"), ("b2", "b5"), ("b2", "gap"), ("b5", "gap")]
    t = lambda n: sd if n == "signed" else n
    hit = " + ".join(f"CASE WHEN sign({t(a)}) = sign({t(b)}) AND sign({t(a)}) <> 0 THEN 1 ELSE 0 END" for a, b in pairs)
    yield "coherence", "derived.depth_coherence", ("signed", "b2", "b5", "gap"), {}, f"CASE WHEN gap IS NOT NULL THEN ({hit}) / 6.0 END"
    at = [math.log(v) for v in (1, 2, 5, 10)]
    mid = sum(at) / 4
    below = sum((a - mid) ** 2 for a in at)
    yield "slope", "derived.depth_slope", ("b1", "b2", "b5", "b10"), {}, " + ".join(f"{b} * ({(a - mid) / below!r})" for a, b in zip(at, ("b1", "b2", "b5", "b10"), strict=True))
    yield "curvature", "derived.depth_curvature", ("b1", "b2", "b5", "b10"), {}, "((b5 - 2 * b2 + b1) + (b10 - 2 * b5 + b2)) / 2"
    yield "persist", "derived.signal_persist", ("signed",), w, s.roll("avg", same)
    yield "flips", "derived.signal_flip_rate", ("signed",), w, s.roll("sum", f"(1 - {same})") + f" / {W}.0"
    vals = s.hold(f"list(gap) FILTER (gap IS NOT NULL) OVER {f}")
    yield "pct_rank", "derived.pct_rank", ("gap",), w, f"CASE WHEN len({vals}) >= 5 AND gap IS NOT NULL THEN (len(list_filter({vals}, lambda v: v < gap)) + (len(list_filter({vals}, lambda v: v = gap)) + 1) / 2.0) / len({vals}) END"
    yield "z_gap", "derived.robust_zscore", ("gap",), w, s.z("gap", 20, W, 5)
    yield "sum", "derived.roll_sum", ("gap",), w, f"sum(gap) OVER {f}"
    yield "logratio", "derived.logratio", ("gap",), {}, f"avg(gap) OVER {s.frame(-4)}"
    yield "pass", "derived.passthrough", ("gap",), {}, "gap"


def _s5(s: Sql):
    w = {"window_s": W}
    q = max(2, W // 4)
    med = s.hold(s.roll("median", "gap", W, q))
    dev = s.hold(f"abs(gap - {med})", 1)
    mad = s.hold(s.roll("median", dev, W, q), 2)
    sd = "(buy - sell)"
    yield "signed", "derived.sub:S4", ("buy", "sell"), {}, sd
    yield "median_gap", "derived.rolling_median", ("gap",), w, med
    yield "mad_gap", "derived.rolling_mad", ("gap", "median_gap"), w, mad
    yield "shock", "derived.robust_shock", ("gap", "median_gap", "mad_gap"), w, s.clip(f"(CASE WHEN {mad} > 0 THEN abs(gap - {med}) / {mad} END)", 0, 50)
    yield "z", "derived.robust_zscore", ("gap",), w, s.z("gap", 20, W, q)
    yield "persist", "derived.signal_persist", ("signed",), w, s.clip(f"abs({s.roll('avg', sd)}) / ({s.roll('avg', f'abs({sd})')} + 1e-9)", 0, 1)


def _s2_shared(s: Sql):
    """Operators of S2 that other stages have as well, and the bands' coherence."""
    w = {"window_s": W}
    f = s.frame(-(W - 1))
    yield "basis_vwap", "derived.basis_vwap", ("px", "lo"), {}, "px - lo"
    yield "queue_div", "deriv.queue_pressure_log_div", ("b1", "b5"), {}, "b1 - b5"
    yield "taker", "trades.taker_imbalance_bucket", ("buy",), w, s.roll("avg", "buy")
    yield "basis_mid", "deriv.basis_mid", ("gap", "lo"), w, f"avg(gap - lo) OVER {f}"
    yield "activity", "deriv.spot_fut_taker_activity_share_1s", ("spot", "b1", "fut", "b2"), {}, s.eps("spot + b1", "spot + b1 + fut + b2")
    yield "imbalance", "l2.queue_imbalance_1s", ("b1", "b5"), {}, s.eps("b1 - b5", "b1 + b5")
    yield "queue_log", "l2.queue_pressure_log_1s", ("b1", "b5"), {}, "ln((b1 + 1e-12) / (b5 + 1e-12))"
    for side in ("ask", "bid"):
        yield f"absorb_{side}", f"l2.absorb_refill_{side}", ("b1", "b2"), {}, "b1 * b2"
        yield f"absorp_{side}", f"l2.aggr_absorp_ratio_{side}", ("b5", "b1"), {}, s.clip(s.div("b5", "b1"), 0, 1e6)
    corr = [s.hold(f"CASE WHEN count({a}) OVER {f} >= 3 AND stddev_pop({a}) OVER {f} >= 1e-12 AND stddev_pop({b}) OVER {f} >= 1e-12 THEN corr({a}, {b}) OVER {f} END") for a, b in (("b1", "b2"), ("b1", "b5"), ("b2", "b5"))]
    total = " + ".join(f"coalesce({r}, 0)" for r in corr)
    n = " + ".join(f"({r} IS NOT NULL)::INT" for r in corr)
    yield "coherence", "derived.depth_coherence", ("b1", "b2", "b5"), w, f"CASE WHEN row_number() OVER {s.A} >= {W} AND {n} > 0 THEN ({total}) / ({n}) END"


SETS = {"s1_values": ("S1", _s1), "s1_rolling": ("S1", _s1_rolling), "s2_dynamics": ("S2", _s2), "s2_shared": ("S2", _s2_shared), "s3_markets": ("S3", _s3), "s4_meta": ("S4", _s4), "s5_signals": ("S5", _s5)}


def feature_list(name: str) -> list[Feature]:
    stage, make = SETS[name]
    out = []
    for col, op, deps, params, _ in make(Sql()):
        op, _, other = op.partition(":")
        out.append(Feature(col, other or stage, op, tuple(deps), params))
    return out


def query(name: str, size: int = 0):
    """The set's columns; with ``size``, series are cut into chunks of so many rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        features = feature_list(name)
        chunks = Chunks(F.year("bucket"), size) if size else None
        df = compute(bars(spark, sf_dir), features, ["asset"], ["bucket"], chunks=chunks)
        return df.select("asset", F.col("bucket").cast("string").alias("bucket"), *(F.round(f.name, 6).alias(f.name) for f in features))

    return run


def sql(name: str) -> str:
    s = Sql()
    columns = [(col, text) for col, _, _, _, text in SETS[name][1](s)]
    return s.query(BARS_SQL, columns)
