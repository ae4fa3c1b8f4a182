"""S1: per-bucket derived values. Missing inputs give NULL unless a line says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.num import EPS, Tape, big, bps, clip, flag, over, over_eps
from ..plans.spec import register
from . import common as c


def _op(name, deps, build, window=False):
    register("S1", name, deps, build, window)


def _count_ratio(t, x, p):
    return F.when(~F.coalesce(x[0] > EPS, F.lit(False)) & ~big(x[0]), F.lit(0.0)).otherwise(clip(over(x[0], x[1]), 0, 1e6))


def _range(t: Tape, x: Column, w: int) -> tuple[Column, Column]:
    return F.max(x).over(t.trail(w)), F.min(x).over(t.trail(w))


def _range_pct(t, x, p):
    hi, lo = _range(t, x[0], c.width(p))
    return over_eps(hi - lo, (hi + lo) / 2)


def _range_pos(t, x, p):
    hi, lo = _range(t, x[0], c.width(p))
    return over_eps(x[0] - lo, hi - lo)


def _forward(t: Tape, fn, x: Column, w: int) -> Column:
    return fn(x).over(t.rows(0, w - 1))


def _rv_fwd(t, x, p):
    w = c.width(p)
    r = t.hold(F.ln(F.try_divide(x[0], t.lag(x[0]))), 0)
    ahead = t.rows(1, w)
    return F.when(F.count(r).over(ahead) >= w, F.sqrt(F.sum(r * r).over(ahead)))


def ema(t: Tape, x: Column, span: float) -> Column:
    """alpha = 2/(span+1), seeded by the first value; a NULL carries the last value on."""
    a = 2.0 / (span + 1.0)
    if a >= 1:
        return F.last(x, ignorenulls=True).over(t.so_far())
    n = t.hold(F.count(x).over(t.so_far()) - 1, 0)
    weighed = F.when(n == 0, x).otherwise(a * x)
    got = t.hold(t.decayed(weighed, 1 - a, n, 1), 5)
    return F.last(got, ignorenulls=True).over(t.so_far())


def _participation(t, x, p):
    """x over its exponentially weighted mean (all weights kept, NULL rows age the others)."""
    r = math.exp(-math.log(2) / float(p.get("ewma_halflife_s", 3600)))
    row = t.hold(F.row_number().over(t.series) - 1, 0)
    num = t.hold(t.decayed(F.coalesce(x[0], F.lit(0.0)), r, row, 1), 5)
    den = t.hold(t.decayed(x[0].isNotNull().cast("double"), r, row, 1), 5)
    return over_eps(x[0], F.try_divide(num, den))


def _cross(t: Tape, x: list[Column], up: bool) -> Column:
    now, level = x[0], x[1]
    if up:
        return flag((t.lag(now) < t.lag(level)) & (now >= level))
    return flag((t.lag(now) > t.lag(level)) & (now <= level))


def _break(up: bool):
    def build(t, x, p):
        crossed = t.hold(_cross(t, x, up), 0)
        side = flag(x[0] > x[1]) if up else flag(x[0] < x[1])
        return F.max(crossed).over(t.trail(c.width(p))) * side

    return build


def _lag_bps(t, x, p):
    before = t.lag(x[0], int(p["shift_s"]))
    return bps(x[0] - before, before)


def _variation(t: Tape, x: Column, w: int) -> Column:
    return F.stddev_pop(x).over(t.trail(w)) / (F.abs(F.avg(x).over(t.trail(w))) + EPS)


def _cluster_asymmetry(t, x, p):
    w = max(c.width(p), 2)
    ask, bid = t.hold(_variation(t, x[0], w), 0), t.hold(_variation(t, x[1], w), 0)
    return over_eps(bid - ask, bid + ask)


def _net_pressure(t, x, p):
    """Inputs: add_bid, cancel_bid, add_ask, cancel_ask, depth_ask, depth_bid."""
    raw = over((x[0] - x[1]) - (x[2] - x[3]), x[4] + x[5])
    return t.smooth(raw, c.width(p), 0)


def _rate(always: bool = False):
    def build(t, x, p):
        raw = over_eps(x[0] + x[1], x[2] + x[3])
        return t.smooth(clip(raw, 0, 1e6), max(c.width(p), 2 if always else 0), 0)

    return build


def _trend(t, x, p):
    price, short, long = x
    up, down = (price > short) & (short > long), (price < short) & (short < long)
    return F.when(up, 1.0).when(down, -1.0).otherwise(0.0)


def _fib(t, x, p):
    level = x[1] + float(p["fib_level"]) * (x[2] - x[1])
    return bps(x[0] - level, x[0])


def _value_area(t, x, p):
    price, high, low = x
    return F.when(price < low, 0.0).when(price > high, 2.0).otherwise(1.0)


_op("derived.add", 2, c.add)
_op("derived.sub", 2, c.sub)
_op("derived.ratio", 2, lambda t, x, p: clip(over(x[0], x[1]), -1e6, 1e6))
_op("derived.count_ratio", 2, _count_ratio)
_op("derived.share", 2, c.share)
_op("derived.roll_mean", 1, lambda t, x, p: t.mean(x[0], c.width(p)), True)
_op("derived.roll_sum", 1, lambda t, x, p: t.roll(F.sum, x[0], c.width(p)), True)
_op("derived.robust_zscore", 1, c.zscore(100, eps=EPS))
_op("derived.zscore_diff", 2, lambda t, x, p: c.zscore(100, eps=EPS)(t, [x[0] - x[1]], {**p, "names": ("diff",)}), True)
_op("derived.log_return", 1, lambda t, x, p: F.ln(F.try_divide(x[0], t.lag(x[0]))))
_op("derived.ret_fwd", 1, lambda t, x, p: F.ln(F.try_divide(t.lead(x[0], c.width(p)), x[0])), True)
_op("derived.range_pct", 1, _range_pct, True)
_op("derived.range_pos", 1, _range_pos, True)
_op("range.dist_to_high_bps", 2, lambda t, x, p: bps(x[1] - x[0], x[0]))
_op("range.dist_to_low_bps", 2, lambda t, x, p: bps(x[0] - x[1], x[0]))
_op("range.ext_position", 3, lambda t, x, p: clip(over_eps(x[0] - x[1], x[2] - x[1]), 0, 1))
_op("range.ext_range_bps", 2, lambda t, x, p: clip(over_eps(x[0] - x[1], (x[0] + x[1]) / 2) * 1e4, 0, 1e5))
_op("derived.mae_fwd", 1, lambda t, x, p: clip(over_eps(x[0] - _forward(t, F.min, x[0], c.width(p)), x[0]) * 1e4, 0, 1e5), True)
_op("derived.mfe_fwd", 1, lambda t, x, p: clip(over_eps(_forward(t, F.max, x[0], c.width(p)) - x[0], x[0]) * 1e4, 0, 1e5), True)
_op("derived.rv_fwd", 1, _rv_fwd, True)
_op("derived.ema", 1, lambda t, x, p: ema(t, x[0], float(p["span_s"])))
_op("derived.price_vs_ema_bps", 2, lambda t, x, p: bps(x[0] - x[1], x[1]))
_op("derived.ema_slope_bps", 1, _lag_bps)
_op("derived.trend_align", 3, _trend)
_op("range.dist_to_level_bps", 2, lambda t, x, p: bps(x[0] - x[1], x[0]))
_op("derived.above_level", 2, lambda t, x, p: flag(x[0] > x[1]))
_op("derived.below_level", 2, lambda t, x, p: flag(x[0] < x[1]))
_op("derived.reclaim_flag", 2, _break(True), True)
_op("derived.break_flag_high", 2, _break(True), True)
_op("derived.break_flag_low", 2, _break(False), True)
_op("derived.fib_dist_bps", 3, _fib)
_op("derived.price_vs_va", 3, _value_area)
_op("derived.poc_migration_bps", 1, _lag_bps)
_op("derived.basis", 2, c.sub)
_op("deriv.basis_mid", 2, lambda t, x, p: t.smooth(x[0] - x[1], c.width(p), 0))
_op("derived.basis_bps", 2, lambda t, x, p: t.smooth(over_eps(x[0] - x[1], x[1]) * 1e4, c.width(p), 0))
_op("deriv.spot_fut_taker_activity_share_1s", 4, lambda t, x, p: over_eps(x[0] + x[1], x[0] + x[1] + x[2] + x[3]))
_op("derived.participation_rate_1s", 1, _participation)
_op("trades.avg_trade_size", 2, c.guarded)
_op("trades.taker_imbalance", 2, c.asymmetry)
_op("trades.vwap", 2, c.guarded)
_op("l2.book_asymmetry", 2, c.asymmetry)
_op("l2.liq_cluster_asymmetry", 2, _cluster_asymmetry, True)
_op("l2.liq_sum", 2, c.add)
_op("l2.mid_touch", 2, c.half_sum)
_op("l2.queue_imbalance_1s", 2, c.asymmetry)
_op("l2.queue_pressure", 2, lambda t, x, p: t.smooth(c.asymmetry(t, x, p), c.width(p), 0))
_op("l2.queue_pressure_log_1s", 2, lambda t, x, p: F.ln((x[0] + EPS) / (x[1] + EPS)))
_op("l2.net_pressure", 6, _net_pressure, True)
_op("l2.fill_rate_ahead", 4, _rate(always=True), True)
_op("l2.pull_rate", 4, _rate(), True)
_op("l2.refill_rate", 4, _rate(), True)
_op("l2.l2_update_count", 2, lambda t, x, p: flag(big(x[0] - t.lag(x[0])) | big(x[1] - t.lag(x[1]))))
for _side in ("ask", "bid"):
    _op(f"l2.depth_gradient_{_side}", 2, lambda t, x, p: clip((x[1] - x[0]) / (F.abs(x[1]) + EPS), 0, 1))
    _op(f"l2.liq_concentration_{_side}", 2, lambda t, x, p: clip(x[0] / (F.abs(x[1]) + EPS), 0, 1))
    _op(f"l2.absorb_refill_{_side}", 2, c.product)
    _op(f"l2.aggr_absorp_ratio_{_side}", 2, lambda t, x, p: clip(over(x[0], x[1]), 0, 1e6))
    _op(f"l2.add_rate_{_side}", 1, lambda t, x, p: F.coalesce(F.greatest(F.lit(0.0), x[0] - t.lag(x[0])), F.lit(0.0)))
    _op(f"l2.cancel_rate_{_side}", 1, lambda t, x, p: F.coalesce(F.greatest(F.lit(0.0), t.lag(x[0]) - x[0]), F.lit(0.0)))
