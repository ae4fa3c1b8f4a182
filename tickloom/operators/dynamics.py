"""S2: rolling aggregates, shocks, rates and impact."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.num import EPS, big, clip, correlation, flag, over, quiet_ratio
from ..plans.spec import OPERATORS, register
from . import common as c
from . import stage1  # noqa: F401  S2 shares some of its operators


def _op(name, deps, build, window=False):
    register("S2", name, deps, build, window)


def _mad(t, x, p):
    raw = [v for v, n in zip(x, p["names"], strict=True) if not n.startswith("median_")] or x[:1]
    return t.middle(raw[0], c.width(p), c.width(p), 0)[1]


def _rate(t, x, p):
    raw = quiet_ratio(x[0] + x[1], x[2] + x[3], 0.0) if len(x) == 4 else clip(over(x[0], x[1]), 0, 1e6)
    return t.smooth(raw, c.width(p), 0)


def _churn(t, x, p):
    return quiet_ratio(x[0] + x[1], x[2], 0.0) if len(x) > 2 else x[0] + x[1]


def _absorption(t, x, p):
    ret, vol = F.abs(x[0]), x[1]
    return F.when(~big(vol) & ~big(ret), 0.0).when(big(vol), ret / vol)


def _autocorr(t, x, p):
    w = c.width(p)
    before = t.hold(t.lag(x[0]), 0)
    r = correlation(x[0], before, t.rows(-(w - 2), 0))
    return F.when((F.count(x[0]).over(t.trail(w)) >= max(10, w // 2)) & ~F.isnan(r), r)


def _roles(p: dict, x: list[Column]) -> dict[str, Column]:
    """Inputs by what their names say."""
    out: dict[str, Column] = {}
    for n, v in zip((n.lower() for n in p["names"]), x, strict=True):
        if n.startswith("ret_") or "_ret_" in n:
            out["ret"] = v
        elif "signed" in n:
            out["signed"] = v
        elif n.startswith(("volume_", "vol_")) or "_volume_" in n:
            out["vol"] = v
        elif "depth" in n and ("ask" in n or "bid" in n):
            out["ask" if "ask" in n else "bid"] = v
        elif "vwap" in n:
            out["vwap"] = v
        elif "mid" in n:
            out["mid"] = v
    return out


def _per_liquidity(t, x, p):
    r = _roles(p, x)
    raw = F.abs(r.get("ret", x[-2])) * r.get("vol", x[-1])
    depth = [r[s] for s in ("ask", "bid") if s in r]
    if depth:
        raw = over(raw, sum(depth[1:], depth[0]))
    return t.mean(t.hold(raw, 0), c.width(p), 1)


def _per_signed(t, x, p):
    r = _roles(p, x)
    return t.mean(t.hold(over(r.get("ret", x[0]), r.get("signed", r.get("vol", x[1]))), 0), c.width(p), 1)


def _regime(t, x, p):
    """Both |ret| and volume lie over their mean by more than two deviations; NULL while windows fill."""
    w = c.width(p)
    ret = F.abs(x[0])
    means = [t.mean(v, w) for v in (ret, x[1])]
    over_two = [v > m + 2 * t.roll(F.stddev_samp, v, w) for v, m in zip((ret, x[1]), means, strict=True)]
    return F.when(means[0].isNotNull() & means[1].isNotNull(), flag(over_two[0] & over_two[1]))


def _one_way(t, x, p):
    w = c.width(p)
    up, down = (t.roll(F.sum, flag(v), w) for v in (x[0] > 0, x[0] < 0))
    return F.when(up + down > 0, F.greatest(up, down) / (up + down))


def _coherence(t, x, p):
    """Mean of the pairwise rolling correlations of the bands that can be told."""
    w = c.width(p)
    frame = t.trail(w)
    total, n = F.lit(0.0), F.lit(0)
    for a, b in combinations(x, 2):
        both = a.isNotNull() & b.isNotNull()
        u, v = F.when(both, a), F.when(both, b)
        r = correlation(u, v, frame)
        told = (F.count(u).over(frame) >= 3) & (F.stddev_pop(u).over(frame) >= EPS) & (F.stddev_pop(v).over(frame) >= EPS)
        r = t.hold(F.when(told & ~F.isnan(r), r), 0)
        total, n = total + F.coalesce(r, F.lit(0.0)), n + r.isNotNull().cast("int")
    all_there = t.filled(w)
    for v in x:
        all_there = all_there & (F.count(v).over(frame) > 0)
    return F.when(all_there & (n > 0), total / n)


def _vwap_return(t, x, p):
    r = _roles(p, x)
    return t.mean(t.hold(F.ln(F.try_divide(r.get("vwap", x[0]), r.get("mid", x[1]))), 0), c.width(p), 1)


def _z_rv(t, x, p):
    w = c.width(p)
    rv = t.hold(t.roll(F.sum, x[0] * x[0], w), 0)
    long = t.trail(6 * w)
    told = F.count(rv).over(long) >= w
    return clip(F.when(told, over(rv - F.avg(rv).over(long), F.stddev_samp(rv).over(long))), -20, 20)


def _acceleration(t, x, p):
    d2 = x[0] - 2 * t.lag(x[0]) + t.lag(x[0], 2)
    return t.mean(t.hold(d2, 0), c.width(p), 1)


def _net_add(t, x, p):
    return (x[0] - x[1]) - (x[2] - x[3]) if len(x) >= 4 else x[0] - x[1]


MANY = 8
_op("derived.roll_mean", (1, MANY), c.roll_mean(), True)
_op("derived.roll_sum", 1, c.roll_sum(), True)
_op("derived.roll_median", 1, c.roll_median(), True)
_op("derived.mad", (1, 2), _mad, True)
_op("derived.robust_zscore", (1, MANY), c.zscore(20), True)
_op("derived.shock_detect", (3, 3), c.shock(c.MAD_SCALE, True, -50, 50), True)
_op("derived.shock", 2, lambda t, x, p: F.sqrt(x[0] * x[0] + x[1] * x[1]))
_op("derived.ofi_shock", 1, lambda t, x, p: c.moment_z(t, x[0], c.width(p), 100), True)
_op("derived.d1", 1, c.change)
_op("derived.d2", (1, 2), c.second_change(False))
_op("derived.sub", 2, c.sub)
_op("derived.product", 2, c.product)
_op("derived.ratio", (2, MANY), c.guarded)
_op("derived.asymmetry", 2, c.asymmetry)
_op("l2.net_add_pressure", (2, 4), _net_add)
_op("l2.net_cancel_pressure", 2, c.sub)
_op("l2.pull_rate", (2, 4), _rate)
_op("l2.refill_rate", (2, 4), _rate)
_op("l2.refill_rate_behind", 2, c.guarded)
_op("l2.cancel_rate_ahead", 2, c.guarded)
_op("l2.cancel_rate_behind", 2, c.guarded)
_op("derived.basis_vwap", 2, c.sub)
_op("deriv.queue_pressure_log_div", 2, c.sub)
_op("derived.z_volume_asym", 2, lambda t, x, p: c.moment_z(t, x[0] - x[1], c.width(p), 100), True)
_op("trades.trade_absorption_ratio_1s", 2, _absorption)
_op("trades.taker_imbalance_bucket", 1, c.roll_mean(), True)
_op("derived.autocorr", 1, _autocorr, True)
_op("derived.impact_per_liquidity", (2, 4), _per_liquidity, True)
_op("derived.impact_per_signed", (2, 4), _per_signed, True)
_op("derived.breakout_regime_flag", 2, _regime, True)
_op("derived.dir_consistency", 1, lambda t, x, p: t.mean(t.hold(c.agreement(t, x[0], True), 0), c.width(p)), True)
_op("derived.unidir_ratio", 1, _one_way, True)
_op("derived.depth_coherence", (2, 4), _coherence, True)
_op("derived.depth_slope", (2, 4), c.slope([1, 2, 5, 10]))
_op("derived.depth_curvature", (3, 4), c.curvature)
_op("derived.mid_touch_dev", 2, lambda t, x, p: over(x[0] - x[1], x[1]) * 1e4)
_op("derived.price_acceleration", 1, _acceleration, True)
_op("derived.price_deviation_bps", 2, lambda t, x, p: over(x[0] - x[1], x[0]) * 1e4)
_op("derived.ret_vwap", 2, _vwap_return, True)
_op("derived.z_rv", 1, _z_rv, True)
for _side in ("ask", "bid"):
    _op(f"l2.absorb_refill_{_side}", 2, c.product)
    _op(f"l2.churn_{_side}", (2, 3), _churn)
    _op(f"l2.aggr_absorp_ratio_{_side}", 2, OPERATORS["S1", f"l2.aggr_absorp_ratio_{_side}"].build)
for _name in ("deriv.basis_mid", "deriv.spot_fut_taker_activity_share_1s", "l2.queue_imbalance_1s", "l2.queue_pressure_log_1s"):
    _op(_name, OPERATORS["S1", _name].least, OPERATORS["S1", _name].build)
_op("derived.participation_rate_1s", (1, 2), OPERATORS["S1", "derived.participation_rate_1s"].build)
