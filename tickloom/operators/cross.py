"""S6: one asset against another, after a join on the bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import clip, correlation
from ..plans.spec import register
from . import common as c


def _op(name, deps, build, window=False):
    register("S6", name, deps, build, window)


def _beta(t, x, p):
    """y on x: covariance over pairs, variance over all x of the window; NULL unless both fill it."""
    w = c.width(p)
    frame = t.trail(w)
    pairs = F.count(F.when(x[0].isNotNull() & x[1].isNotNull(), 1)).over(frame)
    beta = F.covar_samp(x[0], x[1]).over(frame) / (F.var_samp(x[1]).over(frame) + 1e-12)
    most = float(p.get("beta_clip", 5))
    return clip(F.when((pairs >= w) & (F.count(x[1]).over(frame) >= w), beta), -most, most)


def _lag_corr(t, x, p):
    w = c.width(p)
    lead = t.hold(t.lag(x[0], int(p["lag_s"])), 0)
    frame = t.trail(w)
    pairs = F.count(F.when(lead.isNotNull() & x[1].isNotNull(), 1)).over(frame)
    r = correlation(lead, x[1], frame)
    return F.when((pairs >= w) & ~F.isnan(r), r)


def _align(t, x, p):
    on = lambda v: F.coalesce(v, F.lit(0.0)) != 0
    return (on(x[0]) & on(x[1])).cast("double")


_op("derived.sub", 2, c.sub)
_op("derived.robust_zscore", 1, c.zscore(None, eps=1e-8), True)
_op("derived.cross_asset_diff", 2, c.sub)
_op("derived.bps_mid_dev", 2, lambda t, x, p: F.try_divide(x[0] - x[1], x[1]) * 1e4)
_op("derived.rolling_ols_beta", 2, _beta, True)
_op("derived.beta_residual", 3, lambda t, x, p: x[0] - x[2] * x[1])
_op("derived.cross_lag_corr", 2, _lag_corr, True)
_op("derived.bps_spread", 2, lambda t, x, p: F.try_divide(x[0], x[1]) * 1e4)
_op("derived.regime_xor", 2, lambda t, x, p: F.abs(x[0] - x[1]))
_op("derived.regime_align", 2, _align)


def side_by_side(bars: DataFrame, asset: str, assets: list[str], bucket: str = "bucket") -> DataFrame:
    """Inner join of the assets on the bucket; every other column gets the asset's suffix."""
    parts = []
    for a in assets:
        one = bars.where(F.col(asset) == a).drop(asset)
        parts.append(one.select(bucket, *(F.col(c).alias(f"{c}_{a}") for c in one.columns if c != bucket)))
    return reduce(lambda x, y: x.join(y, bucket), parts)
