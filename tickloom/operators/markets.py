"""S3: absorption, cross-market differentials and depth profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.num import EPS, flag, quiet_ratio
from ..plans.spec import register
from . import common as c


def _op(name, deps, build, window=False):
    register("S3", name, deps, build, window)


def _quarter(w: int) -> int:
    return max(2, w // 4)


def _log_difference(t, x, p):
    part = lambda v: F.signum(v) * F.ln(F.abs(v) + EPS)
    return part(x[0]) - part(x[1])


def _break_flag(t, x, p):
    """Inputs: trade absorption, imbalance, refill mid (others aren't looked at)."""
    tar, imbalance, refill = x[0], x[1], x[2]
    middle = t.hold(t.median(refill, int(p.get("window_s", 60)), int(p.get("min_periods", 30))), 0)
    hit = (tar > float(p.get("tar_threshold", 2.0))) & (F.abs(imbalance) > float(p.get("imbalance_threshold", 0.3))) & (refill < middle)
    return F.when(tar.isNotNull() & imbalance.isNotNull() & middle.isNotNull(), flag(hit))


def _window_rank(t, x, w, least):
    """Percentile of the last value among the last w rows; NULL rows count in the length alone."""
    frame = t.trail(w)
    values = t.hold(F.collect_list(x).over(frame), 1)
    length = t.hold(F.count(F.lit(1)).over(frame), 1)
    got = F.when(x.isNull(), F.try_divide(F.lit(0.5), length)).otherwise(c.rank_share(values, x, length))
    return F.when(F.size(values) >= least, got)


def _break_score(t, x, p):
    """Inputs: trade absorption, imbalance, impact, refill mid."""
    w, least = int(p.get("window_s", 300)), int(p.get("min_periods", 60))
    weights = (0.35, 0.25, 0.25, -0.15)
    cols = [x[0], F.abs(x[1]), F.abs(x[2]), x[3]]
    ranks = [_window_rank(t, t.hold(v, 0), w, least) for v in cols]
    return sum((r * k for r, k in zip(ranks[1:], weights[1:], strict=True)), ranks[0] * weights[0])


def _all_agree(t, x, p):
    signs = [F.signum(v) for v in x]
    same = signs[0] != 0
    for s in signs[1:]:
        same = same & (s == signs[0])
    return F.when(F.coalesce(*(F.when(v.isNull(), F.lit(True)) for v in x), F.lit(False)), F.lit(None).cast("double")).otherwise(same.cast("double"))


_op("derived.ratio", 2, lambda t, x, p: x[0] / (F.abs(x[1]) + EPS))
_op("derived.roll_mean", 1, c.roll_mean(), True)
_op("derived.roll_sum", 1, c.roll_sum(), True)
_op("derived.signal_persist", 1, c.persist(), True)
_op("derived.signal_flip_rate", 1, c.flip_rate, True)
_op("derived.robust_zscore", (1, 8), c.zscore(20), True)
_op("derived.logratio", 2, _log_difference)
_op("s3.absorb_refill_mid", 2, c.half_sum)
_op("s3.absorption_asymmetry", 2, c.asymmetry)
_op("s3.absorption_break_flag", (3, 5), _break_flag)
_op("s3.absorption_break", (4, 5), _break_score)
_op("s3.trade_absorption_ratio_bps", 1, c.same)
_op("s3.cross_div", 2, c.sub)
_op("s3.cross_persist", 1, c.persist(300))
_op("s3.cross_share", 2, c.share)
_op("s3.cross_div_delta", 2, lambda t, x, p: c.change(t, [x[0] - x[1]], p))
_op("s3.temporal_d1", 1, c.change)
_op("s3.temporal_d2", (1, 2), c.second_change(True))
_op("s3.roll_median", 1, lambda t, x, p: c.roll_median(_quarter)(t, x, {"window_s": 300, **p}))
_op("s3.roll_mad", 2, lambda t, x, p: c.roll_mad_given(_quarter)(t, x, {"window_s": 300, **p}))
_op("s3.shock", 3, c.shock(c.MAD_SCALE, True, -50, 50))
_op("s3.dir_consistency_persist", 2, lambda t, x, p: (F.signum(x[0]) == F.signum(x[1])).cast("double"))
_op("s3.dir_consistency_asym", 2, c.sub)
_op("s3.refill_vs_pull_ratio", 2, lambda t, x, p: quiet_ratio(x[0], F.abs(x[1]), 1.0))
_op("s3.qp_depth_coherence", 4, _all_agree)
_op("s3.qp_depth_slope", 4, c.slope([1, 2, 5, 10]))
_op("s3.qp_depth_curvature", 4, c.curvature)
_op("s3.vacuum_score", 2, c.sub)
