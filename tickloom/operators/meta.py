"""S4 and S5: shocks, ranks and persistence over the stages before."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from ..functions.num import EPS, clip, over_eps
from ..plans.spec import register
from . import common as c


def _quarter(w: int) -> int:
    return max(2, w // 4)


def _four(name, deps, build, window=False):
    register("S4", name, deps, build, window)


def _ratio(t, x, p):
    den = F.abs(x[1]) if p.get("abs_den", True) else x[1]
    return F.when(F.abs(x[1]) >= float(p.get("nan_thresh", 1e-6)), x[0] / (den + EPS))


def _pairs_agree(t, x, p):
    pairs = list(combinations(x, 2))
    hits = [((F.signum(a) == F.signum(b)) & (F.signum(a) != 0)).cast("double") for a, b in pairs]
    return sum(hits[1:], hits[0]) / len(pairs)


def _pct_rank(t, x, p):
    values = t.hold(F.collect_list(x[0]).over(t.trail(c.width(p))), 0)
    n = F.size(values)
    return F.when((n >= c.least(p, 5)) & x[0].isNotNull(), c.rank_share(values, x[0], n))


_four("derived.d1", 1, c.change)
_four("derived.d2", (1, 2), c.second_change(True))
_four("derived.rolling_median", 1, c.roll_median(_quarter), True)
_four("derived.rolling_mad", 2, c.roll_mad_given(_quarter), True)
_four("derived.robust_shock", (3, 3), c.shock(c.MAD_SCALE, False, -50, 50))
_four("derived.sub", 2, c.sub)
_four("derived.cross_market_div", 2, lambda t, x, p: over_eps(x[0], x[1]))
_four("derived.ratio", 2, _ratio)
_four("derived.depth_coherence", 4, _pairs_agree)
_four("derived.depth_slope", 4, c.slope([math.log(b) for b in (1, 2, 5, 10)]))
_four("derived.depth_curvature", 4, c.curvature)
_four("derived.signal_persist", 1, c.persist(), True)
_four("derived.signal_flip_rate", 1, c.flip_rate, True)
_four("derived.pct_rank", 1, _pct_rank, True)
_four("derived.robust_zscore", 1, c.zscore(20, lambda w: 5), True)
_four("derived.roll_sum", 1, c.roll_sum(lambda w: 1), True)
_four("derived.logratio", 1, lambda t, x, p: t.mean(x[0], int(p.get("window_s", 5)), 1))
_four("derived.passthrough", 1, c.same)


def _five(name, deps, build, window=False):
    register("S5", name, deps, build, window)


def _magnitude(t, x, p):
    w = c.width(p)
    n = c.least(p, w)
    return clip(F.abs(t.mean(x[0], w, n)) / (t.mean(F.abs(x[0]), w, n) + 1e-9), 0, 1)


_five("derived.rolling_median", 1, c.roll_median(_quarter), True)
_five("derived.rolling_mad", 2, c.roll_mad_given(_quarter), True)
_five("derived.robust_shock", 3, c.shock(1.0, False, 0, 50))
_five("derived.robust_zscore", 1, c.zscore(20, _quarter), True)
_five("derived.signal_persist", 1, _magnitude, True)
