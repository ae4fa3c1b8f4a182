"""Builders that several stages share, with what differs as arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.num import Tape, clip, flag, over, over_eps

MAD_SCALE = 1.4826


def sub(t: Tape, x: list[Column], p: dict) -> Column:
    return x[0] - x[1]


def add(t: Tape, x: list[Column], p: dict) -> Column:
    return x[0] + x[1]


def product(t: Tape, x: list[Column], p: dict) -> Column:
    return x[0] * x[1]


def half_sum(t: Tape, x: list[Column], p: dict) -> Column:
    return (x[0] + x[1]) / 2


def same(t: Tape, x: list[Column], p: dict) -> Column:
    return x[0]


def guarded(t: Tape, x: list[Column], p: dict) -> Column:
    return over(x[0], x[1])


def asymmetry(t: Tape, x: list[Column], p: dict) -> Column:
    return over_eps(x[0] - x[1], x[0] + x[1])


def share(t: Tape, x: list[Column], p: dict) -> Column:
    return over_eps(x[0], x[0] + x[1])


def change(t: Tape, x: list[Column], p: dict) -> Column:
    return x[0] - t.lag(x[0])


def second_change(fallback: bool):
    def build(t: Tape, x: list[Column], p: dict) -> Column:
        named = [c for c, n in zip(x, p["names"], strict=True) if n.startswith("d1_")]
        if not named and not fallback:
            raise ValueError("second difference needs an input named d1_*")
        base = named[0] if named else x[0]
        return base - t.lag(base)

    return build


def width(p: dict) -> int:
    return int(p.get("window_s", 0))


def least(p: dict, default: int) -> int:
    return int(p.get("min_periods", default))


def mean_of(x: list[Column]) -> Column:
    """Mean of the inputs that aren't NULL in a row."""
    if len(x) == 1:
        return x[0]
    n = sum((c.isNotNull().cast("int") for c in x[1:]), x[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in x[1:]), F.coalesce(x[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def roll_mean(default=lambda w: w):
    def build(t: Tape, x: list[Column], p: dict) -> Column:
        w = width(p)
        return t.mean(t.hold(mean_of(x), 0), w, least(p, default(w)))

    return build


def roll_sum(default=lambda w: w):
    def build(t: Tape, x: list[Column], p: dict) -> Column:
        w = width(p)
        return t.roll(F.sum, x[0], w, least(p, default(w)))

    return build


def roll_median(default=lambda w: w):
    def build(t: Tape, x: list[Column], p: dict) -> Column:
        w = width(p)
        return t.median(x[0], w, least(p, default(w)))

    return build


def roll_mad_given(default):
    """Rolling median of the distance between the series and a given median column."""

    def build(t: Tape, x: list[Column], p: dict) -> Column:
        w = width(p)
        med = [c for c, n in zip(x, p["names"], strict=True) if n.startswith("median_")]
        base = [c for c, n in zip(x, p["names"], strict=True) if not n.startswith("median_")]
        dev = t.hold(F.abs((base or x)[0] - (med or x[1:])[0]), 0)
        return t.median(dev, w, least(p, default(w)))

    return build


def zscore(bound: float | None, default=lambda w: w, eps: float | None = None):
    """Two-pass robust z-score. With eps it is added to the scale, else a scale of 0 gives NULL."""

    def build(t: Tape, x: list[Column], p: dict) -> Column:
        w = width(p)
        raw = [c for c, n in zip(x, p["names"], strict=True) if not n.startswith(("median_", "mad_"))] or x[:1]
        col = t.hold(mean_of(raw), 0)
        med, mad = t.middle(col, w, least(p, default(w)), 1)
        scale = MAD_SCALE * mad
        z = F.try_divide(col - med, scale + eps) if eps is not None else F.when(scale > 0, (col - med) / scale)
        most = p.get("zscore_clip", bound)
        return z if most is None else clip(z, -float(most), float(most))

    return build


def shock(scale: float, signed: bool, low: float, high: float):
    """Distance from a given median in units of a given MAD; roles go by name, then by place."""

    def build(t: Tape, x: list[Column], p: dict) -> Column:
        named = dict(zip(p["names"], x, strict=True))
        med = next((c for n, c in named.items() if n.startswith("median_")), x[1])
        mad = next((c for n, c in named.items() if n.startswith("mad_")), x[2])
        raw = next((c for n, c in named.items() if not n.startswith(("median_", "mad_"))), x[0])
        d = raw - med if signed else F.abs(raw - med)
        return clip(F.when(mad > 0, d / (float(p.get("scale", scale)) * mad)), low, high)

    return build


def agreement(t: Tape, x: Column, first_null: bool = False) -> Column:
    """1 where a row's sign is that of the row before; a NULL on either side is 0."""
    got = flag(F.signum(x) == F.signum(t.lag(x)))
    return F.when(t.lag(F.lit(1)).isNotNull(), got) if first_null else got


def persist(default: int | None = None):
    def build(t: Tape, x: list[Column], p: dict) -> Column:
        w = int(p.get("window_s", default or 0))
        return t.mean(t.hold(agreement(t, x[0]), 0), w)

    return build


def flip_rate(t: Tape, x: list[Column], p: dict) -> Column:
    w = width(p)
    return t.roll(F.sum, t.hold(1 - agreement(t, x[0]), 0), w) / w


def curvature(t: Tape, x: list[Column], p: dict) -> Column:
    first = x[2] - 2 * x[1] + x[0]
    return (first + x[3] - 2 * x[2] + x[1]) / 2 if len(x) > 3 else first


def slope(at: list[float]):
    """Least-squares slope over the bands; NULL if a band is."""

    def build(t: Tape, x: list[Column], p: dict) -> Column:
        places = [float(a) for a in p.get("bands", at)][: len(x)]
        mid = sum(places) / len(places)
        below = sum((a - mid) ** 2 for a in places)
        return sum((c * ((a - mid) / below) for c, a in zip(x[1:], places[1:], strict=True)), x[0] * ((places[0] - mid) / below))

    return build


def moment_z(t: Tape, x: Column, w: int, bound: float) -> Column:
    """Plain z-score over the window, NULL where the deviation is about 0."""
    return clip(over(x - t.mean(x, w), t.roll(F.stddev_samp, x, w)), -bound, bound)


def rank_share(values: Column, x: Column, n: Column) -> Column:
    """Average-rank percentile of x among the values of an array."""
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return F.try_divide(below + (equal + 1) / 2, n)
