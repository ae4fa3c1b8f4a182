"""Null-safe arithmetic and row windows. Missing values are NULL throughout; NaN is turned to NULL at the scan."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every float column: Spark sorts NaN last and adds it up."""
    kinds = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in kinds else F.col(c) for c in df.columns))


def correlation(x: Column, y: Column, frame=None) -> Column:
    """Pearson's r over the rows where both are there, NULL without variance (``corr`` divides by zero there)."""
    at = (lambda a: a) if frame is None else (lambda a: a.over(frame))
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    return F.try_divide(at(F.covar_pop(u, v)), at(F.stddev_pop(u)) * at(F.stddev_pop(v)))


def clip(x: Column, lo: float, hi: float) -> Column:
    """greatest() and least() skip NULL, so that it has to be kept apart."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def big(x: Column, eps: float = EPS) -> Column:
    """|x| > eps; a NULL isn't."""
    return F.coalesce(F.abs(x) > eps, F.lit(False))


def over(a: Column, b: Column, eps: float = EPS) -> Column:
    """a / b, NULL where b is about 0."""
    return F.when(F.abs(b) > eps, a / b)


def over_eps(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.try_divide(a, b + eps)


def quiet_ratio(num: Column, den: Column, quiet: float, most: float = 1e6) -> Column:
    """num / den; ``quiet`` where neither is more than about 0 (a NULL counts so); NULL where only den isn't."""
    return F.when(~big(den) & ~big(num), F.lit(quiet)).when(big(den), clip(num / den, 0, most))


def flag(condition: Column) -> Column:
    """1 or 0; a comparison with NULL is 0."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def bps(x: Column, ref: Column, most: float = 1e5) -> Column:
    return clip(over_eps(x, ref) * 1e4, -most, most)


class Tape:
    """Windows over one ordered series per key, and columns held between window levels.

    A window function can't stand in another's argument, so a builder hands the
    inner one to ``hold`` at a level and gets a column to use at the next. Equal
    expressions held by different features are computed once.
    """

    def __init__(self, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order
        self.levels: dict[int, dict[str, Column]] = {}
        self.known: dict[str, str] = {}
        self.reach: dict[str, tuple[int, int] | None] = {}

    @property
    def series(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, first: int, last: int):
        return self.series.rowsBetween(first, last)

    def trail(self, w: int):
        return self.rows(-(w - 1), 0)

    def so_far(self):
        return self.rows(Window.unboundedPreceding, 0)

    def hold(self, x: Column, level: int) -> Column:
        text = f"{level}:{x}"
        if text not in self.known:
            self.known[text] = f"_held{len(self.known)}"
            self.levels.setdefault(level, {})[self.known[text]] = x
            self.reach[self.known[text]] = self.span(x)
        return F.col(self.known[text])

    def span(self, x: Column) -> tuple[int, int] | None:
        """Rows back and ahead that ``x`` depends on, held columns included; None for the whole series.

        Read from the expression's text: windows aren't nested in one expression,
        so its own frames add to the longest reach of the columns it holds.
        """
        text = str(x)
        if "UNBOUNDED" in text or "row_number()" in text:
            return None
        back = ahead = 0
        for a, b in re.findall(r"ROWS BETWEEN (-?\d+|CURRENT ROW) AND (-?\d+|CURRENT ROW)", text):
            back, ahead = (max(back, -int(a)) if a[0] != "C" else back), (max(ahead, int(b)) if b[0] != "C" else ahead)
        moves = re.findall(r", (\d+), NULL, false\) OVER", text) if "lag(" in text or "lead(" in text else []
        far = max([0, *map(int, moves)])
        back, ahead = max(back, far if "lag(" in text else 0), max(ahead, far if "lead(" in text else 0)
        held = [self.reach[h] for h in set(re.findall(r"\b_held\d+\b", text))]
        if None in held:
            return None
        return back + max([0, *(h[0] for h in held)]), ahead + max([0, *(h[1] for h in held)])

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.series)

    def lead(self, x: Column, n: int) -> Column:
        return F.lead(x, n).over(self.series)

    def filled(self, w: int) -> Column:
        """Whether the series has at least w rows up to here."""
        return F.count(F.lit(1)).over(self.trail(w)) >= w

    def roll(self, fn: Callable[[Column], Column], x: Column, w: int, least: int | None = None) -> Column:
        """fn over the last w rows, NULL with fewer than ``least`` (default w) values."""
        frame = self.trail(w)
        return F.when(F.count(x).over(frame) >= (w if least is None else least), fn(x).over(frame))

    def mean(self, x: Column, w: int, least: int | None = None) -> Column:
        return self.roll(F.avg, x, w, least)

    def median(self, x: Column, w: int, least: int | None = None) -> Column:
        return self.roll(lambda c: F.percentile(c, F.lit(0.5)), x, w, least)

    def smooth(self, x: Column, w: int, level: int) -> Column:
        """Rolling mean of what there is, if w > 1."""
        return self.mean(self.hold(x, level), w, 1) if w and w > 1 else x

    def middle(self, x: Column, w: int, least: int | None, level: int) -> tuple[Column, Column]:
        """Rolling median, and the rolling median of distances from each row's own median."""
        if w:
            med = self.hold(self.median(x, w, least), level)
            dev = self.hold(F.abs(x - med), level + 1)
            return med, self.hold(self.median(dev, w, least), level + 2)
        mid = lambda c: F.percentile(c, F.lit(0.5)).over(self.so_far())
        med = self.hold(mid(x), level)
        dev = self.hold(F.abs(x - med), level + 1)
        return med, self.hold(mid(dev), level + 2)

    def decayed(self, x: Column, r: float, place: Column, level: int) -> Column:
        """Sum of x * r**(steps back) over the rows so far, where ``place`` numbers the rows that count from 0.

        Blocks of places are summed apart with weights that stay within range;
        r**block is below 1e-26, so that a block needs the sum of the one before
        it and nothing older. No row loop, no state per key. x must be NULL in
        rows that don't count; the result is NULL there.
        """
        import math

        size = max(1, math.ceil(60 / -math.log(r)))
        block = self.hold(F.when(x.isNotNull(), F.floor(place / size)), level)
        k = place - block * size
        grown = self.hold(x * F.pow(F.lit(r), -k), level + 1)
        inside = Window.partitionBy(*self.keys, block).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        local = self.hold(F.when(x.isNotNull(), F.sum(grown).over(inside) * F.pow(F.lit(r), k)), level + 2)
        end = F.when(k == size - 1, local)
        before = self.hold(F.coalesce(F.last(end, ignorenulls=True).over(self.rows(Window.unboundedPreceding, -1)), F.lit(0.0)), level + 3)
        return F.when(x.isNotNull(), local + before * F.pow(F.lit(r), k + 1))
