"""S0 order-book operators over level arrays (bids descending, asks ascending), with higher-order functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import EPS


def mid(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask > 0), (bid + ask) / 2)


def spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def _levels(px: Column, qty: Column, m: Column, bid: bool) -> Column:
    """Structs of distance in bps, price, quantity and place; NULL without a mid, pairs cut to the shorter array."""
    n = F.least(F.size(px), F.size(qty))
    both = F.arrays_zip(F.slice(px, 1, n), F.slice(qty, 1, n))
    names = ("0", "1")

    def level(v, i):
        p, q = v[names[0]], v[names[1]]
        d = ((m - p) if bid else (p - m)) / m * 1e4
        return F.struct(d.alias("d"), p.alias("p"), q.alias("q"), i.alias("i"))

    return F.when((m > 0) & (n >= 0), F.transform(both, level))


def max_bps_side(px: Column, m: Column, bid: bool) -> Column:
    """Distance of the outermost level."""
    last = F.try_element_at(px, F.lit(-1))
    return F.when(m > 0, ((m - last) if bid else (last - m)) / m * 1e4)


def bps_sym(bids: Column, asks: Column, m: Column) -> Column:
    b, a = max_bps_side(bids, m, True), max_bps_side(asks, m, False)
    return F.when(b.isNotNull() & a.isNotNull(), F.least(b, a))


def _within(px, qty, m, bid, lo, hi) -> Column:
    return F.filter(_levels(px, qty, m, bid), lambda v: (v["d"] >= lo) & (v["d"] <= hi))


def _total(levels: Column, value) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda a, v: a + value(v))


def _notional(inside: Column) -> Column:
    return _total(inside, lambda v: v["p"] * v["q"])


def _weighted_price(inside: Column) -> Column:
    q = _total(inside, lambda v: v["q"])
    return F.when(q > 0, _notional(inside) / q)


def _largest(inside: Column) -> Column:
    ranked = F.transform(inside, lambda v: F.struct((v["p"] * v["q"]).alias("n"), (-v["i"]).alias("i"), v["d"].alias("d")))
    return F.array_max(ranked)["d"]


def notional_within(px: Column, qty: Column, m: Column, bid: bool, lo, hi) -> Column:
    """Sum of price * quantity of levels lo <= distance <= hi; an empty window is 0."""
    return _notional(_within(px, qty, m, bid, lo, hi))


def notional_filled(*args) -> Column:
    """As stored on the grid: 0 also without a book or a mid."""
    return F.coalesce(notional_within(*args), F.lit(0.0))


def imbalance(b: Column, a: Column) -> Column:
    return F.when(b + a > 0, (b - a) / (b + a + EPS))


def lwp(px: Column, qty: Column, m: Column, bid: bool, lo, hi) -> Column:
    """Quantity-weighted price of the window, NULL without quantity."""
    return _weighted_price(_within(px, qty, m, bid, lo, hi))


def lwp_mid(b: Column, a: Column) -> Column:
    return (b + a) / 2


def max_liq_distance(px: Column, qty: Column, m: Column, bid: bool, lo, hi) -> Column:
    """Distance of the level with the largest notional; the first of equals."""
    return _largest(_within(px, qty, m, bid, lo, hi))


def _up_to(hi: Column):
    return lambda v: (v["d"] >= 0) & (v["d"] <= hi)


def with_book_features(df: DataFrame, fixed: tuple[float, ...], alphas: tuple[float, ...]) -> DataFrame:
    """``df`` (bids_px, bids_qty, asks_px, asks_qty) with every book operator.

    Levels and the levels of each window are columns of their own until the end:
    each is worked out once a row, whatever is taken from it.
    """
    sides = {"bid": (F.col("bids_px"), F.col("bids_qty"), True), "ask": (F.col("asks_px"), F.col("asks_qty"), False)}
    df = df.withColumns({f"best_{s}": F.try_element_at(px, F.lit(1)) for s, (px, _, _) in sides.items()})
    df = df.withColumns({"mid": mid(F.col("best_bid"), F.col("best_ask")), "spread": spread(F.col("best_bid"), F.col("best_ask"))})
    m = F.col("mid")
    df = df.withColumns({f"max_bps_{s}": max_bps_side(px, m, is_bid) for s, (px, _, is_bid) in sides.items()})
    b, a = F.col("max_bps_bid"), F.col("max_bps_ask")
    df = df.withColumns({"bps_sym": F.when(b.isNotNull() & a.isNotNull(), F.least(b, a)), **{f"_all_{s}": _levels(px, qty, m, is_bid) for s, (px, qty, is_bid) in sides.items()}})
    windows = [(f"{x:g}bps", F.lit(float(x))) for x in fixed] + [(f"alpha{x:g}".replace(".", "_"), F.col("bps_sym") * x) for x in alphas]
    cut, made, held = {}, {}, ["_all_bid", "_all_ask"]
    for tag, hi in windows:
        for s in sides:
            cut[f"_in_{s}_{tag}"] = F.filter(F.col(f"_all_{s}"), _up_to(hi))
            inside = F.col(f"_in_{s}_{tag}")
            made |= {f"_n_{s}_{tag}": _notional(inside), f"lwp_{s}_{tag}": _weighted_price(inside), f"max_liq_{s}_{tag}": _largest(inside)}
    df = df.withColumns(cut).withColumns(made)
    last = {}
    for tag, _ in windows:
        n = {s: F.col(f"_n_{s}_{tag}") for s in sides}
        last |= {f"notional_{s}_{tag}": F.coalesce(x, F.lit(0.0)) for s, x in n.items()}
        last |= {f"imbalance_{tag}": imbalance(n["bid"], n["ask"]), f"lwp_mid_{tag}": lwp_mid(F.col(f"lwp_bid_{tag}"), F.col(f"lwp_ask_{tag}"))}
        held += [f"_n_{s}_{tag}" for s in sides]
    return df.withColumns(last).drop(*held, *cut)
