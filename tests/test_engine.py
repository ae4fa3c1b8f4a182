"""Specs and the rules for missing values, zeros and ties, on frames written by hand."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import operators  # noqa: F401
from tickloom.functions.num import no_nan
from tickloom.operators import book, context, evaluate, levels, selection, walk
from tickloom.plans.spec import OPERATORS, Chunks, Feature, SpecError, closure, compute, validate
from tickloom.plans.spec import levels as depth


def run(spark, features, **cols):
    n = len(next(iter(cols.values())))
    rows = [(0, i, *(None if v is None else float(v) for v in vals)) for i, vals in enumerate(zip(*cols.values(), strict=True))]
    df = spark.createDataFrame(rows, "k int, t int, " + ", ".join(f"{c} double" for c in cols))
    out = compute(df, features, ["k"], ["t"]).orderBy("t").collect()
    assert len(out) == n
    return {f.name: [r[f.name] for r in out] for f in features}


def one(spark, stage, op, deps, params=None, **cols):
    return run(spark, [Feature("y", stage, op, tuple(deps), params or {})], **cols)["y"]


def test_registry():
    sizes = {}
    for stage, _ in OPERATORS:
        sizes[stage] = sizes.get(stage, 0) + 1
    assert sizes == {"S1": 65, "S2": 51, "S3": 28, "S4": 18, "S5": 5, "S6": 10}


def test_validation():
    f = lambda *a, **k: Feature(*a, **k)
    for bad in (
        [f("a", "S1", "no.such", ("x",))],
        [f("a", "S1", "derived.add", ("x",))],
        [f("a", "S1", "derived.roll_mean", ("x",))],
        [f("a", "S1", "derived.add", ("x", "z"))],
        [f("x", "S1", "derived.add", ("x", "x"))],
        [f("a", "S1", "derived.add", ("ret_fwd_1s", "x"))],
    ):
        with pytest.raises(SpecError):
            validate(bad, ["x", "ret_fwd_1s"])
    loop = [f("a", "S1", "derived.add", ("b", "x")), f("b", "S1", "derived.add", ("a", "x"))]
    with pytest.raises(SpecError):
        depth(loop)
    chain = [f("a", "S1", "derived.add", ("x", "x")), f("b", "S1", "derived.add", ("a", "x")), f("c", "S1", "derived.add", ("x", "x"))]
    assert [x.name for x in closure(chain, ["b"])] == ["a", "b"]
    assert [[x.name for x in level] for level in depth(chain)] == [["a", "c"], ["b"]]


def test_flags_treat_null_as_false(spark):
    assert one(spark, "S1", "derived.above_level", ["p", "l"], p=[1, None, 3], l=[0, 1, None]) == [1, 0, 0]
    assert one(spark, "S1", "derived.price_vs_va", ["p", "h", "l"], p=[5, 1, 2, None], h=[4] * 4, l=[1.5] * 4) == [2, 0, 1, 1]
    assert one(spark, "S1", "derived.trend_align", ["p", "s", "l"], p=[3, 1, None], s=[2, 2, 2], l=[1, 3, 1]) == [1, -1, 0]


def test_zero_denominators(spark):
    assert one(spark, "S1", "derived.ratio", ["a", "b"], a=[1, 1], b=[0, 2]) == [None, 0.5]
    assert one(spark, "S1", "derived.count_ratio", ["a", "b"], a=[0, 2, None, 3], b=[0, 0, 1, 1]) == [0, None, 0, 3]
    assert one(spark, "S2", "l2.churn_ask", ["a", "c", "d"], a=[0, 1, None, 2], c=[0, 1, None, 2], d=[0, 0, None, 2]) == [0, None, 0, 2]
    assert one(spark, "S3", "s3.refill_vs_pull_ratio", ["a", "b"], a=[0, 1, None, 4], b=[0, 0, None, -2]) == [1, None, 1, 2]
    assert one(spark, "S4", "derived.ratio", ["a", "b"], a=[1, 1], b=[1e-7, 2]) == pytest.approx([None, 0.5])


def test_rolling_gates(spark):
    x = [1, None, 3, 4, 5]
    assert one(spark, "S1", "derived.roll_sum", ["x"], {"window_s": 2}, x=x) == [None, None, None, 7, 9]
    assert one(spark, "S4", "derived.roll_sum", ["x"], {"window_s": 2}, x=x) == [1, 1, 3, 7, 9]
    assert one(spark, "S2", "derived.roll_mean", ["x"], {"window_s": 2, "min_periods": 1}, x=x) == [1, 1, 3, 3.5, 4.5]


def test_robust_z(spark):
    flat = [2.0] * 6
    assert one(spark, "S2", "derived.robust_zscore", ["x"], {"window_s": 2}, x=flat) == [None] * 6
    assert one(spark, "S1", "derived.robust_zscore", ["x"], {"window_s": 2}, x=flat) == [None, None, 0, 0, 0, 0]
    x = pd.Series([1.0, 5, 2, 8, 3, 9, 4, 7, 6, 2])
    med = x.rolling(3).median()
    z = (x - med) / (1.4826 * (x - med).abs().rolling(3).median())
    got = one(spark, "S2", "derived.robust_zscore", ["x"], {"window_s": 3}, x=list(x))
    want = [None if math.isnan(v) else min(20, max(-20, v)) for v in z.where((x - med).abs().rolling(3).median() > 0)]
    assert got == pytest.approx(want)


def test_signs(spark):
    x = [1, 2, None, 3, -1]
    assert one(spark, "S3", "derived.signal_persist", ["x"], {"window_s": 1}, x=x) == [0, 1, 0, 0, 0]
    assert one(spark, "S3", "derived.signal_flip_rate", ["x"], {"window_s": 1}, x=x) == [1, 0, 1, 1, 1]
    assert one(spark, "S2", "derived.dir_consistency", ["x"], {"window_s": 1}, x=x) == [None, 1, 0, 0, 0]


def test_ranks(spark):
    assert one(spark, "S4", "derived.pct_rank", ["x"], {"window_s": 3, "min_periods": 2}, x=[1, 1, 2, None, 0]) == pytest.approx([None, 0.75, 1.0, None, 0.5])


def test_forward(spark):
    assert one(spark, "S1", "derived.mfe_fwd", ["x"], {"window_s": 2}, x=[100, 101, 99]) == pytest.approx([100, 0, 0])
    rv = one(spark, "S1", "derived.rv_fwd", ["x"], {"window_s": 2}, x=[100, 101, 99])
    assert rv[0] == pytest.approx(math.sqrt(math.log(1.01) ** 2 + math.log(99 / 101) ** 2)) and rv[1:] == [None, None]


@pytest.mark.parametrize("span", [1, 3, 40])
def test_ema_over_many_blocks(spark, span):
    x = [None if i % 13 == 5 else float((i * 37) % 101) for i in range(600)]
    y, want = None, []
    for v in x:
        if v is not None:
            y = v if y is None else 2 / (span + 1) * v + (1 - 2 / (span + 1)) * y
        want.append(y)
    assert one(spark, "S1", "derived.ema", ["x"], {"span_s": span}, x=x) == pytest.approx(want)


def test_ewm_mean(spark):
    x = [None if i % 7 == 3 else float((i * 31) % 17 + 1) for i in range(400)]
    s = pd.Series(x, dtype=float)
    want = (s / (s.ewm(halflife=5, min_periods=1).mean() + 1e-12)).tolist()
    got = one(spark, "S1", "derived.participation_rate_1s", ["x"], {"ewma_halflife_s": 5}, x=x)
    assert [g if g is not None else -1 for g in got] == pytest.approx([-1 if math.isnan(w) else w for w in want])


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert no_nan(df).agg(F.sum("x")).first()[0] == 1.0


def test_book(spark):
    rows = [([99.0, 98.0], [1.0, 2.0], [101.0, 102.0], [3.0, 1.0]), ([], [], [101.0], [1.0]), ([99.0, 98.0], [2.0], [101.0], [1.0])]
    df = spark.createDataFrame(rows, "bids_px array<double>, bids_qty array<double>, asks_px array<double>, asks_qty array<double>")
    a, b, c = book.with_book_features(df, (100.0, 1.0), (1.0,)).collect()
    assert (a["mid"], a["notional_bid_100bps"], a["notional_ask_100bps"]) == (100.0, 99.0, 303.0)  # a level at the bound counts
    assert a["notional_bid_1bps"] == 0 and a["lwp_bid_1bps"] is None
    assert a["max_liq_ask_alpha1"] == 100.0 and a["bps_sym"] == 200.0
    assert b["mid"] is None and b["notional_ask_100bps"] == 0 and b["imbalance_100bps"] is None
    assert c["notional_bid_alpha1"] == 198.0  # pairs end with the shorter array


def test_calendar_edges(spark):
    times = ["2026-01-05 14:29:59", "2026-01-05 14:30:00", "2026-01-05 20:59:59", "2026-01-05 21:00:00", "2026-01-01 15:00:00", "2026-01-03 15:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "s string").select(context.calendar(F.to_timestamp("s"))["us_rth"].alias("r"))
    assert [r["r"] for r in df.collect()] == [0, 1, 1, 0, 0, 0]


def test_usability_counts_whole_streaks(spark):
    health = [1] * 4 + [0] * 6 + [1] * 6
    df = spark.createDataFrame([(0, i, h) for i, h in enumerate(health)], "k int, t int, h int")
    got = context.usability(df, ["k"], "t", "h", window=4, share=0.0, streak=5).orderBy("t").collect()
    assert [r["usability_max_bad_streak_win"] for r in got][9:14] == [6, 6, 6, 6, 0]
    assert [r["unusable_reason_code"] for r in got] == [4, 4, 4, 0, 1, 1, 1, 1, 1, 1, 3, 3, 3, 0, 0, 0]


def profile(spark, rows):
    df = spark.createDataFrame([(0, 0, float(p), float(q)) for p, q in rows], "k int, t int, p double, q double")
    return levels.volume_profile(df, ["k"], "t", "p", "q", bins=10).first()


def test_volume_profile(spark):
    assert tuple(profile(spark, [(5, 1), (5, 2)]))[2:] == (5, 5, 5)
    assert tuple(profile(spark, [(5, 0)]))[2:] == (None, None, None)
    r = profile(spark, [(p + 0.5, 1) for p in range(10)] + [(0, 0), (10, 0)])
    assert (r["poc"], r["val"], r["vah"]) == (0.5, 0, 7)
    tie = profile(spark, [(0.5, 1), (4.5, 3), (5.5, 10), (6.5, 3), (0, 0), (10, 0)])
    assert (tie["val"], tie["vah"]) == (5, 7)


def test_exits(spark):
    df = spark.createDataFrame([([1.0, 5.0, -9.0],), ([-9.0, 9.0],), ([1.0],), ([],)], "p array<double>")
    p = F.col("p")
    got = [tuple(r) for r in df.select(evaluate.tp_sl(p, 5, 5, 3), evaluate.trailing(p, 2, 3)).collect()]
    assert got == [(5, -9.0), (-5, 9.0), (1, 1), (None, None)]
    both = spark.createDataFrame([([7.0],)], "p array<double>").select(evaluate.tp_sl(F.col("p"), 5, -6, 3)).first()[0]
    assert both == 5


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.02, 0.5])], "i int, p double")
    got = {r["i"]: r["q"] for r in evaluate.benjamini_hochberg(df, "p").collect()}
    assert got[3] is None
    assert [got[i] for i in (0, 4, 2, 1, 5)] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.5])


def test_greedy_drops():
    pairs = [("a", "b", 0.99), ("b", "c", 0.98), ("c", "d", 0.5)]
    assert selection.drop_by_order(pairs, {"a": 0, "b": 1, "c": 2, "d": 3}, 0.95) == ["b"]
    assert selection.drop_most_paired(pairs, 0.95) == ["b"]
    assert selection.base_concept("queue_pressure_5bps_fut_60s_a1") == "queue_pressure"
    assert selection.base_concept("x") == "x"


def test_empty_frames(spark):
    df = spark.createDataFrame([], "k int, t int, x double")
    f = [Feature("z", "S2", "derived.robust_zscore", ("x",), {"window_s": 3}), Feature("e", "S1", "derived.ema", ("x",), {"span_s": 3})]
    assert compute(df, f, ["k"], ["t"]).count() == 0


def test_feed_links(spark):
    from tickloom.sources import feeds

    rows = [(5, 8, None, 6), (7, 9, None, 6), (8, 9, None, 6), (7, 9, 5, 6), (9, 9, 6, 6)]
    df = spark.createDataFrame(rows, "a int, b int, p int, s int")
    cols = [F.col(c) for c in "abps"]
    got = df.select(feeds.links(*cols, False), feeds.links(*cols, True), feeds.follows(*cols, False), feeds.follows(*cols, True)).collect()
    assert [tuple(r) for r in got] == [(True, True, False, True), (True, False, True, True), (False, False, False, False), (False, False, True, True), (False, True, True, True)]


def test_scan_stands_schema_drift(spark, tmp_path):
    from tickloom.sources import feeds

    spark.range(2).selectExpr("id AS t", "1.5D AS px").write.parquet(str(tmp_path / "a"))
    spark.range(1).selectExpr("id AS t", "2 AS price", "'x' AS other").write.parquet(str(tmp_path / "b"))
    df = feeds.scan(spark, [str(tmp_path / "a"), str(tmp_path / "b")], {"t": "bigint", "price": "double", "qty": "double"}, {"px": "price"})
    assert sorted((r["t"], r["price"], r["qty"]) for r in df.collect()) == [(0, 1.5, None), (0, 2.0, None), (1, 1.5, None)]


def test_hour_range_and_sink(spark, tmp_path):
    from tickloom.sources import feeds

    rows = [("x", f"2024-01-01 {h:02d}:10:00") for h in (0, 1, 2)] + [("y", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "k string, s string").select("k", F.to_timestamp("s").alias("ts"))
    full = feeds.hour_range(df, "ts", "2024-01-01 00:00:00", "2024-01-01 02:00:00", ["k"], True)
    assert [(r["k"], r["ts"].hour) for r in full.orderBy("ts").collect()] == [("x", 0), ("x", 1)]
    feeds.routed(df, str(tmp_path / "out"), "ts", ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).where("k = 'x' AND hour = 2").count() == 1


def test_families(spark):
    from tickloom.operators import exits

    names = spark.createDataFrame([("queue_pressure_5bps",), ("queue_x",), ("other",)], "feature string")
    known = spark.createDataFrame([("queue", "A"), ("queue_pressure", "B")], "concept string, family string")
    assert {r["feature"]: r["family"] for r in exits.family(names, known).collect()} == {"queue_pressure_5bps": "B", "queue_x": "A", "other": None}


def test_as_of(spark):
    from tickloom.operators import joins

    df = spark.createDataFrame([(0, 1, 100.0), (0, 4, 110.0), (0, 6, 121.0), (0, 30, 1.0)], "k int, t long, p double")
    got = joins.backward_return_bps(df, ["k"], "t", "p", 2, 1).orderBy("t").collect()
    assert [r["back_bps"] for r in got] == pytest.approx([None, 1000.0, 1000.0, None])


def test_assembly_helpers(spark):
    from tickloom.operators import assemble

    families = {"ret": ("ret_fwd_{horizon}_{asset}", ("1s", "60s")), "mfe": ("mfe_fwd_{horizon}_bps_{asset}", ("60s",))}
    assert assemble.target_column("mfe_60s", "a0", families) == "mfe_fwd_60s_bps_a0" and assemble.target_column("1s", "a0", families) == "ret_fwd_1s_a0"
    for bad in ("mfe_1s", "x_60s", "5s"):
        with pytest.raises(ValueError):
            assemble.target_column(bad, "a0", families)
    assert [assemble.resolve_k(k, n) for k, n in ((8, 10_000), (8, 500), (8, 10))] == [8, 5, 2]
    d = spark.createDataFrame([("x", 1, None, 5), ("x", 2, 3, None), ("y", 1, None, None)], "k string, at int, a int, b int")
    assert sorted((r["k"], r["a"], r["b"]) for r in assemble.collapse(d, ["k"], F.col("at")).collect()) == [("x", 3, 5), ("y", None, None)]
    names = spark.createDataFrame([("logratio_2bps_5bps_fut_60s",)], "feature string")
    assert assemble.axes(names).first()[1:] == ("logratio", "2bps|5bps", "60s", "fut")
    first = assemble.merge_drops({"a": names, "b": names})
    assert first.collect() == assemble.merge_drops({"a": first.select("feature"), "b": names}).collect()


def test_correlation_without_variance(spark):
    from tickloom.functions.num import correlation

    d = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (1.0, None, 9.0)], "a double, b double, c double")
    assert d.select(correlation(F.col("a"), F.col("b")).alias("r")).first()["r"] is None
    assert abs(d.select(correlation(F.col("b"), F.col("c")).alias("r")).first()["r"] - 1) < 1e-12


def test_chunks_equal_the_whole_series(spark):
    """Windows back and ahead, nested medians, lags; keys and parts that are NULL; one key over several tasks."""
    rows = [(k, i, None if (i * 7) % 11 == 0 else float((i * 37) % 101)) for k in ("a", None) for i in range(300)]
    df = spark.createDataFrame([*rows, ("b", None, 1.0)], "k string, t int, x double")
    features = [
        Feature("mean", "S1", "derived.roll_mean", ("x",), {"window_s": 7}),
        Feature("z", "S2", "derived.robust_zscore", ("x",), {"window_s": 9, "min_periods": 3}),
        Feature("z2", "S2", "derived.robust_zscore", ("z",), {"window_s": 5, "min_periods": 2}),
        Feature("ahead", "S1", "derived.rv_fwd", ("t1",), {"window_s": 4}),
        Feature("back", "S1", "derived.poc_migration_bps", ("t1",), {"shift_s": 6}),
        Feature("t1", "S1", "derived.add", ("x", "x")),
    ]
    whole = compute(df, features, ["k"], ["t"])
    cut = compute(df, features, ["k"], ["t"], chunks=Chunks(F.floor(F.col("t") / 50), 25))
    assert cut.columns == whole.columns
    key = lambda r: (str(r.k), -1 if r.t is None else r.t)
    assert sorted(cut.collect(), key=key) == sorted(whole.collect(), key=key)
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = lambda d: len(d.where("k = 'a'").groupBy(F.spark_partition_id()).agg(F.sum("z2")).collect())
        assert tasks(whole) == 1 and tasks(cut) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)
    with pytest.raises(SpecError):
        compute(df, [Feature("e", "S1", "derived.ema", ("x",), {"span_s": 5})], ["k"], ["t"], chunks=Chunks(F.col("t"), 25))


def test_ridge_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (200, None, 1.0, 1.0, 0.0), (201, 1.0, 1.0, 1.0, None)], "i int, a double, b double, c double, y_true double")
    got = walk.cross_validate(df, ["i"], 3, lambda seed: walk.Ridge(["a", "b", "c"], penalty=0.1), seeds=(0, 1)).orderBy("event_index").toPandas()
    assert set(got.seed) == {0, 1} and got.event_index.min() == 50
    for fold in (1, 2, 3):
        tx, ty = x[: 50 * fold], y[: 50 * fold]
        w = np.linalg.solve((tx - tx.mean(0)).T @ (tx - tx.mean(0)) / len(tx) + 0.1 * np.eye(3), (tx - tx.mean(0)).T @ (ty - ty.mean()) / len(tx))
        part = got[(got.fold == fold) & (got.seed == 1) & (got.event_index < 200)]
        want = (x[part.event_index] - tx.mean(0)) @ w + ty.mean()
        assert np.allclose(part.y_pred, want)


def test_boosted_walk_learns_and_stands_nulls(spark):
    rows = [(i, None if i % 17 == 0 else float(i * 37 % 100), float(i * 53 % 10), float(i * 37 % 100 > 50)) for i in range(240)]
    df = spark.createDataFrame(rows, "i int, a double, b double, up double")
    got = walk.cross_validate(df, ["i"], 2, lambda seed: walk.Boosted(["a", "b"], "up", seed, rounds=5), target="up", keep=("a",)).where("a IS NOT NULL").toPandas()
    assert set(got.fold) == {1, 2} and ((got.y_pred > 0.5) == (got.up == 1)).mean() > 0.95


def test_leaving_a_path(spark):
    df = spark.createDataFrame([([1.0, 5.0, -9.0, 4.0], [0.0, 0.0, 0.9, 0.9]), ([1.0, 5.0, 3.0], [0.0, 0.6, 0.9]), ([1.0, 2.0], [0.0, 0.0]), ([], [])], "p array<double>, s array<double>")
    got = df.select(walk.leave_at(F.col("p"), F.col("s"), 0.5, F.lit(8.0)).alias("x"), walk.tp_sl_at(F.col("p"), F.lit(5.0), F.lit(1.0)).alias("y")).collect()
    assert [tuple(r) for r in got] == [(-8.0, 5.0), (5.0, 5.0), (2.0, 2.0), (None, None)]
    steps = spark.createDataFrame([([10.0, 20.0, 30.0, 29.0, 40.0],), ([1.0, 2.0],)], "p array<double>").select(walk.exit_steps(F.col("p"), F.array_max("p"), 10.0, ahead=1).alias("s")).collect()
    assert [tuple(x) for x in steps[0].s] == [(3, 30.0, 1), (4, 29.0, 0), (5, 40.0, 1)] and steps[1].s == []


def test_stability_over_seeds_and_rolling(spark):
    df = spark.createDataFrame([(i, float(i * 37 % 100)) for i in range(200)], "i int, x double")
    make = lambda seed: walk.Bins("x", [0.5] if seed < 2 else [0.3, 0.6])
    got = {(r.against, r.block, r.seed): r.ari for r in walk.stability(df, ["i"], 2, make, seeds=(0, 1, 2)).collect()}
    assert len(got) == 11 and got["seed", None, 1] == 1.0 and got["seed", None, 2] < 1 and got["whole", 0, 0] == 1.0
    rolled = walk.rolling_stability(df, ["i"], 4, 2, make).collect()
    assert [r.start for r in rolled] == [1, 2] and all(r.ari > 0.8 for r in rolled)


def test_vif_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    x[:, 2] += x[:, 0]
    got = selection.vif(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"])
    assert np.allclose([got[c] for c in "abc"], np.diag(np.linalg.inv(np.corrcoef(x.T))), rtol=1e-6)


def test_bca_against_a_plain_interval(spark):
    """The interval of a symmetric sample lies near mean +- 1.96 standard errors; of one value there is none."""
    import numpy as np

    v = np.random.default_rng(1).normal(size=400)
    df = spark.createDataFrame([("a", float(t)) for t in v] + [("b", 1.0)], "k string, x double")
    got = {r.k: r for r in evaluate.bca(df, ["k"], "x", rounds=2000).collect()}
    se = v.std() / 20
    assert abs(got["a"].lo - (v.mean() - 1.96 * se)) < 0.2 * se and abs(got["a"].hi - (v.mean() + 1.96 * se)) < 0.2 * se
    assert got["b"].n == 1 and (got["b"].lo is None or math.isnan(got["b"].lo))


def test_directions_without_predictions_and_shortlist(spark):
    events = spark.createDataFrame([(i, i % 2, 1.0) for i in range(10)], "event_index long, cluster int, direction double")
    none = spark.createDataFrame([], "event_index long, y_true double, y_pred double")
    assert walk.compare_directions(events, none).count() == 0
    some = spark.createDataFrame([(8, 1.0, None), (9, -1.0, -2.0), (1, 1.0, 1.0)], "event_index long, y_true double, y_pred double")
    assert [tuple(r) for r in walk.compare_directions(events, some).collect()] == [(None, 2, 0.5, 0.5, 0.0)]
    rows = spark.createDataFrame([(1.0, 0.6, 100), (0.9, 0.6, 100), (1.0, 0.55, 100), (1.0, 0.6, 99), (None, 0.6, 100)], "r double, da double, n int")
    assert walk.shortlist(rows, "r", "da", "n").count() == 1
