"""Context: source health, usability, calendar; all window and group operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: US market holidays 2025 to 2027 (fixed values).
US_HOLIDAYS = (
    "2025-01-01 2025-01-20 2025-02-17 2025-04-18 2025-05-26 2025-06-19 2025-07-04 2025-09-01 2025-11-27 2025-12-25 "
    "2026-01-01 2026-01-19 2026-02-16 2026-04-03 2026-05-25 2026-06-19 2026-07-03 2026-09-07 2026-11-26 2026-12-25 "
    "2027-01-01 2027-01-18 2027-02-15 2027-03-26 2027-05-31 2027-06-18 2027-07-05 2027-09-06 2027-11-25 2027-12-24"
).split()


def _on(x: Column) -> Column:
    return x.cast("tinyint")


def calendar(ts: Column) -> dict[str, Column]:
    """Sessions by UTC hour, holidays and regular trading hours (14:30 to 21:00, Monday to Friday)."""
    h, minute = F.hour(ts), F.hour(ts) * 60 + F.minute(ts)
    sydney, tokyo = (h >= 22) | (h < 7), h < 9
    london, newyork = (h >= 8) & (h < 16), (h >= 13) & (h < 21)
    holiday = F.date_format(ts, "yyyy-MM-dd").isin(US_HOLIDAYS)
    rth = (minute >= 870) & (minute < 1260) & (F.weekday(ts) < 5) & ~holiday
    return {
        "session_sydney": _on(sydney),
        "session_tokyo": _on(tokyo),
        "session_asia": _on(sydney | tokyo),
        "session_london": _on(london),
        "session_newyork": _on(newyork),
        "session_overlap_flag": _on(london & newyork),
        "us_holiday": _on(holiday),
        "us_rth": _on(rth),
    }


def source_health(rows: DataFrame, keys: list[str], seconds: int, allowed: int) -> DataFrame:
    """Per source and bucket of ``seconds``: row checks, then the gap to the bucket before.

    ``rows`` has keys, ts (timestamp), reconnect (0/1) and crossed (boolean). A
    bucket is healthy if it has rows, valid times, no reconnect, no gap over
    ``allowed`` seconds and no crossed book.
    """
    at = F.floor(F.unix_timestamp("ts") / seconds) * seconds
    g = rows.withColumn("bucket", at).groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.min(F.unix_timestamp("ts")) >= 946684800).alias("has_valid_ts"),
        (F.coalesce(F.max("reconnect"), F.lit(0)) == 0).alias("no_reconnect"),
        (~F.coalesce(F.max("crossed"), F.lit(False))).alias("no_crossed"),
    )
    before = F.lag("bucket").over(Window.partitionBy(*keys).orderBy("bucket"))
    g = g.withColumn("no_gap", F.coalesce(F.col("bucket") - before <= allowed, F.lit(True)))
    return g.withColumn("healthy", F.col("has_valid_ts") & F.col("no_reconnect") & F.col("no_gap") & F.col("no_crossed"))


def aggregate_health(sources: DataFrame, axis: DataFrame, source_keys: list[str]) -> DataFrame:
    """All sources on the bucket axis: failures, bit mask and reason code.

    A source without rows in a bucket is missing and is accused of nothing else.
    The mask adds 1 missing, 2 invalid time, 4 reconnect, 8 gap, 16 crossed; the
    reason is the first of them that fails (1 to 5), 9 if only health is
    missing, 0 if all is well.
    """
    combos = sources.select(*source_keys).distinct()
    full = axis.join(F.broadcast(combos), how="cross").join(sources, [*source_keys, "bucket"], "left")
    has = F.col("n_rows").isNotNull()
    bad = {
        "missing": ~has,
        "invalid_ts": has & ~F.col("has_valid_ts"),
        "reconnect": has & ~F.col("no_reconnect"),
        "gap": has & ~F.col("no_gap"),
        "crossed": has & ~F.col("no_crossed"),
    }
    sums = [F.sum(c.cast("int")).cast("int").alias(f"{n}_combos") for n, c in bad.items()]
    out = full.groupBy("bucket").agg(
        F.count(F.lit(1)).cast("int").alias("total_combos"),
        F.sum((~F.coalesce("healthy", F.lit(False))).cast("int")).cast("int").alias("bad_combos"),
        *sums,
    )
    mask, reason = F.lit(0), F.when(F.lit(False), 0)
    for i, n in enumerate(bad):
        mask = mask + F.when(F.col(f"{n}_combos") > 0, 1 << i).otherwise(0)
        reason = reason.when(F.col(f"{n}_combos") > 0, i + 1)
    reason = reason.when(F.col("bad_combos") > 0, 9).otherwise(0)
    return out.withColumns({"bad_bitmask": mask, "reason_code": reason, "health_flag": (F.col("bad_combos") == 0).cast("int")})


def soft_health(health: Column, missing: Column, other_failures: Column, budget: int = 1) -> Column:
    """Healthy, or at most ``budget`` sources missing and nothing else wrong."""
    return F.when(health == 1, 1).when((missing <= budget) & (other_failures == 0), 1).otherwise(0)


def usability(df: DataFrame, keys: list[str], order: str, health: str, window: int = 60, share: float = 0.95, streak: int = 5) -> DataFrame:
    """Usable rows: enough healthy rows in the trailing window and no long bad streak in it.

    A streak counts whole, also the part before the window. While the window
    fills, rows are unusable. Reasons: 4 warm-up, 1 unhealthy now, 3 streak, 2 ratio, 0 usable.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    trail = w.rowsBetween(-(window - 1), 0)
    bad = F.when(F.col(health) == 1, 0).otherwise(1)
    df = df.withColumn("_bad", bad).withColumn("_run", F.sum(1 - F.col("_bad")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_streak", F.sum("_bad").over(in_run))
    df = df.withColumns(
        {
            "usability_bad_count_win": F.sum("_bad").over(trail),
            "usability_max_bad_streak_win": F.max("_streak").over(trail),
            "usability_warmup_flag": (F.row_number().over(w) < window).cast("int"),
        }
    )
    ratio = F.col("usability_bad_count_win") / F.lit(float(window))
    df = df.withColumn("usability_bad_ratio_win", ratio)
    warm, long = F.col("usability_warmup_flag") == 1, F.col("usability_max_bad_streak_win") > streak
    few = 1 - F.col("usability_bad_ratio_win") < share
    reason = F.when(warm, 4).when(F.col("_bad") == 1, 1).when(long, 3).when(few, 2).otherwise(0)
    usable = (~warm & ~long & ~few).cast("int")
    return df.withColumns({"unusable_reason_code": reason, "data_usability_flag": usable}).drop("_bad", "_run", "_streak")


def islands(df: DataFrame, keys: list[str], at: str, step: int) -> DataFrame:
    """Continuous runs: rows whose distance to the one before is at most ``step``."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= step, 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run_id").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))


def segments(rows: DataFrame, keys: list[str], seconds: int = 120, least: int = 50) -> DataFrame:
    """Tumbling segments anchored at the first time; issues as an array (rows: ts, value, type)."""
    first = F.min(F.unix_timestamp("ts")).over(Window.partitionBy(*keys))
    s = rows.withColumn("_t", F.unix_timestamp("ts")).withColumn("segment", F.floor((F.col("_t") - first) / seconds))
    gap = F.col("_t") - F.lag("_t").over(Window.partitionBy(*keys, "segment").orderBy("_t"))
    s = s.withColumn("_gap", gap).groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("_gap").alias("max_gap"),
        F.sum((F.col("event_type") == "error").cast("int")).alias("n_errors"),
        F.percentile("value", F.lit(0.5)).alias("value_p50"),
        F.percentile("value", F.lit(0.99)).alias("value_p99"),
    )
    issue = lambda c, name: F.when(c, F.lit(name))
    issues = F.array_compact(F.array(issue(F.col("max_gap") > 3 * seconds / 10, "gap"), issue(F.col("n_errors") > 0, "reconnect"), issue(F.col("value_p99") > 4 * F.col("value_p50"), "tail")))
    return s.where(F.col("n_rows") >= least).withColumn("issues", F.array_join(issues, ","))
