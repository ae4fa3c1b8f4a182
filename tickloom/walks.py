"""Queries that walk models forward, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import BARS_SQL, bars
from .operators import walk
from .operators.evaluate import global_rank
from .studies import _EVENTS_SQL, _PRED_SQL, _events, _predictions, _r

K, PENALTY = 4, 1000.0


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).withColumnRenamed("y_pred", "move").where("y_true IS NOT NULL")
    return p.join(bars(spark, sf_dir).select("asset", "bucket", "gap", "volume"), ["asset", "bucket"])


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.cross_validate(_moves(spark, sf_dir), ["bucket", "asset"], K, lambda seed: walk.Ridge(["move", "gap"], penalty=PENALTY))


def out_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on yesterday's move and a price with holes, each fold's predictions of the block that follows."""
    return _r(_walked(spark, sf_dir), "event_index", "fold", "seed", digits=4)


_WALKED_SQL = f"""
WITH {_PRED_SQL}, d AS (SELECT asset, bucket, y_true AS y, y_pred AS a, gap AS b, volume FROM pred JOIN bars USING (asset, bucket) WHERE y_true IS NOT NULL),
n AS (SELECT *, row_number() OVER (ORDER BY bucket, asset) - 1 AS i, (SELECT count(*) FROM d) // {K + 1} AS size FROM d), f AS (SELECT *, i // size AS block FROM n WHERE i // size <= {K}),
k AS (SELECT unnest(range(1, {K + 1})) AS fold),
m AS (SELECT fold, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM f JOIN k ON block < fold GROUP BY fold),
dv AS (SELECT fold, y - my AS y, coalesce(a - ma, 0) AS a, coalesce(b - mb, 0) AS b FROM f JOIN m ON block < fold),
c AS (SELECT fold, avg(a * a) + {PENALTY} AS aa, avg(a * b) AS ab, avg(b * b) + {PENALTY} AS bb, avg(a * y) AS ay, avg(b * y) AS sy FROM dv GROUP BY fold),
w AS (SELECT fold, (bb * ay - ab * sy) / (aa * bb - ab * ab) AS wa, (aa * sy - ab * ay) / (aa * bb - ab * ab) AS wb FROM c)"""
_GUESS = "my + wa * coalesce(a - ma, 0) + wb * coalesce(b - mb, 0)"
OUT_OF_SAMPLE_SQL = f"""{_WALKED_SQL}
SELECT i AS event_index, CAST(fold AS INT) AS fold, 0 AS seed, round(y, 4) AS y_true, round({_GUESS}, 4) AS y_pred FROM f JOIN m ON block = fold JOIN w USING (fold)
"""


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridge's predictions against clusters by volume."""
    events = global_rank(_moves(spark, sf_dir), ["bucket", "asset"]).withColumnRenamed("rank", "event_index")
    events = events.select("event_index", F.floor(F.col("volume") / 100).cast("long").alias("cluster"), F.signum("y_true").alias("direction"))
    return _r(walk.compare_directions(events, _walked(spark, sf_dir)), "cluster", "n")


_SHARES = "round(avg((b = r)::INT), 6) AS model_da, round(avg((mj = r)::INT), 6) AS cluster_da, round(avg((mj = r)::INT) - avg((b = r)::INT), 6) AS gain"
DIRECTIONS_SQL = f"""{_WALKED_SQL},
ev AS (SELECT i, CAST(floor(volume / 100) AS BIGINT) AS cluster, sign(y) AS way, i < floor((SELECT count(*) FROM d) * CAST(0.6 AS DOUBLE)) AS tr FROM n),
mv AS (SELECT cluster, CASE WHEN avg(way) < 0 THEN -1 ELSE 1 END AS mj FROM ev WHERE tr GROUP BY cluster), os AS (SELECT i, y, {_GUESS} AS p FROM f JOIN m ON block = fold JOIN w USING (fold)),
j AS (SELECT cluster, sign(y) AS r, sign(p) AS b, mj FROM ev JOIN mv USING (cluster) JOIN os USING (i) WHERE NOT tr AND y <> 0)
SELECT CAST(NULL AS BIGINT) AS cluster, count(*) AS n, {_SHARES} FROM j HAVING count(*) > 0 UNION ALL SELECT cluster, count(*), {_SHARES} FROM j GROUP BY cluster HAVING count(*) >= 30
"""


def stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = walk.stability(bars(spark, sf_dir), ["bucket", "asset"], 4, lambda seed: walk.Bins("px", [0.25, 0.5, 0.75]))
    return _r(got, "against", "block", "seed")


STABLE_SQL = f"""
WITH {BARS_SQL}, n AS (SELECT px, row_number() OVER (ORDER BY bucket, asset) - 1 AS i, (SELECT count(*) FROM bars) // 4 AS size FROM bars),
d AS (SELECT i, px, CAST(least(i // size, 3) AS INT) AS block FROM n), c AS (SELECT block, quantile_cont(px, [0.25, 0.5, 0.75]) AS q FROM d GROUP BY block UNION ALL SELECT -1, quantile_cont(px, [0.25, 0.5, 0.75]) FROM d),
l AS (SELECT i, d.block, c.block AS of, len(list_filter(q, lambda x: px > x)) AS label FROM d JOIN c ON c.block IN (-1, d.block - 1, d.block)),
p AS (SELECT CASE WHEN o.of = -1 AND w THEN 'whole' ELSE 'before' END AS against, s.block, s.label AS a, o.label AS b
      FROM l s JOIN (SELECT *, unnest([true, false]) AS w FROM l) o ON s.i = o.i AND s.of = s.block AND ((w AND o.of = -1) OR (NOT w AND s.block > 0 AND o.of = s.block - 1))),
x AS (SELECT against, block, a, b, count(*) AS n FROM p GROUP BY ALL), z AS (SELECT against, block, sum(n * (n - 1) / 2.0) AS ab, sum(n) AS n FROM x GROUP BY ALL),
sa AS (SELECT against, block, sum(n * (n - 1) / 2.0) AS sa FROM (SELECT against, block, a, sum(n) AS n FROM x GROUP BY ALL) GROUP BY ALL),
sb AS (SELECT against, block, sum(n * (n - 1) / 2.0) AS sb FROM (SELECT against, block, b, sum(n) AS n FROM x GROUP BY ALL) GROUP BY ALL)
SELECT against, block, 0 AS seed, round((ab - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 6) AS ari FROM z JOIN sa USING (against, block) JOIN sb USING (against, block)
"""
ENTRIES, LEAVES, COSTS, PAID = [0.5, 0.6], [0.1, 0.3], {"maker_taker": 7.0, "taker_taker": 10.0}, 10.0


def tradable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry by asset and size of the move, exits by step and value; folds by the day's place in its asset's series."""
    cell = F.concat("asset", F.lit("/"), F.floor(F.abs("move") / 1000).cast("string"))
    e = _events(spark, sf_dir).withColumns({"block": F.floor(F.col("i") / 500), "cell": cell})
    step = lambda k, v: (F.floor(k / 3) * 1000 + F.floor(v / 500)).cast("long")
    return _r(walk.tradability(e, "path", "block", "cell", step, K, ENTRIES, LEAVES, COSTS, PAID), "entry", "exit", "cost", "n")


_PAIRS = [(a, b) for a in (50, 75) for b in (50, 75)]
_C = "CAST((k // 3) * 1000 + floor(v / 500) AS BIGINT)"
_HITS = ", ".join([*(f"arg_min(v, k) FILTER (v >= tp{a} OR v <= -sl{b}) AS h{a}_{b}" for a, b in _PAIRS), *(f"arg_min(v, k) FILTER (v <= -sl75 OR s >= {x}) AS l{i}" for i, x in enumerate(LEAVES))])
_EXITS = " UNION ALL ".join(
    [*(f"SELECT fold, proba, 'tp{a}_sl{b}' AS exit, CASE WHEN h{a}_{b} IS NULL THEN last WHEN h{a}_{b} >= tp{a} THEN tp{a} ELSE -sl{b} END AS gross FROM x" for a, b in _PAIRS)]
    + [f"SELECT fold, proba, 'leave{x}', CASE WHEN l{i} IS NULL THEN last WHEN l{i} <= -sl75 THEN -sl75 ELSE l{i} END FROM x" for i, x in enumerate(LEAVES)]
)
TRADABLE_SQL = f"""
WITH {_EVENTS_SQL}, steps AS (SELECT asset, bucket, k, v FROM st WHERE k IS NOT NULL),
e AS (SELECT asset, bucket, CAST(i // 500 AS INT) AS block, asset || '/' || CAST(CAST(floor(abs(move) / 1000) AS BIGINT) AS VARCHAR) AS cell, arg_max(v, k) AS last, max(v) AS mfe, -min(v) AS mae
      FROM ev JOIN steps USING (asset, bucket) WHERE i // 500 <= {K} GROUP BY ALL),
fd AS (SELECT CAST(unnest(range(1, {K + 1})) AS INT) AS fold),
r AS (SELECT fold, cell, (sum((last > 0)::INT) + 1) / (count(*) + 2) AS rate FROM e JOIN fd ON block < fold GROUP BY ALL),
mk AS (SELECT fold, quantile_cont(mfe, 0.5) AS tp50, quantile_cont(mfe, 0.75) AS tp75, quantile_cont(mae, 0.5) AS sl50, quantile_cont(mae, 0.75) AS sl75 FROM e JOIN fd ON block < fold GROUP BY fold),
sc AS (SELECT e.asset, e.bucket, block, fd.fold, coalesce(rate, 0.5) AS proba FROM e JOIN fd ON block <= fd.fold LEFT JOIN r ON r.fold = fd.fold AND r.cell = e.cell),
tr AS (SELECT fold, asset, bucket, block, proba, k, v * CASE WHEN proba >= 0.5 THEN 1 ELSE -1 END AS v FROM sc JOIN steps USING (asset, bucket)),
lb AS (SELECT fold, k, v, max(v) OVER (PARTITION BY fold, asset, bucket) AS best, max(v) OVER (PARTITION BY fold, asset, bucket ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS soon FROM tr WHERE block < fold),
gd AS (SELECT fold, {_C} AS c, (sum((v >= 0.6 * best AND v > {PAID + 5} AND coalesce(soon <= v * 1.15, true))::INT) + 1) / (count(*) + 2) AS r FROM lb WHERE best >= {PAID + 5} AND k >= 3 GROUP BY ALL),
te AS (SELECT tr.fold, asset, bucket, proba, k, v, coalesce(r, 0) AS s, tp50, tp75, sl50, sl75 FROM tr JOIN mk ON mk.fold = tr.fold LEFT JOIN gd ON gd.fold = tr.fold AND gd.c = {_C} WHERE block = tr.fold),
x AS (SELECT fold, asset, bucket, proba, tp50, tp75, sl50, sl75, arg_max(v, k) AS last, {_HITS} FROM te GROUP BY ALL), g AS ({_EXITS}),
net AS (SELECT et AS entry, exit, c.cost, fold, gross - c.paid AS net FROM g, (SELECT unnest({ENTRIES}) AS et), (VALUES {', '.join(f"('{n}', {v})" for n, v in COSTS.items())}) c(cost, paid) WHERE proba >= et OR proba <= 1 - et),
bf AS (SELECT entry, exit, cost, fold, count(net) AS n, avg(net) AS net, avg((net > 0)::INT) AS win FROM net GROUP BY ALL)
SELECT CAST(entry AS DOUBLE) AS entry, exit, cost, CAST(sum(n) AS BIGINT) AS n, round(avg(net), 6) AS mean_net, round(avg(win), 6) AS win FROM bf GROUP BY ALL
"""
QUERIES = {
    "eval_out_of_sample": (out_of_sample, OUT_OF_SAMPLE_SQL),
    "eval_directions": (directions, DIRECTIONS_SQL),
    "eval_stability": (stable, STABLE_SQL),
    "eval_tradability": (tradable, TRADABLE_SQL),
}
