"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step hands a node's neighbours to the least of them; the edges become stars
around the least node of each component after about log n rounds. A node with
very many neighbours is only ever grouped by a minimum, which is pre-aggregated,
and joined, which Spark splits where it is skewed. Each round is written to the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def components(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, str]:
    """(node, root) of every node that has an edge; root is the least node of its component.

    ``edges`` has two long columns a and b in either order; repeated edges and
    loops do no harm, rows with a null are left out. Returns the table and its path.
    """
    spark = edges.sparkSession
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")  # a > b
    now, path = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(a, b).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        # Large star: neighbours above a node move to the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: neighbours below a node, and the node, move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after, after_path = written(small, "edges")
        drop(spark, path)
        now, path, before, state = after, after_path, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out, out_path = written(roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    drop(spark, path)
    return out, out_path


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())
