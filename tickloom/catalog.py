"""The engine's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import assembly, features, market, studies, walks
from .streaming import live


CHUNKED = ("s1_rolling", "s2_dynamics", "s3_markets")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.query("s2_dynamics")(spark, sf_dir)


def queries() -> dict:
    found = {name: features.query(name) for name in features.SETS}
    found |= {f"{name}_chunked": features.query(name, 150) for name in CHUNKED}
    return found | {name: run for name, (run, _) in {**market.QUERIES, **studies.QUERIES, **assembly.QUERIES, **walks.QUERIES, **live.QUERIES}.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: features.sql(name) for name in features.SETS}
    found |= {f"{name}_chunked": found[name] for name in CHUNKED}
    return found | {name: sql for name, (_, sql) in {**market.QUERIES, **studies.QUERIES, **assembly.QUERIES, **walks.QUERIES, **live.QUERIES}.items() if sql}
