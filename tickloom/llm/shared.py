"""Shared folder, written tables and small helpers of the llm operators."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset (tests, one machine) a folder beside the
    warehouse is used and also set as the checkpoint folder; on a cluster, whose
    machines may not share that, an error is raised. The application's part of
    the folder is deleted when the driver ends.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(top)
    own = f"{top.rstrip('/')}/{sc.applicationId}"
    if sc.applicationId not in _MARKED:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(sc.applicationId)
    return own


def written(df: DataFrame, what: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder, return its reread and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no plan still to run reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package through the shared folder: they may not see the driver's."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tickloom", os.path.relpath(full, top)))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tickloom_pkg.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(held.getvalue())
    out.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cuts(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches cut to so many rows: a worker's lists and results stay small beside the batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (case is ignored, as Spark does)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name = "_" + name
    return name
