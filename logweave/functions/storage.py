"""The shared folder for intermediate tables, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: a temporary one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="logweave-checkpoint-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    base = shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder as compressed columns and read back: cut() for large tables, a few times smaller on disk. Partitions are not kept."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, key: str = "run_id", path: str | None = None) -> DataFrame:
    """written() in n buckets of a key: joins, groups and windows by it shuffle nothing more. Rows that are dealt by the key into n partitions already are not dealt again, and make a file each."""
    name = f"bucketed_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(df.sparkSession)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    return df.sparkSession.table(name)
