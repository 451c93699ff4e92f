"""Session helpers: table access and fault-tolerant lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexgraph-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared checkpoint folder, for tables that a query writes and reads again."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder, so that a lost executor costs no result."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unclash(df: DataFrame, *names: str) -> list[str]:
    """For each wanted helper column, a name that ``df`` does not use yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Repartition over all cores before costly row work, which adaptive coalescing by bytes would put into one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)
