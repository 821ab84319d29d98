"""Versioned Parquet tables: a version is written aside and published by renaming its folder, which one writer wins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose write was committed."""
    fs, at = _fs(spark, root)
    if not fs.exists(at):
        return []
    found = (str(s.getPath().getName()) for s in fs.listStatus(at))
    return sorted(int(n[1:]) for n in found if n.startswith("v") and fs.exists(_fs(spark, f"{root}/{n}/_SUCCESS")[1]))


def publish(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> int:
    """The table as the next version. Of two writers of one version one wins and the other takes the next number: a rename
    onto an existing folder fails, or lands inside it, where it is found and tried again."""
    spark = df.sparkSession
    aside = f"{root}/_new-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(aside)
    fs, at = _fs(spark, aside)
    while True:
        version = max(versions(spark, root), default=-1) + 1
        _, to = _fs(spark, f"{root}/v{version}")
        if not fs.exists(to) and fs.rename(at, to):
            _, inside = _fs(spark, f"{root}/v{version}/{aside.rpartition('/')[2]}")
            if not fs.exists(inside):
                return version
            at = inside


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder for driver and executors: under spark.checkpoint.dir, or a temporary one on a local master. It goes with the
    driver's JVM at the latest."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='engram-')}")
        found = spark.sparkContext.getCheckpointDir()
    path = f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    fs, at = _fs(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    known = versions(spark, root)
    return spark.read.parquet(f"{root}/v{known[-1] if version is None else version}")


def settled(df: DataFrame, what: str) -> DataFrame:
    """The table written to the shared folder and read again: what follows starts from there, whatever it took to make."""
    path = f"{fresh_path(df.sparkSession, what)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
