"""Folders that all executors share, and small marks in them."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or else the one of the session's checkpoints; one of its own only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lorekeep-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def fresh(spark: SparkSession, stem: str) -> str:
    """A new folder's name in the shared folder; what is there when the session ends goes."""
    path = f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
    fs, at = filesystem(spark, path)
    fs.deleteOnExit(at)
    return path


def filesystem(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The store of a path, and the path as the store knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds; none if there is no such folder."""
    fs, at = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, at = filesystem(spark, path)
    if not fs.rename(at, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't become {to}")


def kept(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder once and read from there: what several steps read is computed once, and a lost executor costs a task."""
    path = fresh(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
