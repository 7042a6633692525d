"""Helpers that the corpus operators share: tables, durable intermediate tables, text digests."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch at most: a batch of whole documents has to fit a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let no worker get more at once; every operator that writes a table, or reads one by its name, asks for it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone, so that any store works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or else the one that the session's checkpoints go to."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        # a single machine: its own folder is shared by all there is
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lorekeep-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage (a lost executor costs a task, not the plan) and makes
    each expensive step run once. Spark removes the folder when the session ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def numbered(df: DataFrame, columns: dict[str, str | F.Column]) -> DataFrame:
    """The columns, with (file, row): the file that a row comes from, hashed, and its place there.

    They name a row however often and in whatever splits the files are read. What isn't a plain scan of
    files is written to the shared folder first.
    """
    own = [F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()]
    if not _scans_files(df):
        df, own = stash(df.select(*own)), list(columns)
    return df.select(F.xxhash64("_metadata.file_path").alias("file"), F.coalesce(F.col("_metadata.row_index"), F.lit(-1).cast("long")).alias("row"), *own)


def plain_scan(df: DataFrame, *columns: str) -> DataFrame:
    """The columns; what isn't a plain scan of files is written to the shared folder first, for operators that read it again and again."""
    return df.select(*columns) if _scans_files(df) else stash(df.select(*columns))


def _scans_files(df: DataFrame) -> bool:
    """Whether a plan only picks rows and columns of Parquet files."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString().lower() and plan.children().isEmpty()


def body(column: str = "text") -> F.Column:
    """A document's whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: str) -> list[bytes]:
    """Runs of anything but space and 0x09-0x0D, as UTF-8 (``bytes.split`` knows exactly these six)."""
    return text.encode().split()


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, beside a JVM that needs the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Batches that have rows; what the worker's last task freed, and then this one, is given back."""
    give_back()
    for batch in rows:
        if batch.num_rows:
            yield batch
    give_back()
