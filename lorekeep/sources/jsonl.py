"""JSON lines in, archives and audit lines out, snapshots of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import import_id
from ..functions.metadata import parsed
from ..functions.text import redact
from ..schema import METADATA, with_defaults
from . import folders

RECORD = "id string, project string, document string, text string, embedding array<float>, created_at string, metadata string"
#: Formats of a time besides those of RFC 3339.
TIMES = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")


def parse_time(value: Column, fallback: Column) -> Column:
    """RFC 3339, else one of ``TIMES`` as UTC, else the fallback; as UTC without a zone."""
    zoned = F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"))
    utc = F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz")
    return F.coalesce(utc, *(F.try_to_timestamp(value, F.lit(t)).cast("timestamp_ntz") for t in TIMES), fallback)


def imported(lines: DataFrame, as_of: Column, dim: int, open_metadata: bool = False) -> DataFrame:
    """Memory rows from a table of JSON lines (value); blank lines and records without text are skipped.

    A vector of another length than ``dim`` is left out: it has to be computed anew. With ``open_metadata``, all that a
    record's metadata held stays in a column ``metadata`` (VARIANT, see ``functions.metadata``), known to the schema or not.
    """
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", RECORD).alias("r")).select("r.*")
    rows = rows.withColumn("document", redact(F.coalesce("document", "text", F.lit("")))).where(F.trim("document") != "").drop("text")
    meta = F.from_json("metadata", METADATA)
    whole = parsed("metadata") if open_metadata else F.lit(None)
    rows = rows.withColumn("meta", meta).withColumn("whole", whole).drop("metadata")
    made = parse_time(F.trim("created_at"), as_of)
    out = rows.select(
        F.coalesce("id", import_id("project", "document", "created_at")).alias("id"),
        F.coalesce("project", F.lit("default")).alias("project"),
        "document",
        F.when(F.size("embedding") == dim, F.col("embedding")).alias("embedding"),
        made.alias("created_at"),
        made.alias("updated_at"),
        "meta.*",
        *([F.col("whole").alias("metadata")] if open_metadata else []),
    )
    return with_defaults(out.withColumn("raw_chunk", F.lit(None).cast("string")))


def read_import(spark: SparkSession, path: str, as_of: Column, dim: int) -> DataFrame:
    return imported(spark.read.text(path), as_of, dim)


def archive(rows: DataFrame, path: str) -> None:
    """Append rows that are about to be deleted, a folder a month of creation."""
    rows.withColumn("month", F.date_format("created_at", "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


#: A snapshot's list of its files, a folder that readers of the data pass over; rows of a file at most.
MANIFEST, FILE_ROWS = "_manifest", 20_000


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """A written folder takes a path; what was there goes once the new one is in place, and comes back if that fails."""
    old = f"{path}.old"
    folders.remove(spark, old)
    had = folders.exists(spark, path)
    if had:
        folders.rename(spark, path, old)
    try:
        folders.rename(spark, staged, path)
    except Exception:
        if had:
            folders.rename(spark, old, path)
        raise
    folders.remove(spark, old)


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of the files of a table, each read by a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def snapshot(df: DataFrame, path: str) -> None:
    """A whole copy with a list of its files: written beside its place first, then renamed into it.

    Files have a bounded number of rows, since a digest is taken of a whole file in one task.
    """
    spark, staged = df.sparkSession, f"{path}.staged"
    df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(staged)
    _digests(spark, staged).write.mode("overwrite").parquet(f"{staged}/{MANIFEST}")
    _replace(spark, staged, path)


def verify(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a snapshot: files that are missing, not listed, or not as they were written; the first hundred."""
    if not folders.exists(spark, f"{path}/{MANIFEST}"):
        return [f"{path} has no {MANIFEST}"]
    listed = spark.read.parquet(f"{path}/{MANIFEST}").select("name", F.struct("length", "sha256").alias("listed"))
    found = _digests(spark, path).select("name", F.struct("length", "sha256").alias("found"))
    what = F.when(F.col("found").isNull(), "is missing").when(F.col("listed").isNull(), "isn't listed").when(F.col("found") != F.col("listed"), "has changed")
    wrong = listed.join(found, "name", "full").select(F.concat("name", F.lit(" "), what).alias("said")).where("said is not null")
    return sorted(r.said for r in wrong.limit(100).collect())


def restore(spark: SparkSession, path: str, table: str) -> None:
    """A snapshot takes a table's place, after its files were checked; a bad one raises and leaves the table as it is."""
    wrong = verify(spark, path)
    if wrong:
        raise ValueError("; ".join(wrong))
    staged = f"{table}.staged"
    spark.read.parquet(path).write.mode("overwrite").parquet(staged)
    _replace(spark, staged, table)
