"""Memory, turn, query and event tables derived from the driver's tables; ``oracle.VIEWS`` has the same in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import with_defaults

#: The time that ages are counted from; never the clock.
AS_OF = "2024-12-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


#: Bytes of files that are dealt out over the cores: a small table often is one row group, which a single task reads.
SMALL = (1 << 20, 1 << 28)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. A small one is spread over the cores by one cheap shuffle; others have splits enough."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if SMALL[0] <= size <= SMALL[1] else df


def _case(key: Column, values: dict[int, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory a document; those without a row in embeddings have no vector."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    n = F.col("doc_id")
    trashed, superseded = n % 97 == 5, n % 97 == 11
    created = F.timestamp_add("HOUR", ((n * 7) % 8000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    project = F.when(trashed, "_trash").when(superseded, "_superseded").when(n % 89 == 3, "playbook").when(n % 83 == 7, "root").otherwise(F.col("source"))
    out = rows.select(
        "doc_id",
        F.concat(F.lit("doc_"), n.cast("string")).alias("id"),
        project.alias("project"),
        F.col("text").alias("document"),
        "embedding",
        created.alias("created_at"),
        F.timestamp_add("DAY", (n % 10).cast("int"), created).alias("updated_at"),
        _case(n % 5, {1: "auto_log", 2: "filtered", 3: "consolidated"}, "manual").alias("chunk_type"),
        _case(n % 4, {0: "knowledge", 1: "decision", 2: "preference"}, "log").alias("importance"),
        _case(n % 6, {1: "failure", 2: "correction", 3: "insight", 4: "convention"}, "general").alias("category"),
        _case(n % 7, {0: "rule", 1: "fact", 2: "procedure"}, "record").alias("memory_kind"),
        (n % 11 == 0).alias("pinned"),
        (n % 13 == 0).alias("sensitive"),
        F.when(trashed | superseded, F.col("source")).alias("scope_project"),
        F.when(trashed, F.col("source")).alias("original_project"),
        F.when(trashed, F.timestamp_add("DAY", F.lit(3), created)).alias("trashed_at"),
        F.when((n % 41 == 0) & (n > 0), F.concat(F.lit("doc_"), (n - 1).cast("string"))).alias("supersedes"),
        F.when(n % 17 == 0, F.timestamp_add("DAY", F.lit(20), created)).alias("reviewed_at"),
        F.when(n % 9 == 0, (n % 120) / 100.0).cast("float").alias("confidence"),
    )
    return with_defaults(out).drop("source").withColumn("source", F.lit(None).cast("string"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory a turn of a user or assistant."""
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    start = F.timestamp_add("MINUTE", F.col("conv_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    said = F.timestamp_add("SECOND", F.col("turn").cast("int"), start)
    out = rows.select(
        F.concat(F.lit("turn_"), conv, F.lit("_"), turn).alias("id"),
        F.concat(F.lit("conv"), (F.col("conv_id") % 5).cast("string")).alias("project"),
        F.col("text").alias("document"),
        said.alias("created_at"),
        said.alias("updated_at"),
        conv.alias("session_id"),
        F.lit("host.transcript").alias("source"),
        "role",
        F.concat(conv, F.lit(":"), turn).alias("event_id"),
        F.lit(1).cast("long").alias("sequence"),
        F.lit(1).cast("long").alias("total"),
    )
    return with_defaults(out)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a benchmark passage: over all projects, over one and the playbook, over four."""
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    n = F.col("item_id")
    one = F.array(F.concat(F.lit("src"), (n % 20).cast("string")), F.lit("playbook"))
    scope = F.when(n % 3 == 1, one).when(n % 3 == 2, F.array(*map(F.lit, ("src1", "src2", "src3", "root")))).otherwise(F.array().cast("array<string>"))
    rows = items.join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left")
    return rows.select(n.alias("query_id"), "text", "embedding", scope.alias("scope"), F.lit(10).alias("n"), as_of().alias("as_of"))


#: Query texts of each form, of a passage's first words {0} to {4}; the number of a form is item_id modulo their number.
SYNTAX = (
    "{0} {1}.",
    "{0} AND {1}",
    '"{0} {1}"',
    "+{0} -{1} {2}",
    "({0} OR {1}) AND {2}",
    "{0} NOT {1}",
    "project:{5} AND {0}",
    "{0}^3 {1}",
    '"{0} {1} {2}" OR ({3} AND NOT {4})',
    "{0}'s \"{1}",
    "-{0}",
    'document:({0} "{1} {2}")',
    "{0}-{1}",
    "other:{0} {1}",
)


def syntax_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries, their texts made of a passage's words in each form of the query syntax."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    parts = [F.coalesce(F.get(words, F.lit(i)), F.lit("none")) for i in range(5)] + [F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))]
    text = F.lit(None).cast("string")
    for i, form in enumerate(SYNTAX):
        pieces = [parts[int(p)] if at % 2 else F.lit(p) for at, p in enumerate(re.split(r"\{(\d)\}", form))]
        text = F.when(F.col("query_id") % len(SYNTAX) == i, F.concat(*pieces)).otherwise(text)
    return queries(spark, sf_dir).withColumn("text", text)


def turn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same passages asked of the turns."""
    return queries(spark, sf_dir).withColumn("scope", F.array().cast("array<string>")).withColumn("embedding", F.lit(None).cast("array<float>"))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id): documents that hold the passage word for word.

    The passages are a small table of fixed size, broadcast so that each document is looked through once.
    """
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = memories(spark, sf_dir).select("id", "document")
    return docs.join(F.broadcast(asked), F.contains("document", "text")).select("query_id", "id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job updates from events: the user's job, in a state by the kind of event."""
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("job_id"), state.alias("state"), F.col("ts").alias("updated_at"), F.col("value").alias("ms"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    actor = F.when(F.col("user_id") % 7 == 0, "unauthenticated").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string")))
    outcome = F.when(F.col("event_type") == "error", "denied").otherwise("allowed")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), actor.alias("actor"), F.col("event_type").alias("action"), outcome.alias("outcome"))


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace a supplier; several share a last folder."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ws"), F.col("s_suppkey").cast("string")).alias("workspace_id"),
        F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("src"), (F.col("s_suppkey") % 60).cast("string"))).alias("legacy_project"),
        F.concat(F.lit("/home/u/"), F.lit("./a/../Pro ject"), (F.col("s_suppkey") % 60).cast("string"), F.lit("/")).alias("cwd"),
    )


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A principal a nation, with grants by its region; the first is an administrator."""
    n = F.col("n_nationkey")
    grants = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("src"), ((n * 3 + i) % 20).cast("string")))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("principal"), (n == 0).alias("admin"), grants.alias("read_projects"))


def meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("src1", "archive"), ("playbook", "playbook")], "name string, kind string")
