"""Conversation turns from the transcript files of three kinds of hosts, told apart by the shape of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import file_identity, transcript_id
from ..functions.text import parts, redact, spoken, strip_reminders
from ..schema import with_defaults

PART = "array<struct<type:string,text:string>>"
LINE = (
    "type string, sessionId string, cwd string, uuid string, id string, isSidechain boolean, isMeta boolean, parentSession string, parentSessionId string, parent_session_id string, "
    "message struct<role:string,content:string>, payload struct<id:string,cwd:string,type:string,message:string,thread_source:string>"
)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, offset, value): every line of the JSON line files under a folder; offset is its place in the file."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    whole = lines.select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("lines"))
    place = lambda xs: F.transform(xs, lambda x, i: F.struct(F.octet_length(F.array_join(F.slice(xs, 1, i), "\n")).alias("offset"), x.alias("value")))
    return whole.select("path", F.explode(place(F.col("lines"))).alias("l")).select("path", F.col("l.offset").cast("long").alias("offset"), "l.value")


def _text(content: Column) -> Column:
    """A message's words: a plain string, or its text parts, without injected reminders."""
    listed = F.from_json(content, PART)
    joined = F.array_join(F.transform(F.filter(listed, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    raw = F.when(F.ltrim(content).startswith("[") & listed.isNotNull(), joined).otherwise(content)
    return F.trim(strip_reminders(F.coalesce(raw, F.lit(""))), F.lit(" \t\r\n"))


def own_headers(lines: DataFrame) -> DataFrame:
    """(path, offset, value, known, session, cwd, side) of the lines (path, offset, value): whether a line is a header, and what it names. Blank lines and what isn't JSON go."""
    rows = lines.where(F.trim("value") != "").withColumn("l", F.from_json("value", LINE)).where("l is not null")
    payload = F.col("l.payload")
    parent = F.coalesce("l.parentSession", "l.parentSessionId", "l.parent_session_id", F.lit(""))
    source = F.lower(F.coalesce(payload["thread_source"], F.lit("")))
    side = source.contains("subagent") | source.contains("sub_agent") | source.contains("parent_thread_id")
    plain, inner = F.coalesce(F.col("l.type") == "session", F.lit(False)), F.coalesce((F.col("l.type") == "session_meta") & payload.isNotNull(), F.lit(False))
    field = lambda a, b: F.when(plain, a).when(inner, b)
    cwd = field(F.col("l.cwd"), payload["cwd"])
    return rows.select("path", "offset", "value", (plain | inner).alias("known"), field(F.col("l.id"), payload["id"]).alias("session"), F.when(cwd != "", cwd).alias("cwd"), field(parent != "", side).alias("side"))


def parse(lines: DataFrame) -> DataFrame:
    """(path, offset, host, role, text, session_id, cwd, host_event_id) of the turns in (path, offset, value).

    Lines that aren't JSON, tool traffic, injected and side conversations are dropped; a header line names the session and folder of
    the lines after it in its file.
    """
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("known"), F.struct("session", "cwd", "side")), ignorenulls=True).over(before)
    rows = own_headers(lines).withColumn("header", header)
    return turns(rows.select("path", "offset", "value", F.col("header").isNotNull().alias("known"), "header.session", "header.cwd", "header.side"))


def turns(rows: DataFrame) -> DataFrame:
    """``parse`` of lines that carry their file's header: (path, offset, value, known, session, cwd, side). Lines before the file's beginning (its header, read again) are no turns."""
    rows = rows.where("offset >= 0").withColumn("l", F.from_json("value", LINE)).where("l is not null")
    kind, message, payload = F.col("l.type"), F.col("l.message"), F.col("l.payload")
    blank = lambda c: F.when(c != "", c)
    main = ~F.coalesce(F.col("side"), F.lit(False))
    own = kind.isin("user", "assistant") & ~F.coalesce(F.col("l.isSidechain"), F.lit(False)) & ~F.coalesce(F.col("l.isMeta"), F.lit(False)) & message.isNotNull() & (F.coalesce(message["role"], kind) == kind)
    inner = (kind == "message") & main & message["role"].isin("user", "assistant")
    event = (kind == "event_msg") & main & payload["type"].isin("user_message", "agent_message")
    field = lambda a, b, c: F.when(own, a).when(inner, b).when(event, c)
    found = rows.select(
        "path",
        "offset",
        field(F.lit("inline"), F.lit("message"), F.lit("event")).alias("host"),
        field(kind, message["role"], F.when(payload["type"] == "user_message", "user").otherwise("assistant")).alias("role"),
        field(_text(message["content"]), _text(message["content"]), F.trim(strip_reminders(F.coalesce(payload["message"], F.lit(""))), F.lit(" \t\r\n"))).alias("text"),
        F.coalesce(field(F.col("l.sessionId"), F.col("session"), F.col("session")), F.lit("")).alias("session_id"),
        field(blank(F.col("l.cwd")), F.col("cwd"), F.col("cwd")).alias("cwd"),
        field(F.col("l.uuid"), F.col("l.id"), F.coalesce("l.id", payload["id"])).alias("host_event_id"),
    )
    return found.where("host is not null and text != ''")


def to_memories(turns: DataFrame, as_of: Column, project: Column | None = None, size: int = 8000) -> DataFrame:
    """Memory rows of parsed turns, long ones in parts; the id follows from what was said where, so that a replay gets the same."""
    event = F.coalesce("host_event_id", F.concat(F.lit("file-"), file_identity(F.col("path")), F.lit(":"), F.col("offset")))
    rows = turns.withColumn("event_id", event).withColumn("project", F.coalesce(project if project is not None else F.lit(None).cast("string"), F.element_at(F.split(F.coalesce("cwd", F.lit("default")), "/"), -1)))
    split = rows.withColumn("all", parts(redact(spoken(F.col("role"), F.col("text"))), size)).select("*", F.posexplode("all").alias("place", "document"))
    sequence = (F.col("place") + 1).cast("long")
    out = split.select(
        transcript_id(F.col("project"), F.col("host"), F.col("session_id"), F.col("event_id"), sequence).alias("id"),
        "project",
        "document",
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
        F.lit("auto_log").alias("chunk_type"),
        F.lit("log").alias("importance"),
        "session_id",
        "cwd",
        F.concat("host", F.lit(".transcript")).alias("source"),
        F.col("host").alias("adapter"),
        "role",
        "event_id",
        sequence.alias("sequence"),
        F.size("all").cast("long").alias("total"),
    )
    return with_defaults(out)
