"""Published question sets over long conversations, as tables of turns and questions.

Two shapes of JSON files are read, an array of samples each: dialogues with numbered sessions and questions on turns,
and haystacks of sessions with one question each. Files are local: nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import evidence_ids

#: Names of the dialogues' numbered kinds of questions: fixed values of the published set.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}

_DIALOGUE = "sample_id string, conversation string, qa array<struct<question:string,category:int,evidence:array<string>>>"
_HAYSTACK = "question_id string, question_type string, question string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"


def provenance(spark: SparkSession, path: str, expected: str | None = None) -> DataFrame:
    """(file, bytes, sha256) of a set's files; with ``expected``, a file of another digest raises when it is read."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if expected is None:
        return files
    return files.withColumn("sha256", F.when(F.col("sha256") == expected, F.col("sha256")).otherwise(F.raise_error(F.concat("file", F.lit(" isn't the pinned revision")))))


def _samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each sample, numbered as they stand in the file."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", ArrayType(StructType.fromDDL(schema))).alias("all"))
    return whole.select(F.posexplode("all").alias("number", "s")).select("number", "s.*")


def said(label: Column, text: Column, date: Column, dated: bool) -> Column:
    """A turn's text as it is stored, with its date in front where that is wanted."""
    line = F.concat(label, F.lit(": "), text)
    return F.concat(F.lit("["), F.coalesce(date, F.lit("")), F.lit("] "), line) if dated else line


def dialogues(spark: SparkSession, path: str, prefix: str = "dialogue", dated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of dialogues: turns have project, key, session, place, role, text; questions project, question_id, question, category, relevant.

    Evidence is repaired to the form of a turn's key; what names no turn of its sample is left out, repeats count once.
    """
    samples = _samples(spark, path, _DIALOGUE).withColumn("project", F.concat(F.lit(f"{prefix}-"), "number", F.lit("-"), "sample_id"))
    members = F.from_json("conversation", "map<string,string>")
    sessions = samples.select("project", members.alias("m")).select("project", "m", F.explode("m").alias("session", "turns")).where(F.col("session").rlike(r"^session_\d+$"))
    said_in = sessions.select("project", "session", F.element_at("m", F.concat("session", F.lit("_date_time"))).alias("date"), F.posexplode(F.from_json("turns", "array<struct<speaker:string,dia_id:string,text:string>>")).alias("place", "t"))
    turns = said_in.select("project", F.col("t.dia_id").alias("key"), "session", F.col("place").cast("long").alias("place"), F.lit(None).cast("string").alias("role"), said(F.concat("t.speaker", F.lit(" said")), F.col("t.text"), F.col("date"), dated).alias("text"))
    asked = samples.select("project", "sample_id", F.posexplode("qa").alias("at", "q"))
    found = F.array_distinct(evidence_ids(F.array_join(F.coalesce("q.evidence", F.array().cast("array<string>")), " ")))
    category = F.element_at(F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair)), F.col("q.category"))
    rows = asked.select("project", F.concat("sample_id", F.lit("#"), "at").alias("question_id"), F.col("q.question").alias("question"), category.alias("category"), F.posexplode_outer(found).alias("nth", "key"))
    valid = rows.join(turns.select("project", "key").distinct().withColumn("known", F.lit(True)), ["project", "key"], "left")
    kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("known"), F.struct("nth", "key")))), lambda x: x["key"])
    return turns, valid.groupBy("project", "question_id", "question", "category").agg(kept.alias("relevant"))


def haystacks(spark: SparkSession, path: str, prefix: str = "haystack", dated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of haystacks, as ``dialogues``; questions have relevant_sessions and abstention too. A session that a haystack repeats counts once."""
    samples = _samples(spark, path, _HAYSTACK).withColumn("project", F.concat(F.lit(f"{prefix}-"), "question_id"))
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    each = samples.select("project", F.posexplode(zipped).alias("nth", "z"))
    first = F.row_number().over(Window.partitionBy("project", "session").orderBy("nth"))
    once = each.select("project", "nth", F.col("z.haystack_session_ids").alias("session"), F.col("z.haystack_dates").alias("date"), F.col("z.haystack_sessions").alias("turns")).withColumn("first", first).where(F.col("first") == 1)
    rows = once.select("project", "session", "date", "nth", F.posexplode("turns").alias("place", "t"))
    label = F.when(F.col("t.role") == "user", "User said").otherwise("Assistant answered")
    key = F.concat("session", F.lit("#"), "place")
    held = rows.select("project", key.alias("key"), "session", F.col("place").cast("long").alias("place"), F.col("t.role").alias("role"), said(label, F.col("t.content"), F.col("date"), dated).alias("text"), F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"), "nth")
    answers = held.where("has_answer").groupBy("project").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "place", "key"))), lambda x: x["key"]).alias("relevant"))
    asked = samples.select("project", "question_id", "question", F.col("question_type").alias("category"), F.col("answer_session_ids").alias("relevant_sessions"), F.col("question_id").endswith("_abs").alias("abstention"))
    return held.drop("has_answer", "nth"), asked.join(answers, "project", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<string>")))


def ranked_keys(results: DataFrame, stored: DataFrame) -> DataFrame:
    """(query_id, ranked, ranked_sessions): results (query_id, rank, id) as keys of turns and as sessions, each session at its first place.

    ``stored`` (id, key, session) says what was stored under which id; ids that it doesn't have stand as unknown, since they
    took a place in the list.
    """
    rows = results.join(stored.select("id", "key", "session"), "id", "left")
    entry = F.struct("rank", F.coalesce("key", F.concat(F.lit("unknown:"), "id")).alias("key"), F.coalesce("session", F.lit("unknown")).alias("session"))
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("list"))  # a result list is short
    return listed.select("query_id", F.transform("list", lambda x: x["key"]).alias("ranked"), F.array_distinct(F.transform("list", lambda x: x["session"])).alias("ranked_sessions"))
