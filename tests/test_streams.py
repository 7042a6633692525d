"""Streams, sources and sinks."""

import datetime as dt
import json

import pytest
from lorekeep.schema import with_defaults
from lorekeep.sources import jsonl, transcripts
from lorekeep.sources.tail import TailReader, TailSource
from lorekeep.streaming.ingest import file_lines, ingest, is_alive, merge_batch
from pyspark.sql import functions as F

def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


def line(**x):
    return json.dumps(x)


FIRST = [
    line(type="user", sessionId="s1", cwd="/w/p", uuid="u1", message={"role": "user", "content": "hello <system-reminder>x</system-reminder>there"}),
    line(type="assistant", sessionId="s1", cwd="/w/p", uuid="u2", message={"role": "assistant", "content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}),
    line(type="user", sessionId="s1", uuid="u3", message={"role": "user", "content": [{"type": "tool_result", "content": "out"}]}),
    line(type="user", sessionId="s1", uuid="u4", isSidechain=True, message={"role": "user", "content": "side"}),
    "not json",
    "",
]
SECOND = [line(type="session", id="s2", cwd="/w/q"), line(type="message", id="m1", message={"role": "user", "content": "ask"}), line(type="message", id="m2", message={"role": "toolResult", "content": "out"})]
THIRD = [line(type="session_meta", payload={"id": "s3", "cwd": "/w/r", "thread_source": "user"}), line(type="event_msg", id="e1", payload={"type": "agent_message", "message": "answer"}), line(type="event_msg", payload={"type": "token_count"})]
SIDE = [line(type="session", id="s4", cwd="/w/q", parentSession="s2"), line(type="message", id="m9", message={"role": "user", "content": "hidden"})]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    for name, lines in (("a", FIRST), ("deep/b", SECOND), ("c", THIRD), ("d", SIDE)):
        (root / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    (root / "other.txt").write_text("x\n")
    return root


def test_three_hosts(spark, folder):
    got = {(r.session_id, r.role, r.text, r.cwd) for r in transcripts.parse(transcripts.read_files(spark, str(folder))).collect()}
    assert got == {("s1", "user", "hello there", "/w/p"), ("s1", "assistant", "one\ntwo", "/w/p"), ("s2", "user", "ask", "/w/q"), ("s3", "assistant", "answer", "/w/r")}


def test_long_turns_are_split(spark):
    turns = spark.createDataFrame([("f", 0, "inline", "user", "x" * 20, "s", "/w/p", "u")], "path string, offset long, host string, role string, text string, session_id string, cwd string, host_event_id string")
    rows = transcripts.to_memories(turns, now(), size=15).orderBy("sequence").collect()
    assert [r.document for r in rows] == ["User said: xxxx", "x" * 15, "x"] and {r.total for r in rows} == {3} and len({r.id for r in rows}) == 3


def empty(spark):
    return with_defaults(spark.createDataFrame([], "id string, project string, document string, created_at timestamp_ntz"))


def test_a_stream_stores_each_turn_once(spark, folder, tmp_path):
    out = str(tmp_path / "table")
    empty(spark).select("id").write.parquet(out)
    stored = lambda: spark.read.parquet(out)
    purged = spark.createDataFrame([], "id string")

    def run(checkpoint):
        ingest(file_lines(spark, str(folder)), str(tmp_path / checkpoint), stored, lambda: purged, lambda df, n: df.select("id").write.mode("append").parquet(out), now, once=True).awaitTermination()

    run("one")
    batch = merge_batch(transcripts.read_files(spark, str(folder)), empty(spark), purged, now())
    assert {r.id for r in stored().collect()} == {r.id for r in batch.collect()} and stored().count() == 4
    run("two")  # a lost checkpoint: everything is delivered again
    assert stored().count() == 4
    (folder / "e.jsonl").write_text(FIRST[0].replace("u1", "u9") + "\n")
    run("one")
    assert stored().count() == 5


def test_tail_offsets(tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_bytes(b"one\ntwo\npart")
    reader = TailReader({"root": str(tmp_path)})
    start = reader.initialOffset()
    assert start == {str(f): 8}
    with f.open("ab") as h:
        h.write(b"ial\n\xff\xfe\nfour\nrest")
    end = reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    assert [(o, v) for _, o, v in rows] == [(8, "partial"), (19, "four")]
    f.write_bytes(b"new\n")
    after = reader.latestOffset()
    assert [r[2] for p in reader.partitions(end, after) for r in reader.read(p)] == ["new"]
    back = TailReader({"root": str(tmp_path), "backfill": "true"})
    assert back.initialOffset() == {str(f): 0}


def test_tail_as_a_stream(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    (root / "x.jsonl").write_text("a\nb\n")
    spark.dataSource.register(TailSource)
    out = str(tmp_path / "out")

    def run():
        df = spark.readStream.format("tail").option("root", str(root)).option("backfill", "true").load()
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run()
    with (root / "x.jsonl").open("a") as h:
        h.write("c\nd")
    run()
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_import(spark):
    lines = [
        line(id="a", text="t", created_at="2024-03-01T10:00:00+02:00", embedding=[1.0, 2.0], metadata={"chunk_type": "manual"}),
        line(document="d", text="t", created_at="2024-03-01 08:30", embedding=[1.0]),
        line(text="  "),
        "",
    ]
    rows = {r.document: r for r in jsonl.imported(spark.createDataFrame([(x,) for x in lines], "value string"), now(), 2).collect()}
    assert set(rows) == {"t", "d"}
    assert rows["t"].created_at == dt.datetime(2024, 3, 1, 8) and rows["t"].chunk_type == "manual" and list(rows["t"].embedding) == [1.0, 2.0]
    assert rows["d"].created_at == dt.datetime(2024, 3, 1, 8, 30) and rows["d"].embedding is None and rows["d"].id.startswith("import_") and rows["d"].project == "default"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 5)), ("b", dt.datetime(2024, 2, 5))], "id string, created_at timestamp_ntz")
    jsonl.archive(df, str(tmp_path / "archive"))
    assert sorted(p.name for p in (tmp_path / "archive").glob("month=*")) == ["month=2024-01", "month=2024-02"]
    for n in (1, 2):
        jsonl.snapshot(df.limit(n), str(tmp_path / "copy"))
        assert spark.read.parquet(str(tmp_path / "copy")).count() == n
    jsonl.append_audit(df, str(tmp_path / "audit"))
    jsonl.append_audit(df, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4


def test_liveness(spark):
    at = lambda s: F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)).cast("timestamp_ntz")
    row = spark.range(1).select(is_alive(at(0), at(300)).alias("a"), is_alive(at(0), at(301)).alias("b"), is_alive(at(0), at(900), 300).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, True)
