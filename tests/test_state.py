"""State from batch to batch: transcript headers, cards of sessions, injections, restarts."""

import datetime as dt
import json

import pytest
from lorekeep.schema import with_defaults
from lorekeep.sources.tail import TailReader, TailSource, header_line
from lorekeep.sources.transcripts import own_headers, parse, turns
from lorekeep.streaming import state as S
from lorekeep.streaming.ingest import ingest
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AT = dt.datetime(2024, 5, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


def said(n):
    return json.dumps({"type": "message", "id": f"m{n}", "message": {"role": "user", "content": f"line {n}"}})


HEAD = json.dumps({"type": "session", "id": "s1", "cwd": "/w/q"})
META = json.dumps({"type": "session_meta", "payload": {"id": "s2", "cwd": "/w/r", "thread_source": "user"}})
EVENT = json.dumps({"type": "event_msg", "id": "e1", "payload": {"type": "agent_message", "message": "answer"}})


def run_ingest(spark, root, tmp_path, backfill="true"):
    out = str(tmp_path / "out")
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("root", str(root)).option("backfill", backfill).load()
    empty = with_defaults(spark.createDataFrame([], "id string, project string, document string, created_at timestamp_ntz"))
    stored = lambda: spark.read.parquet(out) if (tmp_path / "out").exists() else empty.select("id", "document", "session_id", "cwd")
    purged = spark.createDataFrame([], "id string")
    ingest(lines, str(tmp_path / "cp"), stored, lambda: purged, lambda df, n: df.select("id", "document", "session_id", "cwd").write.mode("append").parquet(out), now, once=True, headers=True).awaitTermination()
    return {(r.document, r.session_id, r.cwd) for r in stored().collect()}


def test_headers_reach_lines_of_later_batches_and_restarts(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    a, b = root / "a.jsonl", root / "b.jsonl"
    a.write_text(f"{HEAD}\n{said(1)}\n")
    b.write_text(META + "\n")
    assert run_ingest(spark, root, tmp_path) == {("User said: line 1", "s1", "/w/q")}
    with a.open("a") as h:
        h.write(said(2) + "\n" + said(3)[:20])
    with b.open("a") as h:
        h.write(EVENT + "\n")
    second = run_ingest(spark, root, tmp_path)
    assert second == {("User said: line 1", "s1", "/w/q"), ("User said: line 2", "s1", "/w/q"), ("Assistant answered: answer", "s2", "/w/r")}
    with a.open("a") as h:  # the rest of the line, and a session of its own later in the file
        h.write(said(3)[20:] + "\n" + HEAD.replace("s1", "s9") + "\n")
    run_ingest(spark, root, tmp_path)
    with a.open("a") as h:
        h.write(said(4) + "\n")
    last = run_ingest(spark, root, tmp_path)
    assert last == second | {("User said: line 3", "s1", "/w/q"), ("User said: line 4", "s9", "/w/q")}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(last)


def test_a_file_that_is_followed_from_its_end_has_its_header(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    (root / "a.jsonl").write_text("not json\n" + HEAD + "\n" + said(1) + "\n")
    assert run_ingest(spark, root, tmp_path, "false") == set()
    with (root / "a.jsonl").open("a") as h:
        h.write(said(2) + "\n")
    assert run_ingest(spark, root, tmp_path, "false") == {("User said: line 2", "s1", "/w/q")}


def test_the_offset_tells_where_a_later_file_began(tmp_path):
    reader = TailReader({"root": str(tmp_path)})
    start = reader.initialOffset()
    f = tmp_path / "late.jsonl"
    f.write_text(f"{HEAD}\n{said(1)}\n")
    first = reader.latestOffset()
    f.write_text(f.read_text() + said(2) + "\n")
    # planned by another process, which never saw the file appear: nothing before its beginning, and nothing is lost
    assert [r for p in TailReader({"root": str(tmp_path)}).partitions(start, first) for r in reader.read(p)] == []
    reader.partitions(start, first)
    second = reader.latestOffset()
    again = TailReader({"root": str(tmp_path)})
    rows = [r for p in again.partitions(first, second) for r in again.read(p)]
    assert [r[1:] for r in rows] == [(-1, HEAD), (len(HEAD) + len(said(1)) + 2, said(2))]
    assert header_line(str(f)) == HEAD and not any(k.startswith("began:") for k in second)


def test_carried_headers_equal_those_of_whole_files(spark):
    lines = [("a", i, x) for i, x in enumerate([said(0), HEAD, said(1), META, EVENT, "", "{", HEAD.replace('"/w/q"', '"/w/q", "parentSession": "s0"'), said(2)])]
    rows = spark.createDataFrame(lines, "path string, offset long, value string")
    own = own_headers(rows).collect()
    assert [(r.offset, r.known, r.session, r.side) for r in own if r.known] == [(1, True, "s1", False), (3, True, "s2", False), (7, True, "s1", True)]
    got = [(r.text, r.session_id, r.cwd) for r in parse(rows).orderBy("offset").collect()]
    assert got == [("line 0", "", None), ("line 1", "s1", "/w/q"), ("answer", "s2", "/w/r")]
    one = turns(spark.createDataFrame([("a", -1, HEAD, True, "s1", "/w", False), ("a", 9, said(1), True, "s1", "/w", False)], "path string, offset long, value string, known boolean, session string, cwd string, side boolean"))
    assert [r.text for r in one.collect()] == ["line 1"]


def test_card_rules():
    s = S.Session()
    for i in range(S.MAX_PENDING + 5):
        effects = S.card_event(s, "prompt", None, f"p{i}")
        assert [e[0] for e in effects] == (["list"] if i == 0 else [])
    assert s.pending == [f"p{i}" for i in range(5, S.MAX_PENDING + 5)]
    assert S.card_event(s, "prompt", None, "/clear") == [] and S.card_event(s, "prompt", None, "  ") == []
    assert S.card_event(s, "get", "one", None) == [("record", "one", [f"p{S.MAX_PENDING + 4}"])] and s.pending == []
    for t in ("two", "three", "four"):
        S.card_event(s, "save", t, None)
    assert s.open == ["two", "three", "four"]
    S.card_event(s, "get", "two", None)
    assert s.open == ["three", "four", "two"]
    found = [S.card_event(s, "prompt", None, "go on") for _ in range(10)]
    assert [len(f) for f in found] == [1] * 7 + [2] + [1, 1] and found[7][1] == ("stale", "two", [])
    assert S.card_event(s, "close", "none", None) == [("missing", "none", [])]
    assert S.card_event(s, "close", "two", None) == [] and s.open == ["three", "four"]
    S.card_event(s, "done", "four", None)
    S.card_event(s, "clear", None, None)
    assert s == S.Session()


EVENTS = "owner string, session string, at timestamp, seq long, kind string, title string, message string"


def stream(spark, tmp_path, name, rows, schema, op):
    """One more batch of a stream over a folder, and all that the stream has returned so far."""
    source, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    if rows:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    df = op(spark.readStream.schema(schema).json(source))
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_cards_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    at = lambda m: AT + dt.timedelta(minutes=m)
    op = lambda df: S.card_effects(df, most=2)
    stream(spark, tmp_path, "cards", [("o", "s1", at(0), 0, "prompt", None, "first"), ("o", "s1", at(1), 1, "prompt", None, "second")], EVENTS, op)
    stream(spark, tmp_path, "cards", [("o", "s1", at(2), 2, "get", "card", None), ("o", "s1", at(3), 3, "prompt", None, "third"), ("x", "s1", at(3), 3, "prompt", None, "other owner")], EVENTS, op)
    # a third session of the owner: of two kept ones the one used longest ago goes
    found = stream(spark, tmp_path, "cards", [("o", "s2", at(4), 4, "prompt", None, "b"), ("o", "s3", at(5), 5, "prompt", None, "c"), ("o", "s2", at(6), 6, "prompt", None, "again"), ("o", "s1", at(7), 7, "prompt", None, "d")], EVENTS, op)
    got = sorted((r.owner, r.seq, r.session, r.effect, r.title, tuple(r.messages)) for r in found.collect())
    assert got == [
        ("o", 0, "s1", "list", None, ("first",)),
        ("o", 2, "s1", "record", "card", ("second",)),
        ("o", 3, "s1", "record", "card", ("third",)),
        ("o", 4, "s2", "list", None, ("b",)),
        ("o", 5, "s3", "list", None, ("c",)),
        ("o", 7, "s1", "list", None, ("d",)),
        ("x", 3, "s1", "list", None, ("other owner",)),
    ]


PROMPTS = "session string, at timestamp, seq long, kind string, query string, found boolean"


def test_injections_are_capped_and_not_repeated(spark, tmp_path):
    at = lambda m: AT + dt.timedelta(minutes=m)
    run = lambda rows: sorted((r.session, r.seq) for r in stream(spark, tmp_path, "inject", rows, PROMPTS, S.injections).collect())
    assert run([("s", at(0), 0, "prompt", "a", True), ("s", at(1), 1, "prompt", "a", True), ("s", at(2), 2, "prompt", "b", False), ("t", at(2), 0, "prompt", "a", True)]) == [("s", 0), ("t", 0)]
    assert run([("s", at(3), 3, "prompt", "b", True), ("s", at(4), 4, "prompt", "c", True), ("s", at(5), 5, "prompt", "d", True)])[:3] == [("s", 0), ("s", 4), ("s", 5)]
    third = run([("s", at(6), 6, "prompt", "e", True), ("s", at(7), 7, "prompt", "f", True), ("s", at(40), 8, "prompt", "g", True)])
    assert third == [("s", 0), ("s", 4), ("s", 5), ("s", 6), ("t", 0)]
    # later than the watermark: dropped, whatever it would have started
    assert run([("s", at(1), 9, "start", None, False), ("s", at(41), 10, "prompt", "h", True)]) == third
    assert run([("s", at(42), 11, "start", None, False), ("s", at(43), 12, "prompt", "h", True)]) == sorted([*third, ("s", 12)])
    # a day without events: a timer forgets the session
    run([("t", at(3 * 24 * 60), 1, "prompt", "z", True)])
    assert ("s", 13) in run([("s", at(3 * 24 * 60 + 1), 13, "prompt", "h", True)])


def test_rules_over_a_table(spark):
    rows = [("s", AT + dt.timedelta(minutes=i), i, "prompt", q, True) for i, q in enumerate("aabcdef")] + [("t", AT, 0, "prompt", "x", False)]
    rule = lambda s, e: [(e["seq"],)] if S.injection_event(s, e["kind"], e["query"], e["found"]) else []
    got = S.batch(spark.createDataFrame(rows, PROMPTS), "session", S.Injections, rule, "session string, seq long").collect()
    assert sorted(map(tuple, got)) == [("s", 0), ("s", 2), ("s", 3), ("s", 4)]
