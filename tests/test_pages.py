"""Pages with neighbours, provenance, approaches, context packs with hints; half-precision vectors; snapshots."""

import datetime as dt

import numpy as np
import pytest
from lorekeep.functions import half
from lorekeep.operators import context, page
from lorekeep.sources import jsonl
from pyspark.sql import functions as F

from test_operators import DAY, memories

ASKED = "asked_id string, id string, offset int, max_chars int, before int, after int"


def talk(spark, texts, **more):
    turn = {"chunk_type": "auto_log", "source": "h.transcript", "session_id": "s", "cwd": "/w"}
    return memories(spark, *(turn | {"id": f"t{i}", "event_id": f"e{i}", "document": t, "created_at": DAY + dt.timedelta(minutes=i)} | more for i, t in enumerate(texts)), {"id": "alone", "document": "saved note", "chunk_type": "manual"})


def test_one_budget_for_a_page_and_its_neighbours(spark):
    rows = talk(spark, ["0" * 10, "1" * 10, "2" * 10, "3" * 10, "é" * 10])
    asked = [
        ("all", "t2", 0, None, 2, 2),
        ("cut", "t2", 4, 13, 2, 1),  # 6 of its own, 7 of the oldest before it, nothing for the rest
        ("far", "t2", 99, 5, 0, 2),  # beyond the end: the budget goes to the turns after it
        ("own", "t4", 3, 4, 0, 5),
        ("alone", "alone", 0, 100, 5, 5),
        ("none", "nobody", 0, 5, 0, 0),
        ("bad", "t2", 0, 30_001, 0, 0),
        ("zero", "t2", 0, 0, 0, 0),
        ("wide", "t2", 0, 5, 6, 0),
        ("blank", " ", 0, 5, 0, 0),
    ]
    df = spark.createDataFrame(asked, ASKED)
    got = {}
    for r in page.pages(df, rows).orderBy("asked_id", "place").collect():
        got.setdefault(r.asked_id, []).append((r.part, r.id, r.document, r.has_more, r.next_offset, r.truncated))
        assert r.doc_len == 10 and r.returned_chars == len(r.document) and r.total_returned_chars == {"all": 50, "cut": 13, "far": 5, "own": 4, "alone": 10}[r.asked_id]
    assert set(got) == {"all", "cut", "far", "own", "alone"}
    assert [x[:3] for x in got["all"]] == [(p, f"t{i}", c * 10) for p, i, c in (("before", 0, "0"), ("before", 1, "1"), ("page", 2, "2"), ("after", 3, "3"), ("after", 4, "é"))]
    assert got["cut"] == [("before", "t0", "0" * 7, True, 7, True), ("before", "t1", "", True, 0, True), ("page", "t2", "2" * 6, False, None, True), ("after", "t3", "", True, 0, True)]
    assert got["far"] == [("page", "t2", "", False, None, True), ("after", "t3", "3" * 5, True, 5, True), ("after", "t4", "", True, 0, True)]
    assert got["own"] == [("page", "t4", "é" * 4, True, 7, True)] and got["alone"] == [("page", "alone", "saved note", False, None, False)]
    assert {(r.asked_id, r.problem) for r in page.problems(df).collect()} == {("bad", "max_chars"), ("zero", "max_chars"), ("wide", "neighbours"), ("blank", "id")}


def test_provenance_has_a_budget_of_its_own(spark):
    rows = memories(spark, {"id": "a", "session_id": "s" * 2000, "source": "x" * 100, "cwd": "/w", "role": None, "source_ids": ["i1"], "sequence": 3}, {"id": "b", "session_id": "s", "source_ids": [f"i{n}" for n in range(17)], "cwd": "token = abcdefgh12345678"}, {"id": "c"})
    got = {r.id: r.p for r in rows.select("id", page.provenance().alias("p")).collect()}
    a = got["a"]
    assert len(a.session_id) == 2000 and a.source == "x" * 48 and a.cwd == "" and a.role is None and a.source_ids == [""] and a.sequence == 3 and a.truncated
    assert got["b"].source_ids == [f"i{n}" for n in range(16)] and got["b"].truncated and "abcdefgh" not in got["b"].cwd
    assert not got["c"].truncated and got["c"].session_id == ""


def test_approaches_are_bounded(spark):
    kind = "struct<status:string,applicability:string,evidence:string>"
    df = spark.createDataFrame([(0, ("worked", "a" * 300, "e" * 10)), (1, ("failed", "short", " ")), (2, None), (3, ("worked", "key: password = hunter2hunter2", None))], f"i int, approach {kind}")
    got = {r.i: (r.s, r.w) for r in df.select("i", page.approach_view(summary=True).alias("s"), page.approach_view().alias("w")).collect()}
    assert len(got[0][0].applicability) == 256 and got[0][0].truncated and len(got[0][1].applicability) == 300 and not got[0][1].truncated
    assert got[1][0].evidence_status == "not_provided" and got[0][0].evidence_status == "provided_unverified" and got[2] == (None, None)
    assert "hunter2" not in got[3][0].applicability and got[3][0].evidence == ""


def test_room_for_a_hint_is_kept(spark):
    results = spark.createDataFrame([(q, r, "p", "x" * 30) for q in (1, 2, 3) for r in (1, 2, 3)], "query_id int, rank int, project string, document string")
    hints = spark.createDataFrame([(1, "see <q>"), (2, "y" * 500)], "query_id int, hint string")
    full = {r.query_id: r for r in context.context_pack(results, 100).collect()}
    got = {r.query_id: r for r in context.context_pack(results, 100, hints=hints).collect()}
    assert full[1].lines == 2 and got[1].lines == 1 and got[1].text.split("\n")[-1] == "see &lt;q&gt;" and "…" in got[1].text
    assert got[2].text == full[2].text and got[3].text == full[3].text  # a hint that can't fit is left out
    named = spark.createDataFrame([(1, 2, "b", 1), (1, 1, "a", 3)], "query_id int, place int, project string, hits long")
    assert context.hint_lines(named).first().hint.endswith("a (3), b (1)")


def test_half_precision(spark):
    every = np.arange(1 << 16, dtype=np.uint16).view(np.float16)
    same = every[~np.isnan(every)]
    assert (half.decoded(half.encoded(same.astype(np.float32))) == same.astype(np.float32)).all()
    # ties go to the even one; what is too small becomes zero, too large infinite
    odd = np.array([1 + 2**-11, 1 + 3 * 2**-11, 2**-25, 3 * 2**-26, 65519.0, 65520.0, -1e9, 2**-24], np.float32)
    assert half.decoded(half.encoded(odd)).tolist() == odd.astype(np.float16).astype(np.float32).tolist()
    rows = [(0, [1.0, -2.5, 1e-7]), (1, []), (2, None), (3, [float(x) for x in np.linspace(-3, 3, 64)]), (4, [1.0, None])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    got = {r.i: r.w for r in df.select("i", half.decode(half.encode("v")).alias("w")).collect()}
    for i, v in rows:
        assert got[i] == (None if v is None or None in v else [float(np.float16(np.float32(x))) for x in v])
    raw = {r.i: r.b for r in df.select("i", half.encode("v").alias("b")).collect()}
    assert len(raw[3]) == 128 and raw[1] == b"" and spark.createDataFrame([(b"\x01",)], "b binary").select(half.decode("b").alias("w")).first().w is None


def test_snapshots_are_checked_before_they_are_restored(spark, tmp_path):
    path, table = str(tmp_path / "backup"), str(tmp_path / "table")
    first = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "id long, document string").repartition(3)
    jsonl.snapshot(first, path)
    assert jsonl.verify(spark, path) == []
    jsonl.restore(spark, path, table)
    assert spark.read.parquet(table).count() == 100
    jsonl.snapshot(first.where("id < 10"), path)  # a later one takes its place
    part = next(p for p in (tmp_path / "backup").glob("part-*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[: len(whole) // 2])
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert jsonl.verify(spark, path)
    with pytest.raises(ValueError, match=part.name):
        jsonl.restore(spark, path, table)
    assert spark.read.parquet(table).count() == 100  # what was there stays readable
    part.write_bytes(whole)
    jsonl.restore(spark, path, table)
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == list(range(10))
    (part.parent / "part-extra.parquet").write_bytes(whole)
    assert any("part-extra" in p for p in jsonl.verify(spark, path))
    part.unlink()
    assert any(part.name in p for p in jsonl.verify(spark, path))
