"""Upkeep, bounded batches, validators, open metadata, embedding sources."""

import datetime as dt
import json

import numpy as np
import pytest
from lorekeep.functions import metadata
from lorekeep.functions.text import is_safe_path, is_transcript_id, substantive
from lorekeep.operators import lifecycle
from lorekeep.plans import catalogue
from lorekeep.sources import jsonl
from lorekeep.sources.embedding import Embedder, embedding
from lorekeep.streaming.maintain import maintain, upkeep
from pyspark.sql import functions as F

from test_operators import DAY, memories


def at(days):
    return F.lit(str(DAY + dt.timedelta(days=days))).cast("timestamp_ntz")


def test_upkeep_is_the_same_twice(spark):
    rows = memories(
        spark,
        {"id": "log"},
        {"id": "turn", "project": "_trash", "event_id": "e", "source": "h.transcript", "scope_project": "p", "original_project": "p", "trashed_at": DAY},
        {"id": "fresh", "project": "_trash", "trashed_at": DAY + dt.timedelta(days=30)},
        {"id": "note", "chunk_type": "manual", "importance": "knowledge"},
        {"id": "policy", "project": "q", "chunk_type": "manual", "pinned": True},
    )
    jobs = spark.createDataFrame([("old", "done", DAY), ("new", "done", DAY + dt.timedelta(days=39))], "job_id string, state string, updated_at timestamp_ntz")
    policy = spark.createDataFrame([("q", 5)], "project string, days int")
    done = upkeep(rows, jobs, policy, at(40))
    assert {(r.id, r.project) for r in done.memories.collect()} == {("log", "_trash"), ("fresh", "_trash"), ("note", "p"), ("policy", "_trash")}
    assert [r.id for r in done.tombstones.collect()] == ["turn"] and {r.id for r in done.trashed.collect()} == {"log", "policy"}
    again = upkeep(done.memories, done.jobs, policy, at(40))
    assert sorted(map(str, again.memories.collect())) == sorted(map(str, done.memories.collect())) and again.trashed.count() == again.purged.count() == 0
    assert [r.job_id for r in lifecycle.kept_jobs(jobs, at(95)).collect()] == ["new"]


def test_a_pass_runs_once_an_interval(spark, tmp_path):
    source, calls = str(tmp_path / "ticks"), []

    def tick(*seconds, fail=False):
        spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s),) for s in seconds], "at timestamp").coalesce(1).write.mode("append").json(source)

        def run(as_of, slot):
            if fail:
                raise OSError("stopped")
            calls.append((slot, spark.range(1).select(as_of.alias("t")).first().t))

        q = maintain(spark.readStream.schema("at timestamp").json(source), str(tmp_path / "cp"), str(tmp_path / "marks"), run, every=3600)
        if fail:
            with pytest.raises(Exception, match="stopped"):
                q.awaitTermination()
        else:
            q.awaitTermination()

    tick(10, 20)
    tick(30, 3500)
    first = calls[0][0]
    assert [c[0] for c in calls] == [first]
    tick(7300, 3700, fail=True)  # the batch is replayed, and only the newest interval runs
    tick(7400)
    assert [c[0] for c in calls] == [first, first + 2]
    tick(40)  # late
    assert len(calls) == 2


def test_batches_are_bounded_and_permitted(spark):
    rows = memories(spark, {"id": "a"}, {"id": "b", "project": "q"}, {"id": "t", "project": "_trash", "scope_project": "p"}, {"id": "u", "project": "_trash", "scope_project": "q"})
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    aliases = spark.createDataFrame([("old", "t"), ("other", "a")], "alias_id string, canonical_id string")
    table, _, left = lifecycle.purge_batch(rows, ids("t", "a"), aliases)
    assert {r.id for r in table.collect()} == {"a", "b", "u"} and [tuple(r) for r in left.collect()] == [("other", "a")]
    for bad in (ids(), ids(*map(str, range(101)))):
        with pytest.raises(ValueError, match="1 to 100 ids"):
            lifecycle.purge_batch(rows, bad, aliases)
    lifecycle.check_batch(ids(*map(str, range(100)), "5"))
    may = spark.createDataFrame([("p",)], "project string")
    status = lambda *x: {r.id: r.status for r in lifecycle.delete_permitted(rows, ids(*x), may).collect()}
    assert status("a", "t", "none") == {"a": "deleted", "t": "deleted", "none": "not_found"}
    assert status("a", "u", "none") == {"a": "refused", "u": "denied", "none": "refused"} and status() == {}


def test_repeats_count_for_the_first_note(spark):
    rows = memories(spark, {"id": "a", "access_count": 2}, {"id": "b"})
    said = spark.createDataFrame([("x", "deduplicated", "a"), ("y", "deduplicated", "a"), ("b", "deduplicated", "b"), ("z", "succeeded", None)], "id string, status string, existing_id string")
    got = {r.id: (r.access_count, r.updated_at) for r in lifecycle.count_repeats(rows, said, at(3)).collect()}
    assert got == {"a": (4, DAY + dt.timedelta(days=3)), "b": (0, DAY)}


def test_times_have_to_be_rfc_3339(spark):
    good = ["2024-02-29T10:00:00Z", "2024-02-29 10:00:00.123+02:00", "2024-02-29t10:00:00z"]
    bad = ["2024-02-30T10:00:00Z", "2024-02-29T10:00:00", "2024-02-29", "yesterday", ""]
    rows = memories(spark, *({"id": x} for x in [*good, *bad, "none"])).drop("verified_at").withColumn("verified_at", F.when(F.col("id") != "none", F.col("id")))
    assert {(r.id, r.problem) for r in lifecycle.invalid_fields(rows).collect()} == {(x, "verified_at") for x in bad}


def test_evidence_of_another_workspace(spark):
    compared = spark.createDataFrame([("a", "x", "unchanged"), ("a", "y", "missing"), ("b", "x", "unchanged"), ("c", "x", "unavailable"), ("c", "y", "changed"), ("d", "x", "unchanged")], "id string, path string, status string")
    captured = spark.createDataFrame([("a", "w"), ("b", "w"), ("c", "w"), ("d", "v"), ("e", None)], "id string, workspace_id string")
    assert {tuple(r) for r in lifecycle.evidence_status(compared, captured, "w").collect()} == {("a", "changed"), ("b", "unchanged"), ("c", "unavailable"), ("d", "different_workspace"), ("e", "different_workspace")}


def test_shapes(spark):
    paths = {"a/b.c": True, "": False, "/a": False, "a//b": False, "a/../b": False, "a/.GIT/b": False, "a\\b": False, "c:x": False, "a./b": False, "a /b": False, "é" * 129: False, "é" * 128: True, "a\tb": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.ok for r in df.select("p", is_safe_path("p").alias("ok")).collect()} == paths
    row = spark.range(1).select(is_transcript_id(F.lit("transcript_" + "aF" * 16)).alias("a"), is_transcript_id(F.lit("transcript_" + "g" * 32)).alias("b"), substantive(F.lit("thanks a lot, really")).alias("c"), substantive(F.lit("Thank You"), 4, ("thank you",)).alias("d"), substantive(F.lit("/command with words")).alias("e")).first()
    assert tuple(row) == (True, False, True, False, False)


def test_metadata_by_path(spark):
    raw = [(0, '{"a": 1, "unknown": {"deep": [1, {"x": "é"}], "k.1": true}, "b": "t"}'), (1, "no json"), (2, None), (3, "[1]"), (4, '{"unknown": 5}')]
    df = spark.createDataFrame(raw, "i int, raw string").select("i", metadata.parsed("raw").alias("m"))
    new = metadata.set_path("m", ["unknown", "n"], F.parse_json(F.lit('{"z": [null]}')))
    got = {r.i: (json.loads(r.s), r.x, r.k, r.t) for r in df.select("i", metadata.text_of(new).alias("s"), metadata.get_path("m", ["unknown", "k.1"], "boolean").alias("x"), metadata.get_path(new, ["unknown", "n", "z"], "string").alias("k"), metadata.get_path("m", ["a"], "int").alias("t")).collect()}
    assert got[0] == ({"a": 1, "b": "t", "unknown": {"deep": [1, {"x": "é"}], "k.1": True, "n": {"z": [None]}}}, True, "[null]", 1)
    assert all(got[i][0] == {"unknown": {"n": {"z": [None]}}} and got[i][1] is None for i in (1, 2, 3, 4))
    patch = F.parse_json(F.lit('{"a": null, "c": {"new": 1}}'))
    both = {r.i: (json.loads(r.m), json.loads(r.g)) for r in df.select("i", metadata.text_of(metadata.merged("m", patch)).alias("m"), metadata.text_of(metadata.remove_path("m", ["unknown", "deep"])).alias("g")).collect()}
    assert both[0] == ({"b": "t", "c": {"new": 1}, "unknown": json.loads(raw[0][1])["unknown"]}, {"a": 1, "b": "t", "unknown": {"k.1": True}})
    assert both[4] == ({"unknown": 5, "c": {"new": 1}}, {"unknown": 5}) and both[2] == ({"c": {"new": 1}}, {})


def test_unknown_keys_survive_an_import_and_a_patch(spark):
    lines = [json.dumps({"id": "a", "text": "t", "metadata": {"chunk_type": "manual", "unknown": {"x": 1}, "confidence": 0.5}}), json.dumps({"id": "b", "text": "t"})]
    rows = jsonl.imported(spark.createDataFrame([(x,) for x in lines], "value string"), at(0), 2, open_metadata=True)
    rows = rows.withColumn("metadata", metadata.merged("metadata", F.parse_json(F.lit('{"new": true, "confidence": null}'))))
    rows = lifecycle.patch(rows, spark.createDataFrame([("a", "failure")], "id string, category string"))
    got = {r.id: (r.chunk_type, r.category, json.loads(r.m)) for r in rows.select("id", "chunk_type", "category", metadata.text_of("metadata").alias("m")).collect()}
    assert got == {"a": ("manual", "failure", {"chunk_type": "manual", "unknown": {"x": 1}, "new": True}), "b": ("auto_log", "general", {"new": True})}


class Stub:
    """A model whose vectors tell what it was asked."""

    def __init__(self):
        self.asked = []

    def __call__(self, texts):
        self.asked += texts
        return np.array([[len(t), sum(map(ord, t)) % 97] for t in texts])


def test_an_embedder_remembers_the_last_texts():
    stub, loads = Stub(), []
    own = Embedder(lambda: loads.append(1) or stub, "query", cache=2)
    assert own.vectors([None]) == [None] and loads == []
    first = own.vectors(["a", "b", "a", None])
    assert stub.asked == ["query: a", "query: b"] and own.hits == 0 and first[3] is None and (first[0] == first[2]).all()
    own.vectors(["a", "c"])  # a is remembered; c drives out the first in, which is a
    assert own.hits == 1 and stub.asked[2:] == ["query: c"]
    own.vectors(["b", "a"])
    assert own.hits == 2 and stub.asked[3:] == ["query: a"] and loads == [1]


def test_vectors_do_not_depend_on_batches(spark):
    texts = [(i, f"text {i % 7}" if i % 5 else None) for i in range(60)]

    def load():  # sent to the executors as it is
        return lambda asked: [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in asked]

    df = spark.createDataFrame(texts, "i int, t string")
    runs = [{r.i: r.v for r in df.repartition(n).select("i", embedding(load, "passage", 3)("t").alias("v")).collect()} for n in (1, 5)]
    assert runs[0] == runs[1] and runs[0][1] == [len("passage: text 1"), sum(map(ord, "passage: text 1")) % 97] and runs[0][0] is None


def test_every_page_of_a_url_has_a_status(spark, tmp_path):
    spark.createDataFrame([(i, "u" if i < 6 else f"u{i}", None if i == 2 else "x") for i in range(9)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.status: r.files for r in catalogue.QUERIES["evidence_status"](spark, str(tmp_path)).collect()}
    assert got == {"missing": 3, "unavailable": 2, "unchanged": 2, "changed": 2}
