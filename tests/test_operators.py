"""Operators on small tables, at the boundaries that their semantics name."""

import datetime as dt
import random

import numpy as np
import pytest
from lorekeep.operators import access, cards, context, corpus, evaluate, lifecycle, rank, select, stats, vector
from lorekeep.plans import catalogue, oracle, views
from lorekeep.schema import MEMORY, Config, with_defaults
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1)


def memories(spark, *rows):
    """Rows of keyword dictionaries; the rest is null or the default."""
    names = [p.split(" ", 1)[0] for p in MEMORY.split(", ")]
    base = {"created_at": DAY, "updated_at": DAY, "project": "p", "document": "x"}
    return with_defaults(spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], MEMORY))


def test_cosine(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([], [], 0.0), ([1.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0), ([float("nan"), 1.0], [1.0, 1.0], 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<double>, b array<double>")
    got = [r.c for r in df.select("i", vector.cosine("a", "b").alias("c")).orderBy("i").collect()]
    assert got == [c for *_, c in cases]


def test_fusion(spark):
    v = spark.createDataFrame([(1, "both", 0.1, 0), (1, "v2", 0.2, 1), (1, "v3", 0.3, 2)], "query_id int, id string, distance double, rank int")
    t = spark.createDataFrame([(1, "both", 9.0, 0), (1, "t2", 8.0, 1)], "query_id int, id string, score double, rank int")
    got = {r.id: r.fused for r in rank.fuse(v, t, digits=None).collect()}
    assert got["both"] == pytest.approx(1.0) and got["v2"] == pytest.approx(2 * got["t2"]) and got["v3"] == pytest.approx((10 / 12) / 1.5)


@pytest.mark.parametrize(
    ("hits", "distance", "other", "topics", "shown"),
    [(2, 0.18, False, 2, True), (2, 0.19, False, 2, False), (1, 0.13, False, 1, True), (1, 0.14, False, 1, False), (0, 0.21, True, 2, True), (0, 0.22, True, 2, False), (0, 0.1, True, 1, False), (3, None, True, 3, False)],
)
def test_on_topic(spark, hits, distance, other, topics, shown):
    value = rank.on_topic(F.lit(hits), F.lit(distance).cast("double"), F.lit(other), F.lit(topics))
    assert spark.range(1).select(value.alias("x")).first().x is shown


def test_neighbours_are_those_of_the_whole_session(spark):
    turn = {"chunk_type": "auto_log", "source": "h.transcript", "session_id": "s"}
    rows = [turn | {"id": i, "event_id": i, "created_at": DAY + dt.timedelta(minutes=k)} for k, i in enumerate("abcd")]
    rows.append({"id": "saved", "chunk_type": "manual"})
    fused = spark.createDataFrame([(1, "b", 1.0), (1, "saved", 0.9), (1, "a", 0.5), (1, "d", 0.2)], "query_id int, id string, fused double")
    got = {r.id: r.fused for r in rank.neighbour_bonus(fused, memories(spark, *rows)).collect()}
    assert got == pytest.approx({"a": 0.65, "b": 1.075, "d": 0.2, "saved": 0.9})


def test_final_score_parts(spark):
    def score(fused, ratio, importance, kind, days):
        at = F.lit(DAY).cast("timestamp_ntz")
        return spark.range(1).select(rank.final_score(F.lit(fused), F.lit(ratio), F.lit(importance), F.lit(kind), at, F.timestamp_add("DAY", F.lit(days), at)).alias("x")).first().x

    assert score(1.0, 0.0, "log", "filtered", 0) == pytest.approx(0.049)
    assert score(1.0, 1.0, "knowledge", "manual", 0) == pytest.approx(0.10 + 0.08 + 0.10 + 0.10)
    assert score(0.0, 0.0, "log", "auto_log", 100) == pytest.approx(-0.05 - 0.30)
    assert score(0.0, 0.0, "decision", "consolidated", -5) == pytest.approx(0.08)


def plain_mmr(items, weight, n):
    """Greedy choice with plain loops."""
    left = sorted(items, key=lambda x: (-x[1], x[0]))
    low, high = left[-1][1], left[0][1]
    norm = lambda s: 1.0 if abs(high - low) < 1e-9 else (s - low) / (high - low)

    def cos(a, b):
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a is not None and b is not None else 0.0

    out = [left.pop(0)]
    while left and len(out) < n:
        near = lambda x: 1.0 if x[2] is None else max([0.0, *(cos(x[2], o[2]) for o in out)])
        best = max(left, key=lambda x: round(weight * norm(x[1]) - (1 - weight) * near(x), 9))
        left.remove(best)
        out.append(best)
    return [x[0] for x in out]


def test_mmr(spark):
    same, other = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, "a", 1.0, same, 3), (1, "b", 0.99, same, 3), (1, "c", 0.98, same, 3), (1, "d", 0.80, other, 3)]
    df = spark.createDataFrame(rows, "query_id int, id string, score double, embedding array<double>, n int")
    pick = lambda w: [r.id for r in select.mmr(df, w).orderBy("rank").collect()]
    assert pick(0.99) == ["a", "b", "c"] and "d" in pick(0.5)
    r = random.Random(5)
    many = [(q, f"i{k}", round(r.random(), 3), None if r.random() < 0.2 else [r.gauss(0, 1) for _ in range(4)], 8) for q in range(4) for k in range(30)]
    got = select.mmr(spark.createDataFrame(many, df.schema), 0.6).orderBy("query_id", "rank").collect()
    for q in range(4):
        assert [x.id for x in got if x.query_id == q] == plain_mmr([(i, s, v) for p, i, s, v, _ in many if p == q], 0.6, 8)


def test_diversify_takes_half_from_one_project(spark):
    rows = [(1, f"i{k}", "p" if k < 5 else f"q{k}", 1 - k / 10, 4) for k in range(8)]
    df = spark.createDataFrame(rows, "query_id int, id string, project string, score double, n int")
    got = [r.id for r in select.diversify(df, [F.desc("score"), "id"]).orderBy("rank").collect()]
    assert got == ["i0", "i1", "i5", "i6"]


def test_admission_budget(spark):
    rows = [(1, f"v{k}", 1 - k / 10, 0.3, None, 0.0, ["a", "b"]) for k in range(5)] + [(1, "t", 0.1, 0.9, 2.0, 0.5, ["a", "b"]), (2, "v", 1.0, 0.3, None, 0.0, ["a"]), (1, "far", 0.99, 0.71, None, 0.0, ["a", "b"])]
    df = spark.createDataFrame(rows, "query_id int, id string, fused double, listed_distance double, text_score double, ratio double, words array<string>")
    assert sorted(r.id for r in rank.admitted(df).collect()) == ["t", "v0", "v1", "v2"]


def test_age_rules(spark):
    turn = {"chunk_type": "auto_log", "source": "h.transcript", "event_id": "e"}
    rows = memories(
        spark,
        {"id": "log"},
        {"id": "turn"} | turn,
        {"id": "kept", "importance": "decision"},
        {"id": "pinned", "pinned": True},
        {"id": "filtered", "chunk_type": "filtered"},
        {"id": "saved", "chunk_type": "manual"},
        {"id": "policy", "project": "q", "pinned": True},
    )
    policy = spark.createDataFrame([("q", 20)], "project string, days int")
    at = lambda days: F.timestamp_add("DAY", F.lit(days), F.lit(DAY).cast("timestamp_ntz"))
    found = lambda days: {r.id: r.reason for r in lifecycle.expired(rows, at(days), policy).collect()}
    assert found(7) == {} and found(8) == {"filtered": "kind"}
    assert found(20) == {"filtered": "kind", "policy": "policy"}
    assert found(31) == {"filtered": "kind", "policy": "policy", "log": "kind"}
    assert "log" not in {r.id for r in lifecycle.expired(rows, at(99), policy, None).collect()}


def test_trash_restore_purge(spark):
    rows = memories(spark, {"id": "a"}, {"id": "b", "project": "_superseded", "scope_project": "p"}, {"id": "t", "chunk_type": "auto_log", "source": "h.transcript", "event_id": "e"})
    ids = rows.select("id")
    gone = lifecycle.trash(rows, ids, F.lit(DAY).cast("timestamp_ntz"))
    assert {r.project for r in gone.collect()} == {"_trash"}
    assert lifecycle.trash(gone, ids, F.lit(DAY + dt.timedelta(1)).cast("timestamp_ntz")).select("trashed_at").distinct().count() == 1
    back = {r.id: (r.project, r.original_project) for r in lifecycle.restore(gone, ids).collect()}
    assert back == {"a": ("p", None), "b": ("_superseded", None), "t": ("p", None)}
    left, tombstones = lifecycle.purge(gone, ids)
    assert left.count() == 0 and [r.id for r in tombstones.collect()] == ["t"]
    assert lifecycle.purge(rows, ids)[0].count() == 3


def test_remember(spark):
    note = {"chunk_type": "manual", "importance": "knowledge"}
    stored = memories(spark, note | {"id": "old", "document": "same text"}, {"id": "seen", "project": "_trash"})
    incoming = memories(
        spark,
        note | {"id": "n1", "document": " same text "},
        note | {"id": "n2", "document": "new text"},
        note | {"id": "n3", "document": "new text", "created_at": DAY + dt.timedelta(1)},
        note | {"id": "n4", "document": "same text", "project": "other"},
        note | {"id": "n5", "document": "same text", "confidence": 0.5},
        {"id": "seen"},
        {"id": "dead"},
        {"id": "e", "document": "  "},
    )
    tombs = spark.createDataFrame([("dead",)], "id string")
    got = {r.id: (r.status, r.existing_id) for r in lifecycle.remember(stored, incoming, tombs).collect()}
    assert got == {
        "n1": ("deduplicated", "old"),
        "n2": ("succeeded", None),
        "n3": ("deduplicated", "n2"),
        "n4": ("succeeded", None),
        "n5": ("succeeded", None),
        "seen": ("deduplicated", "seen"),
        "dead": ("deduplicated", "dead"),
        "e": ("failed", None),
    }


def test_prune_needs_a_bound(spark):
    rows = memories(spark, *({"id": str(k), "created_at": DAY + dt.timedelta(days=k)} for k in range(5)), {"id": "pin", "pinned": True})
    assert lifecycle.prune_victims(rows, "p").count() == 0
    assert sorted(r.id for r in lifecycle.prune_victims(rows, "p", 2).collect()) == ["0", "1", "2"]
    assert sorted(r.id for r in lifecycle.prune_victims(rows, "p", 2, F.lit(DAY + dt.timedelta(1)).cast("timestamp_ntz")).collect()) == ["0"]


def test_metrics(spark):
    df = spark.createDataFrame([(["x", "a", "b", "a"], ["a", "b"]), (["x"], ["a"])], "ranked array<string>, relevant array<string>")
    a, b = evaluate.ranking_metrics(df, (1, 2, 3)).collect()
    assert a.first_rank == 2 and a.reciprocal_rank == 0.5 and (a.any_1, a.any_2, a.all_2, a.all_3) == (0, 1, 0, 1)
    assert a.fraction_2 == 0.5 and a.ndcg_3 == pytest.approx((1 / np.log2(3) + 1 / np.log2(4)) / (1 + 1 / np.log2(3)))
    assert b.first_rank is None and b.reciprocal_rank == 0 and b.ndcg_3 == 0


def test_nearest_rank(spark):
    five = spark.createDataFrame([("a", float(x)) for x in (5, 1, 3, 2, 4)], "g string, x double")
    assert evaluate.nearest_rank(five, ["g"], "x", (0.5,)).first().p50 == 3
    hundred = spark.createDataFrame([("a", float(x)) for x in range(1, 101)], "g string, x double")
    assert evaluate.nearest_rank(hundred, ["g"], "x", (0.95,)).first().p95 == 95


def test_sample_has_its_size(spark):
    rows = spark.createDataFrame([(str(i), i % 3 if i < 90 else 3) for i in range(100)], "key string, stratum int")
    assert evaluate.stratified_sample(rows, 17, "stratum", "key").count() == 17
    assert evaluate.stratified_sample(rows, 500, "stratum", "key").count() == 100


def test_pack_stops_at_the_first_line_too_long(spark):
    rows = [(1, 1, "p", "a" * 50), (1, 2, "p", "b" * 500), (1, 3, "p", "c")]
    df = spark.createDataFrame(rows, "query_id int, rank int, project string, document string")
    got = context.context_pack(df, 150).first()
    assert got.lines == 1 and got.text.endswith("\n…") and "c" * 2 not in got.text.split("\n")[-2]
    assert context.context_pack(df, 5000).first().lines == 3


def test_vault(spark):
    key, other = (F.lit(bytes([n]) * 32) for n in (1, 2))
    sealed = access.sealed(spark.createDataFrame([("k", "note", "value", "n")], "name string, kind string, value string, note string"), key)
    assert sealed.first().ciphertext.startswith("$enc2$")
    assert access.opened(sealed, key).first().value == "value"
    assert access.opened(sealed, other).first().value is None
    assert access.opened(sealed.withColumn("name", F.lit("moved")), key).first().value is None
    assert access.opened(sealed.withColumn("ciphertext", F.lit("value")), key).first().value is None
    assert "value" not in access.listed(sealed).columns


def test_policies():
    good = {"principals": [{"id": "a", "token_sha256": "0" * 64, "admin": True}, {"id": "b", "token_sha256": "1" * 64, "read_projects": ["p"], "write_projects": ["p"]}], "retention_days": {"p": 30}}
    assert access.policy_problems(good) == []
    bad = {"principals": [{"id": "a", "token_sha256": "0" * 64, "write_projects": ["p"]}] * 2, "retention_days": {"p": 0}}
    assert {"no administrator", "id given twice", "writes what it can't read", "retention days"} <= set(access.policy_problems(bad))


def test_cards(spark):
    lines = [f"- 2024-01-01 00:00 {'x' * 980}{k}" for k in range(12)]
    text = f"body\n\n{cards.LOG}\n" + "\n".join(lines)
    df = spark.createDataFrame([("T", text)], "title string, text string")
    said = spark.createDataFrame([("T", DAY, "last\nword")], "title string, at timestamp_ntz, message string")
    got = cards.appended(df, said).first().text
    kept = got.split(cards.LOG + "\n")[1].split("\n")
    assert kept[0] == cards.TRIMMED and kept[-1] == "- 2024-01-01 00:00 last word" and sum(len(x) + 1 for x in kept[1:]) <= cards.LOG_MAX
    body = spark.createDataFrame([("real\n ## User's own words\nfake",)], "b string").select(cards.own_body(F.col("b")).alias("x")).first().x
    assert body == "real"


def test_scopes(spark):
    spaces = spark.createDataFrame([("w1", "shared"), ("w2", "shared"), ("w3", "alone"), ("w4", None)], "workspace_id string, legacy_project string")
    got = {}
    for r in corpus.workspace_scope(spaces, spaces).collect():
        got.setdefault(r.workspace_id, set()).add(r.project)
    assert got == {"w1": {"w1", "playbook"}, "w2": {"w2", "playbook"}, "w3": {"w3", "alone", "playbook"}, "w4": {"w4", "playbook"}}


def test_scope_comes_before_rank(spark):
    rows = [{"id": f"n{k}", "project": "other", "document": "needle needle needle"} for k in range(30)] + [{"id": "target", "document": "a needle in here"}]
    asked = spark.createDataFrame([(1, "needle", ["p"])], "query_id int, text string, scope array<string>")
    from lorekeep.operators.bm25 import text_top

    assert [r.id for r in text_top(asked, memories(spark, *rows), 1).collect()] == ["target"]


def test_results_do_not_depend_on_partitions(spark):
    want = [tuple(r) for r in catalogue.QUERIES["hybrid_search"](spark, DATA).orderBy("query_id", "rank").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = [tuple(r) for r in catalogue.QUERIES["hybrid_search"](spark, DATA).orderBy("query_id", "rank").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_home_project_needs_three(spark):
    rows = [(1, "a")] * 3 + [(1, "playbook")] * 9 + [(2, "b")] * 2
    assert [tuple(r) for r in stats.home_project(spark.createDataFrame(rows, "query_id int, project string")).collect()] == [(1, "a")]


def test_every_oracle_has_a_query():
    assert set(oracle.ORACLES) <= set(catalogue.QUERIES)
    assert views.AS_OF.startswith("2024") and Config().mmr_lambda == 0.5


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ('"red fox"', {"a"}),
        ('"fox red"', set()),
        ("+fox dog", {"a", "c"}),
        ("fox -lazy", {"a"}),
        ('fox -"lazy fox"', {"a"}),
        ("fox AND dog", {"c"}),
        ('"red fox', {"a", "b", "c"}),
        ("fox:", {"a", "c"}),
        ("(fox", {"a", "c"}),
        ('"..."', set()),
        ("", set()),
    ],
)
def test_query_syntax(spark, query, found):
    from lorekeep.operators.bm25 import text_top

    rows = memories(spark, {"id": "a", "document": "A red fox."}, {"id": "b", "document": "red dog"}, {"id": "c", "document": "lazy fox, dog"})
    asked = spark.createDataFrame([(1, query, [])], "query_id int, text string, scope array<string>")
    assert {r.id for r in text_top(asked, rows, 10, syntax=True).collect()} == found


def test_same_subject_without_topics(spark, monkeypatch):
    """Notes without a keyword have no share of common ones; blocks of any size find the same."""
    near = lambda x: [1.0, x]
    rows = memories(spark, *({"id": f"n{i}", "document": d, "chunk_type": "manual", "embedding": near(x)} for i, (d, x) in enumerate([("", 0.0), ("so ok", 0.9), ("red fox", 1.0), ("red fox runs", 0.05), ("the", -0.1)])))
    c = Config(same_subject=0.01, same_subject_shared=0.4, shared_keywords=0.5)
    found = lambda **k: sorted(tuple(r)[:2] + (r.place,) for r in context.same_subject(rows, rows, c, **k).collect())
    want = [("n0", "n3", 1), ("n0", "n4", 2), ("n1", "n2", 1), ("n2", "n1", 1), ("n2", "n3", 2), ("n3", "n0", 1), ("n3", "n2", 2), ("n4", "n0", 1)]
    assert found() == want
    if hasattr(context, "BLOCK"):
        monkeypatch.setattr(context, "BLOCK", 2)
    assert found(newest=None) == want


def test_card_log_of_many_messages(spark):
    """Work grows with the messages, not with their square; the log is what a plain loop keeps."""
    n = 30_000
    said = spark.range(n).select((F.col("id") % 2).cast("string").alias("title"), F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(DAY)).alias("at"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).otherwise("").alias("message"))
    cards_of = spark.createDataFrame([("0", "a"), ("1", "b"), ("2", "c")], "title string, text string")
    got = {r.title: r.text for r in cards.appended(cards_of, said).collect()}
    for title in (0, 1):
        lines = [f"- {DAY + dt.timedelta(seconds=i):%Y-%m-%d %H:%M} " + "x" * (i % 50 if title == 0 else 0) for i in range(title, n, 2)]
        kept, size = [], 0
        for x in reversed(sorted(enumerate(lines), key=lambda p: p[0])):
            size += len(x[1]) + 1
            if size > cards.LOG_MAX:
                break
            kept.insert(0, x[1])
        assert got[str(title)] == f"{'ab'[title]}\n\n{cards.LOG}\n" + "\n".join([cards.TRIMMED, *kept])
    assert got["2"] == "c"
