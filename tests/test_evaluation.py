"""Question sets as tables, and result lists as lists of turns and sessions."""

import hashlib
import json
import random

import pytest
from lorekeep.operators import evaluate
from lorekeep.operators.evaluate import ranking_metrics
from lorekeep.sources import evaluation

DIALOGUES = [
    {
        "sample_id": "c1",
        "conversation": {
            "speaker_a": "Ann",
            "session_2": [{"speaker": "Bo", "dia_id": "D2:1", "text": "later"}],
            "session_1_date_time": "1 May",
            "session_1": [{"speaker": "Ann", "dia_id": "D1:1", "text": "hi", "img": ["x"]}, {"speaker": "Bo", "dia_id": "D1:2", "text": "yes"}],
            "session_3_date_time": "none said",
        },
        "qa": [{"question": "who", "category": 1, "evidence": ["D1:2; D:2:01", "D1:2", "D9:9"], "answer": 7}, {"question": "why", "category": 5}],
    }
]
HAYSTACKS = [
    {
        "question_id": "q1",
        "question_type": "temporal",
        "question": "when",
        "answer": "now",
        "haystack_session_ids": ["b", "a", "b"],
        "haystack_dates": ["d1", "d2", "d3"],
        "haystack_sessions": [[{"role": "user", "content": "x"}, {"role": "assistant", "content": "y", "has_answer": True}], [{"role": "user", "content": "z", "has_answer": True}], [{"role": "user", "content": "again", "has_answer": True}]],
        "answer_session_ids": ["b", "a"],
    },
    {"question_id": "q2_abs", "question_type": "t", "question": "no", "haystack_session_ids": [], "haystack_dates": [], "haystack_sessions": [], "answer_session_ids": []},
]


@pytest.fixture
def files(tmp_path):
    for name, data in (("d", DIALOGUES), ("h", HAYSTACKS)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    return tmp_path


def test_dialogues(spark, files):
    turns, questions = evaluation.dialogues(spark, str(files / "d.json"), dated=True)
    assert sorted(map(tuple, turns.collect())) == [
        ("dialogue-0-c1", "D1:1", "session_1", 0, None, "[1 May] Ann said: hi"),
        ("dialogue-0-c1", "D1:2", "session_1", 1, None, "[1 May] Bo said: yes"),
        ("dialogue-0-c1", "D2:1", "session_2", 0, None, "[] Bo said: later"),
    ]
    assert sorted(map(tuple, questions.collect())) == [("dialogue-0-c1", "c1#0", "who", "multi-hop", ["D1:2", "D2:1"]), ("dialogue-0-c1", "c1#1", "why", "adversarial", [])]


def test_haystacks(spark, files):
    turns, questions = evaluation.haystacks(spark, str(files / "h.json"))
    assert sorted(r.key + " " + r.text for r in turns.collect()) == ["a#0 User said: z", "b#0 User said: x", "b#1 Assistant answered: y"]
    got = {r.question_id: (r.relevant, r.relevant_sessions, r.abstention, r.category) for r in questions.collect()}
    assert got == {"q1": (["b#1", "a#0"], ["b", "a"], False, "temporal"), "q2_abs": ([], [], True, "t")}


def test_pinned_files(spark, files):
    raw = (files / "d.json").read_bytes()
    digest = hashlib.sha256(raw).hexdigest()
    assert tuple(evaluation.provenance(spark, str(files / "d.json"), digest).first()) == ("d.json", len(raw), digest)
    with pytest.raises(Exception, match="pinned revision"):
        evaluation.provenance(spark, str(files / "d.json"), "0" * 64).collect()


def test_results_as_turns_and_sessions(spark):
    results = spark.createDataFrame([(1, 0, "m2"), (1, 1, "zz"), (1, 2, "m1"), (1, 3, "m3"), (2, 0, "m3")], "query_id int, rank int, id string")
    stored = spark.createDataFrame([("m1", "a#0", "a"), ("m2", "b#1", "b"), ("m3", "a#1", "a")], "id string, key string, session string")
    got = {r.query_id: r for r in evaluation.ranked_keys(results, stored).collect()}
    assert got[1].ranked == ["b#1", "unknown:zz", "a#0", "a#1"] and got[1].ranked_sessions == ["b", "unknown", "a"] and got[2].ranked_sessions == ["a"]
    judged = evaluation.ranked_keys(results, stored).where("query_id = 1").selectExpr("query_id", "ranked_sessions as ranked", "array('a') as relevant")
    assert ranking_metrics(judged, (1, 3)).first().first_rank == 3


def test_token_overlap_counts_within_tasks(spark):
    """What is shuffled doesn't grow with pairs of queries and documents; rows of one id count as one, as in the SQL."""
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("12345") for _ in range(n))
    asked = [(i, said(6)) for i in range(40)] + [(40, "none"), (41, None), (3, said(6)), (42, "A1 a1, b2")]
    docs = [(f"d{i}", said(rng.choice((0, 5, 40)))) for i in range(1500)] + [("d7", said(30)), ("d7", said(30)), ("d9", None), ("e", "x" * 41 + " a1")]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    memories = spark.createDataFrame(docs, "id string, document string").repartition(3)
    words = lambda rows: {k: set().union(*((t or "").lower().replace(",", " ").split() for j, t in rows if j == k)) for k, _ in rows}
    terms, held = words(asked), words(docs)
    want = set()
    for q, own in terms.items():
        best = sorted((-len(own & has), i) for i, has in held.items() if own & has)[:5]
        want |= {(q, rank, i, -less) for rank, (less, i) in enumerate(best, 1)}
    found = evaluate.token_overlap(queries, memories)
    assert found.schema.simpleString() == "struct<query_id:int,rank:int,id:string,shared:bigint>"
    assert {tuple(r) for r in found.collect()} == want
    # of a query a task sends on its best alone, so no aggregate of pairs is left
    assert evaluate._shared(queries.selectExpr("query_id", "split(text, ' ') AS terms").where("query_id < 3").collect()[:3], memories.selectExpr("id", "split(document, ' ') AS tokens").coalesce(1), 5).count() == 15
    assert evaluate.token_overlap(queries.where("query_id = 41"), memories).collect() == []
