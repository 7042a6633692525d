"""The query syntax against a plain evaluation, and stores that are refreshed against stores that are built."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from lorekeep.functions import grammar, text
from lorekeep.operators import bm25, boolean, materialised, vector
from lorekeep.plans import catalogue
from lorekeep.sources import folders
from pyspark.sql import functions as F

from test_operators import DAY, memories

WORDS = ["red", "fox", "dog", "lazy", "old", "tree", "é", "x1", "don"]


def shown(node):
    """A tree as text: leaves by field, groups by the roles of their parts."""
    if node.text is not None:
        return (node.field[0] + ":" if node.field != grammar.DEFAULT else "") + node.text
    signs = {grammar.MUST: "+", grammar.NOT: "-", grammar.SHOULD: ""}
    return "(" + " ".join(signs[r] + shown(n) for r, n in node.children) + ")" + (f"^{node.boost:g}" if node.boost != 1 else "")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a b", "(a b)"),
        ("a", "a"),
        ("a AND b", "(+a +b)"),
        ("a OR b AND c", "(a (+b +c))"),
        ("a b AND NOT c", "(a (+b -c))"),
        ("(a OR b) AND c", "(+(a b) +c)"),
        ("+a -b c", "(+a -b c)"),
        ("NOT a b", "(-a b)"),
        ('"a b" c', "(a b c)"),
        ("'a b'^2 c", "((+a b)^2 c)"),
        ("project:x AND (id:y z)", "(+p:x +(i:y z))"),
        ("project:(x y) a", "((p:x p:y) a)"),
        ("((a))", "a"),
        ("a-b.c", "a-b.c"),
        ("not a and b", "(not a and b)"),
        *((bad, None) for bad in ("", "  ", '"a', "(a", "a)", "-a", "NOT a", "a AND", "AND a", "a OR OR b", "x:a", "it's", "a:", "a^b", "[a TO b]", "*", "(" * 40 + "a" + ")" * 40, "- a", "12:30", "-a -b")),
    ],
)
def test_trees(text, tree):
    found = grammar.parse(text)
    assert (None if found is None else shown(found)) == tree


def held(node, doc, scores):
    """A plain evaluation: the score of a tree for a document, None if it doesn't hold."""
    if node.text is not None:
        return scores(node, doc)
    total, must, others = 0.0, True, False
    for role, child in node.children:
        value = held(child, doc, scores)
        if role == grammar.NOT:
            must &= value is None
        else:
            must &= value is not None or role == grammar.SHOULD
            others |= value is not None
            total += value or 0.0
    return total * node.boost if must and others else None


def plain(query, docs, k):
    """The best documents of a query, by a loop over all of them."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    toks = {i: split(t) for i, _, t in docs}
    average = sum(map(len, toks.values())) / len(toks)
    idf = lambda n: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5))
    weigh = lambda i, tf, w: w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[i]) / average))

    def scores(node, doc):
        i, project, _ = doc
        if node.field != grammar.DEFAULT:
            at = {"project": 1, "id": 0}[node.field]
            return idf(sum(d[at] == node.text for d in docs)) if doc[at] == node.text else None
        words = split(node.text)
        tf = sum(toks[i][p : p + len(words)] == words for p in range(len(toks[i]) - len(words) + 1)) if words else 0
        return weigh(i, tf, sum(idf(sum(w in t for t in toks.values())) for w in words)) if tf else None

    tree = grammar.parse(query)
    words = set(split(query))
    if tree is None or all(r == grammar.SHOULD and n.text is not None and n.field == grammar.DEFAULT and len(split(n.text)) <= 1 for r, n in tree.children or [(grammar.SHOULD, tree)]):
        tree = grammar.Node([(grammar.SHOULD, grammar.Node(text=w)) for w in words])
    found = [(round(s, 6), d[0]) for d in docs if (s := held(tree, d, scores)) is not None]
    return [(i, s) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))][:k]


def random_query(draw, depth=0):
    parts = []
    for _ in range(draw.randint(1, 3)):
        kind = draw.random()
        if kind < 0.2 and depth < 3:
            part = f"({random_query(draw, depth + 1)})"
        elif kind < 0.4:
            part = '"' + " ".join(draw.choices(WORDS, k=draw.randint(1, 3))) + '"'
        elif kind < 0.5:
            part = draw.choice(["project:p1", "project:p2", "id:d3", "document:fox", "fox-dog"])
        else:
            part = draw.choice(WORDS)
        parts.append(draw.choice(["", "", "", "+", "-", "NOT "]) + part + draw.choice(["", "", "", "^2.5"]))
    return "".join(p + draw.choice([" ", " AND ", " OR "]) for p in parts[:-1]) + parts[-1]


def test_random_trees_equal_a_plain_evaluation(spark):
    draw = random.Random(8)
    docs = [(f"d{i}", f"p{i % 3}", " ".join(draw.choices(WORDS, k=draw.randint(0, 25))) + draw.choice(["", ".", "!"])) for i in range(40)]
    asked = [(i, random_query(draw), ["p1", "p2"] if i % 4 == 3 else []) for i in range(60)]
    df = spark.createDataFrame(asked, "query_id long, text string, scope array<string>")
    rows = memories(spark, *({"id": i, "project": p, "document": t} for i, p, t in docs))
    got = {}
    for r in bm25.text_top(df, rows, 15, syntax=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for i, text, scope in asked:
        want = [x for x in plain(text, docs, 1000) if not scope or dict((d[0], d[1]) for d in docs)[x[0]] in scope][:15]
        assert [x[0] for x in got.get(i, [])] == [x[0] for x in want] and [x[1] for x in got.get(i, [])] == pytest.approx([x[1] for x in want], abs=2e-6), text


def test_words_of_many_queries_in_small_blocks(spark, monkeypatch):
    draw = random.Random(3)
    rows = memories(spark, *({"id": f"d{i}", "project": f"p{i % 3}", "document": " ".join(draw.choices(WORDS, k=12))} for i in range(60)))
    asked = spark.createDataFrame([(i, " ".join(draw.choices(WORDS, k=3)), ["p1"] if i % 2 else []) for i in range(40)], "query_id long, text string, scope array<string>")
    want = bm25.bm25(asked, rows).collect()
    monkeypatch.setattr(bm25, "CELLS", 7)
    got = bm25.text_top(asked, rows, 1000).collect()
    assert sorted((r.query_id, r.id, r.score) for r in got) == sorted((r.query_id, r.id, r.score) for r in want)


# -- stores


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    """Small tables need no more."""
    monkeypatch.setattr(materialised, "BUCKETS", 4)


def rows_of(spark, *rows):
    return memories(spark, *({"id": i, "document": text, "embedding": v, "updated_at": DAY + dt.timedelta(days=day), "project": p} for i, text, v, day, p in rows))


ASKED = [(1, "red fox", [1.0, 0.0], []), (2, "dog", [0.0, 1.0], ["p"])]


def both(spark, path):
    asked = spark.createDataFrame(ASKED, "query_id long, text string, embedding array<double>, scope array<string>")
    text = sorted((r.query_id, r["rank"], r.id, r.score) for r in materialised.text_top(asked, path, 10).collect())
    near = sorted((r.query_id, r["rank"], r.id, r.distance) for r in materialised.near_top(asked, path, 10, probes=1000).collect())
    return text, near


def log(spark, *changes):
    return materialised.pending(spark.createDataFrame([(i, op, DAY + dt.timedelta(days=day)) for i, op, day in changes], "id string, operation string, at timestamp_ntz"))


def test_refreshed_stores_equal_built_ones(spark, tmp_path):
    first = [("a", "red fox", [1.0, 0.1], 0, "p"), ("b", "a dog", [0.1, 1.0], 0, "p"), ("c", "red dog", [1.0, 1.0], 0, "q"), ("e", "fox fox", [3.0, 0.0], 0, "p")]
    path = str(tmp_path / "store")
    materialised.build(rows_of(spark, *first), path)
    later = [first[0], ("b", "a red dog", [0.9, 0.0], 5, "p"), ("c", "red dog", [1.0, 1.0], 5, "_trash"), ("n", "new fox", [0.5, 0.5], 6, "p"), first[3]]
    done = materialised.refresh(rows_of(spark, *later), log(spark, ("b", "delete", 4), ("b", "upsert", 5), ("c", "upsert", 5), ("n", "upsert", 6), ("e", "delete", 6)), path)
    now = rows_of(spark, *(r for r in later if r[0] != "e"))
    materialised.build(now, str(tmp_path / "built"))
    assert both(spark, path) == both(spark, str(tmp_path / "built")) and len(both(spark, path)[0]) == 4
    assert {tuple(r) for r in done.collect()} == {("b", 2), ("c", 1), ("n", 1), ("e", 1)}
    # once more: the same ids come and go
    materialised.refresh(rows_of(spark, *later[:3], ("n", "new dog", None, 9, "p"), ("e", "fox again", [1.0, 2.0], 9, "p")), log(spark, ("n", "upsert", 9), ("e", "upsert", 9)), path)
    materialised.build(rows_of(spark, *later[:3], ("n", "new dog", None, 9, "p"), ("e", "fox again", [1.0, 2.0], 9, "p")), str(tmp_path / "again"))
    assert both(spark, path) == both(spark, str(tmp_path / "again"))
    assert materialised.current(spark, path).generation == 2


def test_what_was_queued_meanwhile_stays_queued(spark):
    queue = log(spark, ("a", "upsert", 1), ("b", "upsert", 1))
    later = log(spark, ("a", "upsert", 1), ("b", "upsert", 1), ("b", "delete", 2))
    left = materialised.complete(later, queue.select("id", "generation"))
    assert [(r.id, r.operation, r.generation) for r in left.collect()] == [("b", "delete", 2)]


def test_a_write_that_fails_is_never_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    rows = rows_of(spark, ("a", "red fox", [1.0, 0.1], 0, "p"))
    materialised.build(rows, path)
    before = both(spark, path)
    new = rows_of(spark, ("a", "red dog", [0.0, 1.0], 3, "p"))
    with monkeypatch.context() as m:
        m.setattr(materialised, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            materialised.refresh(new, log(spark, ("a", "upsert", 3)), path)
    assert both(spark, path) == before
    materialised.refresh(new, log(spark, ("a", "upsert", 3)), path)
    assert [r[2] for r in both(spark, path)[0]] == ["a", "a"] and both(spark, path) != before
    # another version of the layout: built anew from the whole table
    monkeypatch.setattr(materialised, "VERSION", 2)
    materialised.refresh(rows, log(spark, ("zz", "upsert", 9)), path)
    assert both(spark, path) == before and materialised.current(spark, path).version == 2


def test_unchanged_rows_are_not_read(spark, tmp_path):
    table, path = tmp_path / "memories", str(tmp_path / "store")
    rows = rows_of(spark, *((f"o{i}", "old words", None, 0, "p") for i in range(50)), ("n", "new words", None, 60, "p"))
    rows.withColumn("month", F.date_format("updated_at", "yyyy-MM")).write.partitionBy("month").parquet(str(table))
    read = spark.read.parquet(str(table))
    materialised.build(read.where(F.col("id") != "n"), path)
    for old in (table / "month=2024-01").glob("part-*"):  # reading any old row would fail
        old.write_bytes(b"destroyed")
    materialised.refresh(read, log(spark, ("n", "upsert", 60)), path, F.col("month") >= "2024-02")
    asked = spark.createDataFrame([(1, "new words", [])], "query_id long, text string, scope array<string>")
    assert [r.id for r in materialised.text_top(asked, path, 1).collect()] == ["n"] and materialised.text_top(asked, path, 100).count() == 51


def test_near_lists_find_nearly_all(spark, tmp_path):
    draw = np.random.default_rng(6)
    centres = draw.normal(0, 1, (40, 16))
    vectors = [centres[i % 40] + draw.normal(0, 0.25, 16) for i in range(1500)]
    rows = rows_of(spark, *((f"v{i}", "x", [float(x) for x in v], 0, "p" if i % 2 else "q") for i, v in enumerate(vectors)), ("none", "x", None, 0, "p"), ("zero", "x", [0.0] * 16, 0, "p"), ("short", "x", [1.0], 0, "p"))
    path = str(tmp_path / "store")
    commit = materialised.build(rows, path, text=False)
    lists = len(folders.names(spark, f"{path}/vectors/generation=0")) - 1
    assert lists >= 20 and commit.probes < lists / 2  # lists are left out
    asked = spark.createDataFrame([(i, [float(x) for x in v + draw.normal(0, 0.1, 16)], ["p"] if i % 5 == 0 else []) for i, v in enumerate(vectors[::15])], "query_id long, embedding array<double>, scope array<string>")
    exact = {(r.query_id, r.id, r.distance) for r in vector.nearest(asked, rows, 10).collect()}
    found = {(r.query_id, r.id, r.distance) for r in materialised.near_top(asked, path, 10).collect()}
    assert len(exact & found) >= 0.95 * len(exact)
    assert {(r.query_id, r.id, r.distance) for r in materialised.near_top(asked, path, 10, probes=1000).collect()} == exact
    # what is removed isn't found, and others take its place
    gone = [(f"v{i}", "delete", 1) for i in range(0, 1500, 3)]
    materialised.refresh(rows, log(spark, *gone), path)
    left = {r.id for r in materialised.near_top(asked, path, 10, probes=1000).collect()}
    assert left and left.isdisjoint(g[0] for g in gone)
    assert materialised.near_top(asked, path, 10).groupBy("query_id").count().where("count != 10").count() == 0


def test_recall_of_the_registered_query(spark):
    rows = catalogue.QUERIES["ann_topk"](spark, "/root/testdata/sf0.01").collect()
    by = {r.query_id: r.recall for r in rows}
    assert sum(by.values()) / len(by) >= 0.95


def test_empty_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    materialised.build(rows_of(spark, ("a", "x", None, 0, "p")).where("false"), path)
    assert both(spark, path) == ([], [])
    materialised.refresh(rows_of(spark, ("a", "red", [1.0, 0.0], 3, "p")), log(spark, ("a", "upsert", 3)), path)
    assert [r[2] for r in both(spark, path)[0]] == ["a"]


def test_best_holds_few_and_the_best(spark):
    rng = np.random.default_rng(5)
    best, values = vector.Best([10], largest=True), np.round(rng.random(20_000), 3)
    ids = np.array([f"d{i:05}" for i in range(len(values))], object)
    for at in range(0, len(values), 500):
        best.add(0, values[at : at + 500], ids[at : at + 500])
        assert sum(len(v) for v, _ in best.held[0]) <= 2 * 10 + 1024
    got = best.cut(0)
    assert sorted(zip(-got[0], got[1], strict=True)) == sorted(zip(-values, ids, strict=True))[:10]


def test_scans_get_small_batches(spark):
    asked = spark.createDataFrame([(1, "fox", [1.0, 0.0], [], 5)], "query_id long, text string, embedding array<double>, scope array<string>, candidates int")
    for scan in (bm25.text_top, vector.nearest):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert scan(asked, rows_of(spark, ("a", "a fox", [1.0, 0.0], 1, "p"))).count() == 1
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_places_of_tokens_meet_in_their_row(spark):
    """Postings made within each document are those that grouping all tokens gives."""
    texts = ["the fox, the FOX and " + "x" * 41 + " the end", "", None, "fox", "ü" * 21 + " ü fox ü", "?!"]
    rows = rows_of(spark, *((f"d{i}", t, None, 1, "p") for i, t in enumerate(texts)))
    want = boolean.occurrences(rows).groupBy("id", "project", "length", "term").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    tokens = rows.select("id", "project", text.all_tokens("document").alias("tokens"))
    got = tokens.mapInArrow(boolean.places, boolean.POSTINGS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
