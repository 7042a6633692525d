"""Corpus operators with models, vectors or pieces."""

import random
import re
import sys
import time
import zlib
from collections import Counter
from itertools import pairwise

import corpus_pipeline
import numpy as np
import pytest
from brute import joined
from lorekeep.llm import embedding_dedup, sentencepiece_nbest, toxicity
from lorekeep.llm.components import components
from lorekeep.llm.embedding_dedup import near_embeddings
from lorekeep.llm.mixing import DOMAINS, PLACES, Classifier, grams, mix, mixture
from lorekeep.llm.sentencepiece_nbest import Encoder, Pieces, encode_documents, encoding_report
from lorekeep.llm.toxicity import CharacterModel, Portion, Reader, Scorer, numbers, toxicity_report, train
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def test_components_of_chains_stars_and_repeats(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)]
    links += links[:5] + [(b, a) for a, b in links[:5]]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = joined(301, [(a, b) for a, b in links if a != b])
    assert got == {n: roots[n] for n in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _links(vectors, labels, least=0.93):
    out = []
    for i, x in enumerate(vectors):
        for j in range(i):
            y = vectors[j]
            if labels[i] is not None and labels[i] == labels[j] and x is not None and y is not None and len(x) == len(y):
                a, b = np.array(x, float), np.array(y, float)
                if a.any() and b.any() and np.isfinite(a).all() and np.isfinite(b).all() and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    out.append((i, j))
    return out


@pytest.mark.parametrize("sides", [(3, 2), (1024, 4096)])
def test_embeddings_match_all_pairs(spark, monkeypatch, sides):
    monkeypatch.setattr(embedding_dedup, "MEMBERS", sides[0])
    monkeypatch.setattr(embedding_dedup, "QUERIES", sides[1])
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    vectors = [(centres[i % 12] + r.normal(size=16) * r.choice([0.05, 0.2, 0.6])).tolist() for i in range(240)]
    vectors += [vectors[0], vectors[0], [0.0] * 16, None, [], [float("nan")] * 16, [float("inf")] * 16, vectors[3][:8], [2 * x for x in vectors[5]]]
    labels = [i % 2 for i in range(240)] + [0, 0, 0, 0, 0, 0, 0, 1, 1]
    labels[7] = None
    rows = [(i, v, l, "x", 3, "y") for i, (v, l) in enumerate(zip(vectors, labels, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, content string, own int, probes string")
    got = {x.vec_id: x for x in near_embeddings(df, list_size=24).collect()}
    links = _links(vectors, labels)
    counts = np.bincount([x for l in links for x in l], minlength=len(vectors))
    found = sum(got[i].n_links for i in range(len(vectors)))
    assert found >= 0.9 * 2 * len(links)
    assert all(got[i].n_links <= counts[i] for i in range(len(vectors)))
    if found == 2 * len(links):
        roots = joined(len(vectors), links)
        assert [got[i].component_id for i in range(len(vectors))] == roots
        assert all(got[i].kept == (roots[i] == i) for i in range(len(vectors)))


def test_embeddings_with_nulls_inside_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, None], 0), (2, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_embeddings(df).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), None: (0, None, True)}
    assert near_embeddings(df.limit(0)).count() == 0


def test_recall_with_planted_copies(spark):
    """Every row indexed, with noisy copies of the driver's vectors, against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    r = np.random.default_rng(6)
    x = np.array([v.embedding for v in rows], float)
    labels = np.array([v.label for v in rows])
    copies = r.integers(0, len(x), 1500)
    x = np.concatenate([x, x[copies] + r.normal(size=(1500, x.shape[1])) * r.uniform(0, 0.06, (1500, 1))])
    labels = np.concatenate([labels, labels[copies]])
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = int(((units @ units.T >= 0.93) & (labels[:, None] == labels[None])).sum()) - len(x)
    table = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    found = near_embeddings(table, list_size=100).agg(F.sum("n_links")).first()[0]
    assert truth > 1000 and truth >= found >= 0.9 * truth


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load()


def test_words_against_all_segmentations(pieces):
    r = random.Random(7)

    def everything(word):
        ends, out = pieces.edges(word), []

        def back(at, ids, score):
            if at == 0:
                out.append((score, ids))
            for start, piece, s in ends[at] if at else ():
                back(start, (*piece, *ids), score + s)

        back(len(word), (), 0.0)
        return sorted(out, key=lambda x: (-x[0], x[1]))

    some = ["▁the", "é", "日本", "\n", "▁▁▁then", "😀"] + ["▁" * r.randint(0, 2) + "".join(r.choices("theainoré日", k=r.randint(1, 7))) for _ in range(150)]
    for word, (packed, score, costs) in zip(some, pieces.best_of(some), strict=True):
        whole = everything(word)
        assert [s for s, _ in pieces.ranked(word, 4)] == [s for s, _ in whole[:4]]
        assert score == whole[0][0] and costs == (score - whole[1][0] if len(whole) > 1 else float("inf"))
        assert tuple(np.frombuffer(packed, "<i4").tolist()) in [ids for s, ids in whole if s == score]
        assert pieces._long(word)[1:] == (score, costs)
    for text in ("a b", "on the in", "x\ny", "tr  e", "é a a a"):
        whole = everything("▁" + text.replace(" ", "▁"))
        got = Encoder(pieces, 4).encode([text])[0]
        assert [s for s, _ in got] == [s for s, _ in whole[: len(got)]] and len({ids for _, ids in got}) == len(got)


def test_texts_come_back(spark, pieces):
    texts = [None, "", " ", "▁", "a▁b  c", "\n\n\té😀", "x" * 5000, "the cat " * 3000, "the cat", "the cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("path", F.lit("x")).withColumn("ids", F.lit(1))
    got = {r.path: r for r in encode_documents(df).collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == len(texts)
    encoder = Encoder(pieces)
    for i, t in enumerate(texts):
        assert encoder.decode(bytes(got[i].ids)) == (t or "")
        assert list(got[i].scores) == sorted(got[i].scores, reverse=True)
    assert got[0].n_tokens == 0 and bytes(got[8].ids) == bytes(got[9].ids)
    assert encoding_report(df.limit(0)).count() == 0


def test_disguised_words_are_restored():
    words = "the idiot is a stupid clown and a loser moron that reads books in the morning while idiots sleep".split()
    counts = np.zeros(64**3, np.int64)
    for w in words * 50:
        n = np.concatenate([[0, 0], numbers(w), [0]]).astype(int)
        np.add.at(counts, (n[:-2] * 64 + n[1:-1]) * 64 + n[2:], 1)
    reader = Reader(CharacterModel(counts))
    for token, word in (("1d10t", "idiot"), ("stup1d", "stupid"), ("c.l.o.w.n", "clown"), ("looooser", "loser"), ("m0r0n!", "moron"), ("$tupid", "stupid")):
        assert word in reader.words(token)
    assert reader.words("books") == ("books",)
    assert reader.counts("an i d i o t")[0]["idiot"] == 1


def test_spaced_edged_and_doubled_words_are_restored(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(1500).collect()
    texts = [r.text or "" for r in rows]
    counts = np.zeros(64**3, np.int64)
    for t in [*texts, "idiot moron stupid loser clown scum " * 300]:
        n = np.concatenate([[0, 0], numbers(t), [0]]).astype(int)
        first = np.where(n[1:-1] == 0, 0, n[:-2])
        np.add.at(counts, (first * 64 + n[1:-1]) * 64 + n[2:], 1)
    reader, scorer = Reader(CharacterModel(counts)), Scorer(["idiot", "moron", "stupid", "loser", "clown", "scum"], [], 0.0)
    for token, word in (("!diot", "idiot"), ("(lown", "clown"), ("s(um", "scum"), ("|oser", "loser"), ("s+upid", "stupid"), ("idiiot", "idiot"), ("(!diot)", "idiot")):
        assert word in reader.words(token)
    forms = {
        "you are a i d i o t": {"idiot"},
        "i d i o t m o r o n": {"idiot", "moron"},
        "such an id iot": {"idiot"},
        "the mor on and the stu pid": {"moron", "stupid"},
        "1 d 1 0 t": {"idiot"},
        "(id iot!)": {"idiot"},
        "s - c - u - m": {"scum"},
        "!diot": {"idiot"},
        "an idiiot": {"idiot"},
        "books are good (really!)": set(),
    }
    names = list(scorer.chosen)
    for text, words in forms.items():
        assert {names[i] for i, _ in scorer.find(reader, text)[0]} == words, text
    three = Scorer(["bad"], [], 0.0)
    assert [i for i, _ in three.find(reader, "so b a d")[0]] == [0]
    for long in ("word " * 20000, "i " * 20000, "i - " * 10000):
        assert scorer.find(reader, long)[0] == [] and reader.counts(long)[1] == 20000
    assert not any(scorer.in_pieces(reader, t.lower().split())[w] for t in texts[:300] for w in scorer.chosen)
    # words passed over unread have no reading with a feature; marks around letters change nothing
    forms = ("{}", "{}!", "{}$$$", "***{}&&&", "({})!", "{}1", "«{}!!", "$${}", "{}{}", "{}|.")
    tokens = {f.format(w, w) for t in texts[:60] for w in t.lower().split()[:40] for f in forms} | {f.format(w, w) for w in ("iidiot", "mmmoron", "stupidly", "losersss", "clowns") for f in forms}
    for token in tokens:
        if scorer.vain(token):
            assert not any(scorer.places(w) for w in reader.words(token)) and not scorer.foldings(token), token
    for token in ("idiot", "idiiot", "clownish"):
        assert reader.words(f"***{token}&&&") == reader.words(token)
        assert scorer.find(reader, f"an {token}%%%")[0] == scorer.find(reader, f"an {token}")[0]


def _calls(run):
    """How many functions a run calls, and its result."""
    n = [0]

    def seen(frame, event, arg):
        n[0] += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        result = run()
    finally:
        sys.setprofile(None)
    return n[0], result


def _trigrams(texts):
    counts = np.zeros(64**3, np.int64)
    for t in texts:
        n = np.concatenate([[0, 0], numbers(t), [0]]).astype(int)
        first = np.where(n[1:-1] == 0, 0, n[:-2])
        np.add.at(counts, (first * 64 + n[1:-1]) * 64 + n[2:], 1)
    return counts


def test_toxicity_calls_few_functions_a_token(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("lang = 'en'").limit(400).collect()
    texts = [r.text or "" for r in rows]
    tokens = sum(len(t.split()) for t in texts)
    reader, scorer = Reader(CharacterModel(_trigrams(texts))), Scorer(["idiot", "moron", "stupid", "loser", "wor~"], [], 0.0)
    first = [scorer.find(reader, t) for t in texts]
    calls, again = _calls(lambda: [scorer.find(reader, t) for t in texts])
    assert again == first and calls < tokens


def test_tokens_of_a_portion_are_those_of_split(spark):
    odd = "a\x00b \x1cc\x85d\u2003e \u200bf ﬁé ñ1 ²³x ¡hola! $$$moneys$$$ ...... abcdef, «abcdefg» aabcdef abbcdef abcdeff (((((((abcdefg ))))))) aaaaaa- x" * 3
    texts = ["", " ", odd, "\n\n", "İstanbul ΣΑΣ".lower(), odd + " ", "idiots idiots, $$idiots"] + [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(80).collect()]
    texts = [t.lower() for t in texts]
    portion, scorer = Portion(texts), Scorer(["idiot", "abc~", "xy", "moneys"], [], 0.0)
    dull = portion.dull(scorer.points)
    for k, t in enumerate(texts):
        own = np.arange(portion.first[k], portion.first[k + 1])
        found = portion.tokens(own)
        assert found == t.split()
        assert not any(d and not scorer.vain(x) for d, x in zip(dull[own], found, strict=True))
        assert all(d or not scorer.vain(x) or len(x) > 12 for d, x in zip(dull[own], found, strict=True))
    # texts read together, or in portions, or alone
    reader = Reader(CharacterModel(_trigrams(texts)))
    together = list(scorer.find_all(reader, texts))
    assert together == [Scorer(list(scorer.chosen), [], 0.0).find(reader, t) for t in texts]
    assert together[6][0] == []  # "idiots" is neither the word nor a beginning that counts


def test_letters_are_joined_as_by_the_whole_search(monkeypatch):
    r = random.Random(3)
    model = CharacterModel(_trigrams(["the an in or id iot mor on stu pid é ñu a b c " * 50]))
    runs = [["".join(r.choices("thaniordmspué", k=r.randint(1, 5))) for _ in range(r.randint(2, 9))] for _ in range(400)] + [["stu", "pid"], ["i", "d", "i", "o", "t"], ["mo", "r", "on"]]
    runs = [x for x in runs if not any(a == b for a, b in pairwise("".join(x)))]
    quick = [model.joined(x) for x in runs]
    monkeypatch.setattr(toxicity, "TWICE_ON_END", re.compile(""))
    assert len(runs) > 50 and quick == [model.joined(x) for x in runs] and any(quick)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in found}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.01


def test_whole_words_stand_for_their_beginnings(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:80]
    texts = [("the dog ran home with an idiot" if k % 2 else "the dog ran home with an apple") + f" again {k}" for k in range(80)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    _, scorer = train(docs, labels)
    assert "idiot" in scorer.chosen and not any(f.startswith("idi") and f != "idiot" for f in scorer.chosen)
    assert scorer.places("idioma") == []


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (4, "word " * 30000, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    got = toxicity_report(docs, none).collect()
    assert {r.score for r in got} == {0.0} and len(got) == 4 and {r.predicted for r in got} == {0}
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 2, a).when(F.col("doc_id") == 4, b).otherwise(F.col("doc_id")).cast("long"))
    one = spark.createDataFrame([(a, 1, 0), (a, None, 1), (None, 1, 1), (b, 1, 1)], "doc_id long, toxic int, quality int")
    assert {r.score for r in toxicity_report(docs, one).collect()} == {1.0}
    assert toxicity_report(docs.limit(0), one).count() == 0


def test_mixing_meets_its_targets(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    targets = (0.2, 0.75, 0.05)
    found = mixture(docs, labels, targets).toPandas()
    total = found.tokens.sum()
    for d, share in zip(DOMAINS, targets, strict=True):
        assert abs((found.tokens * found.rate * found[f"p_{d}"]).sum() / total - share) < 1e-3
    assert (found.rate >= 0).all() and len(found) == docs.count()
    assert abs(found[[f"p_{d}" for d in DOMAINS]].sum(axis=1) - 1).max() < 1e-9
    assert abs((found.copies - found.rate)).max() < 1


def test_stage_meets_its_targets_from_a_skewed_table(spark):
    r = random.Random(5)
    words = {d: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(80)] for d in DOMAINS}
    kinds = [*["low"] * 300, *["high"] * 180, *["toxic"] * 20]
    rows = [(i, " ".join([f"{d}", *r.choices(words[d], k=40)])) for i, d in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(d != "low"), int(d == "toxic")) for i, d in enumerate(kinds)], "doc_id long, quality int, toxic int")
    out = mix(docs, labels).toPandas()
    assert set(out.doc_id) == set(range(len(kinds)))
    n = out.text.str.split(" ").str[0].value_counts(normalize=True)
    for d, share in zip(DOMAINS, (0.10, 0.88, 0.02), strict=True):
        assert abs(n[d] - share) < 0.02


def test_posteriors_are_of_a_text_alone(spark):
    """Whatever stands beside a text in its batch, before or after it."""
    texts = ["", "short text", "zebra", "abcd", "é", "yellow " * 300, "x", "short text", "", "plain words of no kind", "zebra" * 40]
    r = np.random.default_rng(1)
    held = Classifier(r.integers(0, 9, (len(DOMAINS), PLACES)).astype(float), np.array([3.0, 5.0, 1.0]))
    held.fit(held.means(texts), np.array([i % 3 for i in range(len(texts))]))
    alone = np.concatenate([held.posteriors([t]) for t in texts])
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1), [5, 0, 5, 3]):
        order = list(order)
        assert (held.posteriors([texts[i] for i in order]) == alone[order]).all()
    # a plain reading: mean and greatest weight of the five-byte strings from each byte, spaces after the end
    for t, row in zip(texts, held.means(texts), strict=True):
        raw = t.encode() + b"    "
        own = [held.logs[:, grams(np.frombuffer(raw[i : i + 5], np.uint8))[0]] for i in range(len(t.encode()))]
        want = np.concatenate([np.mean(own, 0), np.max(own, 0)]) if own else np.zeros(6)
        assert np.abs(row - want).max() < 1e-5
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    first, again = ({tuple(r) for r in mixture(x, y).collect()} for x, y in ((docs, labels), (docs.repartition(7), labels.repartition(3))))
    assert first == again
    assert sorted(map(tuple, mix(docs, labels).collect())) == sorted(map(tuple, mix(docs.repartition(7), labels).collect()))


def test_mixing_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (4, "a b c", "d"), (4, "a b c", "d")], "doc_id long, text string, rate string")
    got = mixture(docs, labels).collect()
    assert len(got) == 5 and all(abs(r.p_low - 1 / 3) < 1e-9 for r in got)
    assert mixture(docs.limit(0), labels).count() == 0
    assert mix(docs, labels).columns == docs.columns and mix(docs, labels).count() >= 5


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert out.round_trip.all()
    kept = set(out.doc_id)
    near = {r.doc_id for r in __import__("lorekeep.llm.minhash_dedup", fromlist=["x"]).near_duplicates(docs).where("kept").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()} & near
    assert len(clean - kept) <= 0.02 * len(clean)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_near_embeddings_of_extreme_vectors_and_without_a_limit_of_probes(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 8))
    vectors = [*(base * 10.0 ** r.integers(-3, 3, (300, 1))), *(base[:50] + r.normal(size=(50, 8)) * 0.05)]
    rows = [(i, 0, v.tolist()) for i, v in enumerate(vectors)] + [(900, 0, [1e-170] * 8), (901, 0, [1e-200] * 8), (902, 0, [1e300] * 8), (903, 0, [0.0] * 8), (904, 0, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    valid = [(i, np.array(v) / np.abs(v).max()) for i, _, v in rows if np.isfinite(v).all() and any(v)]
    units = np.array([v / np.linalg.norm(v) for _, v in valid])
    want = dict(zip([i for i, _ in valid], ((units @ units.T >= 0.93).sum(1) - 1).tolist(), strict=True)) | {903: 0, 904: 0}
    got = near_embeddings(df, probes=None, list_size=10).collect()
    assert {x.vec_id: x.n_links for x in got} == want and want[900] >= 2
    few = near_embeddings(df, probes=1, list_size=10).collect()
    assert all(x.n_links <= want[x.vec_id] for x in few)


def test_long_words_and_tokens_take_linear_time(spark):
    pieces = Pieces.load()
    encoder = Encoder(pieces)
    start = time.time()
    word = "abcdefghij" * 3_000
    found = encoder.encode([word, "x" * 30_000])
    assert encoder.decode(found[0][0][1]) == word and len(found[0]) == 4 and found[0][0][0] >= found[0][1][0]
    assert time.time() - start < 60
    counts = np.zeros(64**3)
    start = time.time()
    restored = CharacterModel(counts).restore("a1b@c" * 60_000)
    assert len(restored) == 300_000 and time.time() - start < 60


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(1, "one two three four five six seven", 0.5, 3, 0.1), (1, "one two three four five six seven", 0.5, 3, 0.1), (2, None, None, None, None), (None, "", 1.0, 1, 1.0), (5, "idiot idiot token=abcdefgh12", 0.0, 0, 0.0), (6, "other words", 0.0, 0, 0.0), (6, "and more of other words", 0.0, 0, 0.0)]
    names = "doc_id long, text string, score double, tokens long, p_low double, toxic_score string, row string, n_chars long, blob string, part int"
    docs = spark.createDataFrame([(*r, "a", "b", 9, "c", 1) for r in rows], names)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for table, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    folder = f"file://{tmp_path}"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {r.score for r in out.collect()} <= {r[2] for r in rows}
        assert stage(spark, docs.limit(0), folder).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 5, 6]
    masked = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.hide_secrets(spark, docs, folder).collect()}
    assert masked[5] == ("idiot idiot [secret]", 20) and masked[2][0] is None
    coded = corpus_pipeline.encode(spark, docs, folder).collect()
    assert all(r.round_trip and len(r.next_ids) == len(r.next_scores) <= 3 for r in coded) and any(r.next_ids for r in coded)


def test_mixing_against_a_plain_fit(spark):
    """The rates' distance from the targets, against that of a plain projected gradient descent over all documents."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    targets = np.array([0.02, 0.5, 0.48])
    found = mixture(docs, labels, targets.tolist()).toPandas()
    a = (found[[f"p_{d}" for d in DOMAINS]].to_numpy() * found.tokens.to_numpy()[:, None]).T
    want = targets * found.tokens.sum()
    rate, step = np.ones(a.shape[1]), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(3_000):
        rate = np.maximum(rate - step * (a.T @ (a @ rate - want)), 0)
    plain, own = (np.linalg.norm(a @ x - want) / want.sum() for x in (rate, found.rate.to_numpy()))
    assert own <= plain + 1e-3
    reached = found[[f"reached_{d}" for d in DOMAINS]].iloc[0].to_numpy(dtype=float)
    assert np.abs(reached - a @ found.rate.to_numpy() / (a @ found.rate.to_numpy()).sum()).max() < 1e-6


def test_frequent_words_are_searched_once(monkeypatch):
    """Words that many groups have stay remembered when rare ones fill the room; words of all lengths are searched together."""
    monkeypatch.setattr(sentencepiece_nbest, "REMEMBERED", 120)
    pieces, searched = Pieces.load(), Counter()
    find = pieces.best_of
    monkeypatch.setattr(pieces, "best_of", lambda words: searched.update(words) or find(words))
    common = ["the", "and", "reading", "\ud55c\uae00", "a\u2581b", "x" * 70]
    encoder = Encoder(pieces)
    for n in range(12):
        text = "  ".join(common) + " ".join(f"w{n}q{k}" for k in range(30)) + "\n"
        again = encoder.encode([text, "", text])
        assert again[0] == again[2] == Encoder(Pieces.load()).encode([text])[0]
        assert encoder.decode(again[0][0][1]) == text
    assert searched["\u2581\u2581and"] == searched["\u2581\u2581reading"] == 1


def test_many_words_as_each_alone():
    pieces, rng = Pieces.load(), random.Random(8)
    words = ["".join(rng.choice("abcdeinrstäö\u4e2d\U0001f600\0▁0") for _ in range(rng.randint(1, 66))) for _ in range(400)]
    words = ["▁" + w.replace("▁", "") for w in words] + ["\n", "▁▁▁", "▁"]
    assert pieces.best_of(words) == [pieces._long(w) for w in words]
    calls = []
    step = pieces.step
    pieces.step = lambda nodes, letters: calls.append(1) or step(nodes, letters)
    pieces.best_of([w[:n] for n in range(1, 40) for w in words[:20]])
    assert len(calls) <= pieces.longest


def test_tokens_are_read_only_where_a_feature_can_begin():
    """What can't begin like a feature is told by its letters, with the same result as reading it."""
    rng = random.Random(4)
    model = CharacterModel(np.bincount([(a * 64 + b) * 64 + c for a, b, c in zip(*(numbers("the idiot is a stupid clown scum loser " * 9).astype(int)[k:] for k in (0, 1, 2)), strict=False)], minlength=64**3))
    scorer, read = Scorer(["idiot", "stup~", "scum", "loser", "clow~", "xy", "\u00e9t\u00e9~"], [], 0.0), []
    restore, reader = model.restore, Reader(model)
    model.restore = lambda token: read.append(token) or restore(token)
    tokens = ["".join(rng.choice("idotsupclwnxyqz\u00e9\u00b20134$@!|.-%+") for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    tokens += [a + w + b for w in ("1d10t", "iddiot", "5tupid", "st-upid", "abc-idiot", "$cum", "l0ser", "loserrr", "x7y", "\u00e9tt\u00e9e") for a in ("", "(", "$$$", "@") for b in ("", "!!", ".", "$")]
    wanted = {t: tuple(i for word in reader.words(t) for i in scorer.places(word)) for t in tokens}
    assert sum(map(bool, wanted.values())) > 100
    read.clear()
    reader = Reader(model)
    for t in tokens:
        own, n = Scorer.find(scorer, reader, t)
        assert dict(own) == dict(Counter(wanted[t])) and n == 1, t
    met = len(set(read))
    read.clear()
    assert scorer.find(reader, "q9q-zz%% zq0zz, nnnn.") == ([], 3) and not read
    assert met < len({t for t in tokens if not t.isalpha()}) / 2
