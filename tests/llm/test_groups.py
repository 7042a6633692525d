"""Centroid clusters, source divergence and quality scores against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lorekeep.llm import centroids as C
from lorekeep.llm import quality as Q
from lorekeep.llm.source_divergence import divergence

VECTORS = "vec_id long, embedding array<double>, label int, id string, v int"
DOCS = "doc_id long, text string, lang string, source string, n long, term string"


def plain_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    if not centroids:
        return [], []
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*held[n])] if n in held else c for n, c in enumerate(centroids)]
    return [(i, near(v)[1], min(near(v)[0], C.GREATEST)) for i, v in kept], centroids


def vectors(draw, n, size, spread=1.0):
    return [[float(x) for x in draw.normal(0, spread, size)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0.002, 1.0, 3e4])
def test_clusters_equal_plain_ones(spark, spread):
    draw = np.random.default_rng(5)
    held = vectors(draw, 160, 8, spread)
    held += held[:30]  # copies: ties between equal centroids
    rows = list(enumerate(held))
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS).repartition(5)
    found, last = C.clusters(df, k=12, rounds=3, size=8)
    want, centroids = plain_clusters(rows, 12, 3, 8)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert last.rows == centroids


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0] * 4), (2, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0]), (2, [-5.0, 0.0, 0.0, 0.1]), (None, [9.0] * 4), (3, None), (4, []), (5, [1.0] * 3), (6, [1.0] * 5), (7, [nan, 0.0, 0.0, 0.0]), (8, [0.0, inf, 0.0, 0.0]), (9, [0.0, None, 0.0, 0.0])]
    for more in ([], [(10, [1e6, 0.0, 0.0, -1e6])], [(11, [1e30, 0.5, -1e300, 0.0])]):
        df = spark.createDataFrame([(i, v, None, None, None) for i, v in rows + more], VECTORS)
        for k in (2, 40):
            found, last = C.clusters(df, k=k, rounds=3, size=4)
            want, centroids = plain_clusters(rows + more, k, 3, 4)
            key = lambda r: tuple((x is None, x) for x in r)
            assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
            assert last.rows == centroids
    assert C.cluster_report(spark.createDataFrame([], VECTORS)).collect() == []
    assert C.cluster_report(spark.createDataFrame([(1, [0.5], 0, "", 0)], VECTORS)).collect() == []


def test_screening_never_drops_the_nearest():
    draw = np.random.default_rng(11)
    for top in (3, 1 << 10, 1 << 20, (1 << 26) - 1):
        rows = draw.integers(-top, top + 1, (40, 64))
        rows[1] = rows[0]
        rows[2] = rows[0]
        rows[2, 5] += 1 if rows[2, 5] < top else -1
        held = C.Centroids(rows.tolist())
        v = np.concatenate([draw.integers(-top, top + 1, (200, 64)), rows, rows[:3] // 2])
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in rows] for x in v]
        assert all(held.screened(v)[i][np.flatnonzero(np.array(d) == min(d))].all() for i, d in enumerate(exact))
        cluster, distance = held.nearest(v)
        assert distance.tolist() == [min(d) for d in exact] and cluster.tolist() == [d.index(min(d)) for d in exact]


def test_cluster_report_sums(spark):
    draw = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v, 0, "", 0) for i, v in enumerate(vectors(draw, 150, 64))], VECTORS)
    rows = C.cluster_report(df).collect()
    by = defaultdict(int)
    for r in rows:
        by[r.cluster] += r.distance
    assert len(rows) == 150 and all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in rows)
    _, centroids = plain_clusters([(i, v) for i, v in enumerate(vectors(np.random.default_rng(3), 150, 64))], 40, 5, 64)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in rows)


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    of = defaultdict(Counter)
    for lang, _, terms in docs:
        of[lang].update(set(terms))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in of[lang].items() if n >= least)
        counts = {None: Counter()} | {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, terms in docs:
            if la == lang:
                for held in (counts[s], counts[None]):
                    held.update(t for t in terms if t in set(kept))
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in counts:
            if s is None:
                continue
            pair = [(sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in counts if x is not None and x != s]
            term = [(p[s][t] - p[None][t], t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return out


def test_divergence_equals_the_plain_one(spark):
    draw = np.random.default_rng(2)
    alphabet = ["Über", "A", "b", "bb", "Éa", "é", "naïve", "x9y", "中文", "z", "Zz", "q-r", "k\x00l", "s_t", "u v", "😀"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = []
    for i in range(300):
        lang = [None, "", "en", "en", "en", "fr"][i % 6]
        source = None if i % 17 == 0 else f"s{'é' if i % 13 == 0 else ''}{draw.integers(0, 9)}"
        rows.append((" ".join(draw.choice(alphabet, draw.integers(0, 30))), lang, source))
    rows += [(None, "en", "none"), ("", "de", "only"), ("one two", "de", "other"), ("one two", "de", "other"), (None, None, None)]
    rows += [("Hot " * 3000, "en", "s1"), ("Long" * 5000, "en", "s1")]
    df = spark.createDataFrame([(1, *r, 1, "") for r in rows], DOCS).repartition(4)
    want = sorted(plain_divergence(rows, 5, 6))
    for chunk, block, strip in ((4096, 64, 16), (7, 3, 2), (1, 1, 1)):
        assert sorted(map(tuple, divergence(df, 5, 6, chunk, block, strip).collect())) == want
    assert divergence(df.where("false")).collect() == []


def test_shares_of_huge_counts(spark):
    from lorekeep.llm.source_divergence import share, shares

    counts = [0, 7, 9 * 10**9, 10**13, 3 * 10**15]
    total = 4 * 10**15 + 13
    want = [1 + 10**9 * (c + 5) // total for c in counts]
    assert shares(np.array(counts), total).tolist() == want
    df = spark.createDataFrame([(c, total) for c in counts], "n long, total long").select(share("n", "total").alias("p"))
    assert sorted(r.p for r in df.collect()) == want


def test_attention_slopes_equal_differences():
    draw = np.random.default_rng(4)
    bags = [draw.normal(0, 1, (n, Q.WIDTH)) for n in (1, 3, 2, 5)]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    model = Q.Attention()
    shapes = {"E": (Q.WIDTH, Q.WIDE), "e": (Q.WIDE,), "V": (Q.WIDE, Q.GATES), "U": (Q.WIDE, Q.GATES), "w": (Q.GATES,), "c": (Q.WIDE,), "d": (1,)}
    model.weights = {k: draw.normal(0, 0.3, s) for k, s in shapes.items()}
    first = np.cumsum([0] + [len(b) for b in bags[:-1]])

    def loss():
        p = model._forward(np.concatenate(bags), first)[5]
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    for k, g in model._slopes(bags, y).items():
        w = model.weights[k]
        for at in [tuple(draw.integers(0, n) for n in w.shape) for _ in range(6)]:
            was = w[at]
            w[at] = was + 1e-5
            up = loss()
            w[at] = was - 1e-5
            down = loss()
            w[at] = was
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_attention_weighs_the_telling_passages():
    clean = "The river runs by the old mill, and people walk there on quiet days. "
    junk = "buy### now%%% cheap$$$ click&&& here*** "
    texts = [clean * 40 if i % 2 else clean * 15 + junk * 40 + clean * 12 for i in range(80)]
    bags = [Q.encode(t + "x" * (i % 7)) for i, t in enumerate(texts)]
    model = Q.Attention().fit(bags, np.array([i % 2 for i in range(80)], float))
    assert model.score(clean * 33) > 0.5 > model.score(clean * 11 + junk * 33 + clean * 9)
    assert abs(model.score_and_weights(clean * 33)[1].sum() - 1) < 1e-9


def test_whole_texts_are_encoded():
    for n in (0, 1, 511, 512, 513, 40_000, 1_000_001):
        ends = Q.cuts(n)
        assert ends[0] == 0 and ends[-1] == n and len(ends) - 1 <= Q.PASSAGES and (np.diff(ends) > 0).all() or n == 0
        assert len(Q.encode("a" * n)) == len(ends) - 1


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    again = {r.doc_id: r.score for r in Q.quality_report(docs.repartition(7), labels.repartition(3)).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_quality_of_odd_rows(spark):
    schema = "doc_id long, text string, row string, score string, body int, label int"
    rows = [(i, ("Plain words in a row, and more of them." if i % 2 else "### %%% ### %%%") * (1 + i % 5), "r", "s", 1, 2) for i in range(40)]
    rows += [(None, None, None, None, None, None), (100, "", "", "", 0, 0), (101, "x" * 300_000, "", "", 0, 0), (5, rows[5][1], "twice", "", 0, 0), (7, "another text of one id", "", "", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (8, None, 0), (9, 7, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    found = Q.quality(docs, labels)
    assert found.columns == ["doc_id", "text", "row", "body", "label", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.text].add(r.score)
    assert all(len(x) == 1 for x in by.values())
    assert {r.held_out for r in Q.quality_report(docs.where("doc_id is null"), labels).collect()} == {False}
    assert Q.quality_report(docs.where("false"), labels).collect() == []
    assert {r.score for r in Q.quality_report(docs, labels.where("false")).collect()} == {0.5}
    assert {r.predicted for r in Q.quality_report(docs, labels.where("quality = 0")).collect()} == {0}
