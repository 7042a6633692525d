"""Mixing documents to target weights by soft membership.

A classifier fitted on the labelled table predicts for each document how likely it
belongs to each domain. Rates, at or above a lower bound of zero unless another is
given, say how often each document is to appear; they minimise the squared distance
of the domains' expected token totals from their targets. Projected gradient steps,
scaled by the totals' own second moments over documents that the bound doesn't hold
back, need only sums from each pass: a document's rate is its start followed by
the steps so far, each cut off at the bound, so no rates are stored or joined.

Domains are those of the labels: low quality, high quality, toxic (whatever its
quality). The classifier weighs hashed strings of five bytes by domain (counts over at
most ``SAMPLE`` labelled rows, drawn by a hash of the id) and calibrates a text's
mean and greatest weights by a softmax on the same rows.

Cases: null and empty texts have no tokens and the domains' prior; with no usable
labels all domains are equally likely; tables without tokens get the start rate;
rows without an id, and repeated rows, are documents like any other; an empty table
gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches, body, stash

DOMAINS = ("low", "high", "toxic")
#: Shares of the tokens of the mix.
TARGETS = (0.10, 0.88, 0.02)
SAMPLE = 20_000
#: Hashed places of the strings of five bytes; counts that each place has beforehand, shared out as all strings are.
PLACES, BEFOREHAND = 1 << 16, 10.0
#: Spaces that end a text.
PAD = 4
#: Passes at most; totals count as met within this share of all tokens.
PASSES, CLOSE = 25, 1e-9
#: With rates of one at least: budgets tried at most, each by so much greater; shares count as met within this.
GROWTHS, GROWTH, MET = 6, 1.25, 1e-3


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashed strings of five bytes that start at each byte but the last four."""
    b = raw.astype(np.uint32)
    four = b[:-4] | b[1:-3] << 8 | b[2:-2] << 16 | b[3:-1] << 24
    return ((four * np.uint32(2654435761) ^ b[4:] * np.uint32(0x85EBCA6B)) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int32)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts on end, each followed by four spaces, and where each starts."""
    raw = [t.encode() + b" " * PAD for t in texts]
    return np.frombuffer(b"".join(raw) + b" " * PAD, np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The strings that start at each byte of the texts, on end, and each text's number of bytes. A text's last ones end in its own four spaces, so none reads what follows it."""
    raw, starts = _joined(texts)
    lengths = np.diff(starts) - PAD
    own = np.ones(starts[-1], bool)
    own[(starts[1:, None] - 1 - np.arange(PAD)).ravel()] = False
    return grams(raw)[: starts[-1]][own], lengths


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The number of a labelled row's domain; null without labels."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality).isNotNull(), F.col(quality).cast("int"))


class Classifier:
    """Log weights of places by domain, and a softmax over a text's mean weights."""

    def __init__(self, counts: np.ndarray, rows: np.ndarray) -> None:
        share = counts.sum(1, keepdims=True) / max(counts.sum(), 1.0)
        smooth = counts + BEFOREHAND * np.maximum(share, 1e-3)
        logs = np.log(smooth / smooth.sum(1, keepdims=True))
        self.logs = (logs - logs.mean(0)).astype(np.float32)
        share = (rows + 0.5) / (rows + 0.5).sum()
        self.weights, self.bias = np.zeros((2 * len(DOMAINS), len(DOMAINS))), np.log(share)

    def means(self, texts: list[str]) -> np.ndarray:
        """Mean and greatest weight by domain over the bytes of each text; zeros for an empty one."""
        out = np.zeros((len(texts), 2 * len(DOMAINS)))
        if any(texts):
            at, lengths = text_grams(texts)
            full = np.flatnonzero(lengths)
            first = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
            for d, w in enumerate(self.logs):
                each = w[at]
                out[full, d] = np.add.reduceat(each, first, dtype=np.float64) / lengths[full]
                out[full, len(DOMAINS) + d] = np.maximum.reduceat(each, first)
        return out

    def fit(self, means: np.ndarray, labels: np.ndarray) -> None:
        """A softmax regression on standardised means, over a fixed number of steps."""
        self.scale = np.maximum(means.std(0), 1e-6)
        x = means / self.scale
        want = np.eye(len(DOMAINS))[labels]
        for _ in range(400):
            off = self.posteriors_of(x) - want
            self.weights -= 0.5 * (x.T @ off / len(x) + 1e-4 * self.weights)
            self.bias = self.bias - 0.5 * off.mean(0)

    def posteriors_of(self, x: np.ndarray) -> np.ndarray:
        # row by row, in one order of sums whatever stands beside a row
        z = sum((x[:, i, None] * w for i, w in enumerate(self.weights)), self.bias)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def posteriors(self, texts: list[str]) -> np.ndarray:
        x = self.means(texts)
        return self.posteriors_of(x / self.scale if hasattr(self, "scale") else x)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier, from docs (id, text) and labels (doc_id, quality, toxic)."""
    spark = docs.sparkSession
    known = labels.select("doc_id", domain_of().alias("d")).where("doc_id is not null and d is not null").groupBy("doc_id").agg(F.max("d").alias("d"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    truth = spark.sparkContext.broadcast({r["doc_id"]: r["d"] for r in rows})

    def pick(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            ids = batch.column("id").to_pylist()
            own = [i for i, x in enumerate(ids) if x in truth.value]
            yield pa.RecordBatch.from_arrays([pa.array([truth.value[ids[i]] for i in own], pa.int32()), batch.column("text").take(pa.array(own, pa.int32()))], ["d", "text"])

    drawn = stash(docs.mapInArrow(pick, "d int, text string"))

    def tally(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(DOMAINS), PLACES), np.int64)
        seen = np.zeros(len(DOMAINS), np.int64)
        for batch in batches(rows):
            domains, texts = batch.column("d").to_numpy(), batch.column("text").to_pylist()
            seen += np.bincount(domains, minlength=len(DOMAINS))
            for d in np.unique(domains):
                own, _ = text_grams([t for t, x in zip(texts, domains, strict=True) if x == d])
                total[d] += np.bincount(own, minlength=PLACES)
        flat = np.concatenate([total.ravel(), seen])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], ["at", "n"])

    flat = np.zeros(len(DOMAINS) * (PLACES + 1), np.float64)
    for row in drawn.mapInArrow(tally, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[row["at"]] = row["n"]
    seen = flat[len(DOMAINS) * PLACES :]
    fitted = Classifier(flat[: len(DOMAINS) * PLACES].reshape(len(DOMAINS), PLACES), seen)
    if (seen > 0).sum() > 1:
        shared = spark.sparkContext.broadcast(fitted)
        names = [f"x{i}" for i in range(2 * len(DOMAINS))]

        def means(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(rows):
                found = shared.value.means(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("d"), *map(pa.array, found.T)], ["d", *names])

        held = sorted(tuple(r) for r in drawn.mapInArrow(means, "d int, " + ", ".join(f"{n} double" for n in names)).collect())  # ``sample`` rows at most
        fitted.fit(np.array([r[1:] for r in held]), np.array([r[0] for r in held]))
    return fitted


def with_posteriors(docs: DataFrame, fitted: Classifier, text: str = "text") -> DataFrame:
    """``row`` (a document's columns as one value, so that they can have any names), tokens, and a posterior p_<domain> for each domain."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    whole = docs.select(F.struct(*docs.columns).alias("row"), body(text).alias("body"))
    schema = StructType().add("row", whole.schema["row"].dataType).add("tokens", "long")
    for d in DOMAINS:
        schema = schema.add(f"p_{d}", "double")

    def predict(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = batch.column("body").to_pylist()
            tokens = pa.array([len(t.split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), tokens, *map(pa.array, shared.value.posteriors(texts).T)], schema.names)

    return whole.mapInArrow(predict, schema)


def rate_column(steps: Sequence[Sequence[float]], least: float, start: float) -> Column:
    """A document's rate: the start, moved by each step along its posteriors and cut off at the bound."""
    rate = F.lit(start)
    for step in steps:
        along = sum((F.col(f"p_{d}") * F.lit(float(s)) for d, s in zip(DOMAINS, step, strict=True)), F.lit(0.0))
        rate = F.greatest(rate - along, F.lit(least))
    return rate


def fit_rates(parts: DataFrame, targets: Sequence[float] = TARGETS, budget: float = 1.0, least: float = 0.0) -> Column:
    """The rate that fits (tokens, p_*) to the targets' shares of ``budget`` times all tokens."""
    return fit(parts, targets, budget, least)[0]


def fit(parts: DataFrame, targets: Sequence[float], budget: float, least: float) -> tuple[Column, list[float]]:
    """The rate of ``fit_rates``, and the domains' shares of the tokens that it gives."""
    k = len(DOMAINS)
    want = np.array(targets, float) / sum(targets) * budget * float(parts.agg(F.sum("tokens")).first()[0] or 0)
    start = max(budget, least)
    steps: list[list[float]] = []
    if not want.any():
        return F.lit(float(start)), []
    best: tuple[float, int, list[float]] | None = None
    for _ in range(PASSES):
        rate = parts.withColumn("rate", rate_column(steps, least, start))
        p = [F.col(f"p_{d}") for d in DOMAINS]
        free = F.when(F.col("rate") > least, F.col("tokens")).otherwise(0)
        sums = [F.sum(F.col("tokens") * F.col("rate") * x) for x in p] + [F.sum(free * p[i] * p[j]) for i in range(k) for j in range(i, k)]
        # tasks add up in any order: what their sums differ by is cut off, so that rates and copies don't depend on it
        row = [float(f"{x:.10g}") for x in rate.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        off = np.array(row[:k]) - want
        if best is None or off @ off < best[0]:
            best = (float(off @ off), len(steps), (np.array(row[:k]) / sum(row[:k])).tolist())
        if np.abs(off).max() <= CLOSE * want.sum() or len(steps) - best[1] >= 5:
            break
        moment = np.zeros((k, k))
        moment[np.triu_indices(k)] = row[k:]
        moment += np.triu(moment, 1).T
        moment += np.eye(k) * (1e-9 * max(np.trace(moment), 1.0))
        steps.append(np.linalg.solve(moment, off).tolist())
    return rate_column(steps[: best[1]], least, start), best[2]


def fit_budget(parts: DataFrame, targets: Sequence[float], budget: float) -> Column:
    """A rate of one at least that comes near the targets' shares, with ``budget`` times all tokens or as many more as pay.

    No domain shrinks, so the budget is the greatest ratio of a domain's own tokens to its target at least; documents
    belong to several domains, so targets may take more. The budget grows as long as what misses the targets falls by as
    large a factor as the budget grows by: copies alone can't take a share from documents that all have a little of it.
    Targets that aren't reached are told by a warning.
    """
    wanted = np.array(targets, float) / sum(targets)
    own = [float(f"{x or 0:.10g}") for x in parts.agg(*(F.sum(F.col("tokens") * F.col(f"p_{d}")) for d in DOMAINS)).first()]
    budget = max([budget, *(n / sum(own) / w for n, w in zip(own, wanted, strict=True) if n and w)])
    best: tuple[float, Column, list[float]] | None = None
    for _ in range(GROWTHS):
        rate, shares = fit(parts, targets, budget, 1.0)
        miss = float(np.abs(np.array(shares) - wanted).max()) if shares else 0.0
        if best is not None and miss * GROWTH > best[0]:
            break
        best = (miss, rate, shares)
        if miss <= MET:
            break
        budget *= GROWTH
    if best[0] > MET:
        warnings.warn(f"mixing reaches the shares {best[2]} of the targets {wanted.tolist()}", stacklevel=2)
    return best[1]


def copies_column(rate: str, *keys: str) -> Column:
    """Whole copies: the rate rounded down, and one more with its fraction's probability, drawn by a hash."""
    draw = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("long")).alias("copies")


def mixture(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, budget: float = 1.0, least: float = 0.0) -> DataFrame:
    """Per document: doc_id, tokens, its posteriors, its rate and whole copies; on every row the share of tokens that the rates give each domain."""
    ids = docs.select(F.col("doc_id").alias("id"), body().alias("text"))
    parts = stash(with_posteriors(ids, train(ids, labels)).select(F.col("row.id").alias("id"), "tokens", *(f"p_{d}" for d in DOMAINS)))
    rate, shares = fit(parts, targets, budget, least)
    found = parts.withColumn("rate", rate)
    reached = [F.lit(x).cast("double").alias(f"reached_{d}") for d, x in zip(DOMAINS, shares or [None] * len(DOMAINS), strict=True)]
    return found.select(F.col("id").alias("doc_id"), "tokens", *(f"p_{d}" for d in DOMAINS), "rate", copies_column("rate", "id"), *reached)


def mix(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, budget: float = 1.25) -> DataFrame:
    """The documents, each as often as its rate says and at least once: mixing adds copies and drops nothing. The budget grows where the targets take more."""
    ids = docs.select(F.col("doc_id").alias("id"), body().alias("text"))
    parts = stash(with_posteriors(docs, train(ids, labels)))
    copied = parts.withColumn("rate", fit_budget(parts, targets, budget)).withColumn("copies", copies_column("rate", "row.doc_id", "row.text"))
    repeated = copied.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1).cast("long")))))
    return repeated.select(*(F.col("row")[c].alias(c) for c in docs.columns))
