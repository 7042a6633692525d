"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded: shares of byte classes, a
signed hashed histogram of the shapes of three successive bytes, and the repetition,
length and edges of its words and lines. A learned layer turns that into a
representation; gated attention (the product of a tanh and a sigmoid layer, then a
softmax over the document's passages) weighs the representations, and a logistic
classifier scores their weighted mean. All layers are learned together, from document
labels alone.

Fitting takes at most ``SAMPLE`` labelled rows outside the held-out third, drawn by a
hash of the id; their encoded passages (at most ``PASSAGES`` a document) come to the
driver, which fits a model of fixed size. Every document is then encoded and scored
whole: longer texts have longer passages, never fewer bytes. Only the text enters a
score, and a text's score doesn't depend on what stands beside it in a batch.

Cases: null texts are empty; an empty text is one empty passage and gets what the model
gives that; with no usable labels every score is 0.5, with labels of one class it is
that class; a row labelled twice counts as 1 if any label says so; labels other than 0
and 1, or null, aren't used; a null id is not held out; an empty table gives an empty
result; other columns, whatever their names, are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches, body, stash
from .toxicity import held_out

#: Labelled rows that the model is fitted on at most.
SAMPLE = 4000
THRESHOLD = 0.5
#: Bytes of a passage at least; passages of a document at most (longer texts have longer ones).
PASSAGE, PASSAGES = 512, 64
#: Classes of bytes: 0 lower case and beyond ASCII, 1 upper case, 2 digits, 3 space, 4 line ends, 5 other controls, 6 sentence marks, and each of the other signs alone.
SENTENCE = b".,;:!?'\"-()"
#: Places of the hashed shapes; statistics of words and lines.
SHAPES, STATISTICS = 32, 12
#: Width of the representation and of the attention's layers; steps, rate and decay of the fit; documents of a step.
WIDE, GATES, STEPS, RATE, DECAY, TOGETHER = 24, 12, 900, 0.01, 1e-3, 256


def byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    signs = iter(range(7, 256))
    for b in range(128):
        letter = chr(b)
        if letter.isupper():
            table[b] = 1
        elif letter.isdigit():
            table[b] = 2
        elif letter == " ":
            table[b] = 3
        elif letter in "\n\r":
            table[b] = 4
        elif b < 32 or b == 127:
            table[b] = 5
        elif b in SENTENCE:
            table[b] = 6
        elif not letter.islower():
            table[b] = next(signs)
    return table


CLASS = byte_classes()
CLASSES = int(CLASS.max()) + 1
#: A place and a sign for each shape of three bytes, by a multiplicative hash.
_HASHED = np.arange(CLASSES**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
PLACE, SIGN = (_HASHED % SHAPES).astype(np.int64), np.where(_HASHED >> np.uint64(20) & np.uint64(1), 1.0, -1.0)
WIDTH = CLASSES + SHAPES + STATISTICS


def cuts(n: int) -> np.ndarray:
    """Where the passages of a text of n bytes begin and end: of equal length, but for the last."""
    length = max(PASSAGE, -(-n // PASSAGES))
    return np.append(np.arange(0, max(n, 1), length), n)


def statistics(raw: bytes) -> list[float]:
    """Repetition, length and edges of words and lines."""
    words = raw.split()
    if not words:
        return [0.0] * STATISTICS
    n = len(words)
    lines = raw.split(b"\n")
    edges = b"".join([w[-1:] for w in words])
    marked = len(edges.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'\"-()" + bytes(range(128, 256))))
    alone = sum(not w.isalnum() and len(w) == 1 and w[0] < 128 for w in words)
    letters = sum(map(len, words))
    capital = sum(w[:1].isupper() for w in words)
    return [
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len({*zip(words, words[1:])}) / n,
        marked / n,
        alone / n,
        min(letters / n, 40.0) / 10,
        min(max(map(len, words)), 200) / 100,
        capital / n,
        np.log1p(n) / 5,
        min(len(lines) / n, 1.0),
        len(set(lines)) / len(lines),
        float(n < 8),
    ]


def encode(text: str) -> np.ndarray:
    """A row of ``WIDTH`` for each passage of a text."""
    raw = text.encode()
    ends = cuts(len(raw))
    out = np.zeros((len(ends) - 1, WIDTH))
    kinds = CLASS[np.frombuffer(raw, np.uint8)].astype(np.int64)
    for i, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if z == a:
            continue
        own = kinds[a:z]
        out[i, :CLASSES] = np.bincount(own, minlength=CLASSES) / (z - a)
        if z - a > 2:
            shapes = (own[:-2] * CLASSES + own[1:-1]) * CLASSES + own[2:]
            out[i, CLASSES : CLASSES + SHAPES] = np.bincount(PLACE[shapes], SIGN[shapes], SHAPES) / (z - a - 2)
        out[i, CLASSES + SHAPES :] = statistics(raw[a:z])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first, axis=0)


class Attention:
    """The layers, their fit and their scores. ``prior`` answers where there is nothing to tell apart."""

    def __init__(self, prior: float = 0.5) -> None:
        self.prior, self.weights = prior, None

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Attention:
        """Adam over batches of documents in a fixed order; ``bags`` have a row for each passage."""
        flat = np.concatenate(bags)
        self.mean, self.scale = flat.mean(0), np.maximum(flat.std(0), 1e-3)
        bags = [np.clip((b - self.mean) / self.scale, -8, 8) for b in bags]
        draw = np.random.default_rng(seed)
        shapes = {"E": (WIDTH, WIDE), "e": (WIDE,), "V": (WIDE, GATES), "U": (WIDE, GATES), "w": (GATES,), "c": (WIDE,), "d": (1,)}
        self.weights = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if k not in "ed" else np.zeros(s) for k, s in shapes.items()}
        first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
        order = np.empty(0, np.int64)
        for step in range(1, STEPS + 1):
            if len(order) < min(TOGETHER, len(bags)):
                order = np.concatenate([order, draw.permutation(len(bags))])
            own, order = order[:TOGETHER], order[TOGETHER:]
            slopes = self._slopes([bags[i] for i in own], labels[own])
            rate = RATE * (1 - step / (STEPS + 1))
            for k, g in slopes.items():
                g = g + DECAY * self.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """Representations, gates, attention, weighted means and scores of standardised passages; first: where each bag begins."""
        w = self.weights
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        a = (v * u) @ w["w"]
        sizes = np.diff(first, append=len(x))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), sizes))
        a /= np.repeat(_sums(a, first), sizes)
        z = _sums(a[:, None] * h, first)
        return h, v, u, a, z, _sigmoid(z @ w["c"] + w["d"]), sizes

    def _slopes(self, bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean log loss."""
        w = self.weights
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
        x = np.concatenate(bags)
        h, v, u, a, z, p, sizes = self._forward(x, first)
        off = (p - y) / len(bags)
        dz = np.repeat(off[:, None] * w["c"], sizes, 0)
        along = (dz * h).sum(1)
        da = a * (along - np.repeat(_sums(a * along, first), sizes))
        gate = da[:, None] * w["w"]
        dv, du = gate * u * (1 - v * v), gate * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da, "c": z.T @ off, "d": off.sum(keepdims=True)}

    def score(self, text: str) -> float:
        return self.score_and_weights(text)[0]

    def score_and_weights(self, text: str) -> tuple[float, np.ndarray]:
        """A text's score, and the attention that each of its passages gets."""
        bag = encode(text)
        if self.weights is None:
            return self.prior, np.full(len(bag), 1 / len(bag))
        _, _, _, a, _, p, _ = self._forward(np.clip((bag - self.mean) / self.scale, -8, 8), np.zeros(1, np.int64))
        return round(float(p[0]), 9), a


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Attention:
    """The model, from docs (id, text) and labels (doc_id, label) that aren't held out."""
    y = F.col(label).cast("int")
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & y.isin(0, 1)).groupBy("doc_id").agg(F.max(y).alias("y"))
    # rows that documents have, so that labels of other tables don't fill the sample
    known = usable.join(docs.where("id is not null").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    chosen = stash(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "y"))
    drawn = docs.join(F.broadcast(chosen), "id").select("id", "y", "text")  # ``sample`` rows at most on the broadcast side

    def bags(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            coded = [encode(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), pa.array(coded, pa.binary())], ["id", "y", "bag"])

    # several rows may have one id: one text of each, so that the sample stays one
    coded = drawn.mapInArrow(bags, "id string, y int, bag binary").groupBy("id").agg(F.min(F.struct("bag", "y")).alias("r"))
    rows = sorted((r["r"]["bag"], r["r"]["y"]) for r in coded.select("r").collect())  # ``sample`` documents of PASSAGES rows at most
    held = {y for _, y in rows}
    if len(held) < 2:
        return Attention(float(held.pop()) if held else 0.5)
    return Attention().fit([np.frombuffer(b, np.float32).reshape(-1, WIDTH).astype(np.float64) for b, _ in rows], np.array([y for _, y in rows], np.float64))


def quality(documents: DataFrame, labels: DataFrame, path: str = "doc_id", text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The documents' columns with score and predicted, which replace columns of the same names."""
    docs = documents.select(F.col(path).alias("id"), body(text).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(train(docs, labels))  # a model of fixed size

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches(rows):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([model.score(t) for t in batch.column("body").to_pylist()], pa.float64())], ["row", "score"])

    # the row goes as one value, so that its columns can have any names
    whole = documents.select(F.struct(*documents.columns).alias("row"), body(text).alias("body"))
    scored = whole.mapInArrow(run, StructType().add("row", whole.schema["row"].dataType).add("score", "double"))
    own = [F.col("row")[c].alias(c) for c in documents.columns if c not in (score, predicted)]
    return scored.select(*own, F.col("score").alias(score), (F.col("score") >= THRESHOLD).cast("int").alias(predicted))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it was held out, its score, the prediction."""
    found = quality(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
