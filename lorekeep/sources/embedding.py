"""Vectors from whatever model a caller plugs in, computed on the executors."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

#: What stands before a text, by what it is for: fixed values that models of this kind were trained with.
PREFIXES = {"query": "query: ", "passage": "passage: "}
#: Texts of a kind that a worker remembers; the first in goes first. Texts that the model gets at once.
CACHE, TOGETHER = 512, 64

Model = Callable[[list[str]], np.ndarray]


class Embedder:
    """A model that is loaded when it is first needed, and the vectors of the last texts."""

    def __init__(self, load: Callable[[], Model], kind: str, cache: int = CACHE) -> None:
        self.load, self.prefix, self.cache = load, PREFIXES[kind], cache
        self.model: Model | None = None
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()
        self.hits = 0

    def vectors(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """A vector for each text, null for null; each distinct text that isn't remembered goes to the model once."""
        known = {t: self.held[t] for t in texts if t is not None and t in self.held}
        self.hits += sum(t in known for t in texts)
        new = [t for t in dict.fromkeys(texts) if t is not None and t not in known]
        for at in range(0, len(new), TOGETHER):
            if self.model is None:
                self.model = self.load()
            part = new[at : at + TOGETHER]
            known |= zip(part, np.asarray(self.model([self.prefix + t for t in part]), np.float32), strict=True)
        for t in new:
            self.held[t] = known[t]
            if len(self.held) > self.cache:
                self.held.popitem(last=False)
        return [None if t is None else known[t] for t in texts]


def embedding(load: Callable[[], Model], kind: str, cache: int = CACHE) -> Callable[[str | Column], Column]:
    """A column function from texts to vectors; ``load`` runs in each task that has rows, and is sent to the executors."""

    @pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Embedder(load, kind, cache)
        for texts in batches:
            yield pd.Series(own.vectors(texts.where(texts.notna(), None).tolist()), dtype=object)

    return embed
