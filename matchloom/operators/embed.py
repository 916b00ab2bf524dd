"""Embedding of texts by a pluggable model; the default hashes tokens and needs no files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.config import DEFAULTS


class Embedder(Protocol):
    """Turns texts into unit vectors; made once for each batch stream of a worker."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Counts of tokens, each in the dimension and with the sign that its digest gives, normalised."""

    def __init__(self, dimensions: int = DEFAULTS.dimensions):
        self.dimensions = dimensions
        self._known: dict[str, tuple[int, int]] = {}

    def _place(self, token: str) -> tuple[int, int]:
        place = self._known.get(token)
        if place is None:
            if len(self._known) > 200_000:
                self._known.clear()
            digest = hashlib.md5(token.encode()).hexdigest()
            place = self._known[token] = (int(digest[:8], 16) % self.dimensions, 1 if int(digest[8:10], 16) % 2 == 0 else -1)
        return place

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re

        found = []
        for text in texts:
            vector = np.zeros(self.dimensions)
            for token in re.findall("[A-Za-z0-9]+", text):
                at, sign = self._place(token.lower())
                vector[at] += sign
            size = float(np.sqrt((vector * vector).sum()))
            found.append((vector / size if size > 0 else vector).tolist())
        return found


#: Models by name with a test whether they can be used here, in the order in which ``auto`` tries them.
BACKENDS: dict[str, tuple[type, Callable[[], bool]]] = {"hashing": (HashingEmbedder, lambda: True)}


def register(name: str, make: type, usable: Callable[[], bool] = lambda: True) -> None:
    """Adds a model; it is tried before those known already."""
    known = {k: v for k, v in BACKENDS.items() if k != name}
    BACKENDS.clear()
    BACKENDS.update({name: (make, usable), **known})


def backend(name: str = "auto") -> type:
    """The model of a name, or with ``auto`` the first that can be used."""
    if name != "auto":
        if name not in BACKENDS:
            raise LookupError(f"no model {name}; known are {', '.join(BACKENDS)}")
        if not BACKENDS[name][1]():
            raise RuntimeError(f"the model {name} cannot be used here")
        return BACKENDS[name][0]
    return next(make for make, usable in BACKENDS.values() if usable())


def embedded(text: Column, make: type = HashingEmbedder, **settings) -> Column:
    """Vectors of a text column; null for null and blank texts."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make(**settings)
        for batch in batches:
            full = batch.notna() & (batch.fillna("").str.strip() != "")
            vectors = iter(model.embed(batch[full].tolist()))
            yield pd.Series([next(vectors) if x else None for x in full], index=batch.index)

    return run(text)
