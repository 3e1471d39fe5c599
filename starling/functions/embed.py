"""Embedding functions: the deterministic stand-in for a model, and a hook for a real one (F9, §2.11 search by text and image)."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def components(inputs: list[bytes], dim: int) -> np.ndarray:
    """The stand-in's components before scaling: of each input `dim` numbers from -1 to 1 that its SHA-256 decides."""
    out = np.empty((len(inputs), dim))
    for row, raw in zip(out, inputs):
        draw = random.Random(hashlib.sha256(raw).hexdigest())
        row[:] = np.fromiter(iter(lambda: draw.uniform(-1, 1), None), float, dim)
    return out


def fake_vector(seed: bytes, dim: int = 512) -> list[float]:
    """The stand-in's vector of one input, of unit length."""
    return _unit(components([seed], dim))[0].tolist()


def _unit(x: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, lengths, out=x, where=lengths > 0)


def embedder(model: Callable[[list[bytes]], list[list[float]]] | None = None, dim: int = 512) -> Callable[[Column], Column]:
    """A column function from text or bytes to ARRAY<FLOAT>; model maps a batch of byte strings to vectors. Null and blank
    input is an error, as the service rejects it."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            raw = [x if isinstance(x, bytes) else None if x is None else str(x).encode() for x in s]
            if any(x is None or not x.strip() for x in raw):
                raise ValueError("the input of an embedding must not be blank")
            yield pd.Series(model(raw) if model else list(_unit(components(raw, dim))))

    return embed
