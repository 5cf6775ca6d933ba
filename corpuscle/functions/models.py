"""Pluggable models with deterministic defaults: an embedder by feature hashing and a lexical scorer.

They make the paths around a model testable and claim no quality of their own.
A model of your own is any Arrow function with the same input and output.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = re.compile(r"\w+")
EMBEDDING = "dense array<float>, sparse map<int, float>"


def features(text: str | None) -> Counter[int]:
    """Counts of hashed character pairs (single characters for words of one)."""
    out: Counter[int] = Counter()
    for word in _WORDS.findall((text or "").lower()):
        out.update(zlib.crc32(word[i : i + 2].encode()) for i in range(max(1, len(word) - 1)))
    return out


def hashed(text: str | None, width: int = 64) -> tuple[list[float], dict[int, float]]:
    """(dense, sparse): a unit vector (zero for no words) and the weights 1 + log(count) of up to 100,000 hashed pairs."""
    counts = features(text)
    dense, sparse = np.zeros(width), {}
    for h, n in counts.items():
        weight = 1 + np.log(n)
        dense[h % width] += weight if h & 0x10000 else -weight
        sparse[h % 100_000] = float(sparse.get(h % 100_000, 0) + weight)
    size = np.linalg.norm(dense)
    return (dense / size if size else dense).astype(np.float32).tolist(), sparse


def embed(text: Column, model: Callable[[str | None], tuple[list[float], dict[int, float]]] = hashed) -> Column:
    """struct(dense, sparse) of a text, both from one call of the model; batches arrive as Arrow."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([model(t) for t in part], columns=["dense", "sparse"])

    return F.pandas_udf(run, EMBEDDING)(text)


def overlap(query: str | None, passage: str | None) -> float:
    """Share of the query's features that the passage has; 0 for a blank query."""
    asked, there = set(features(query)), set(features(passage))
    return len(asked & there) / len(asked) if asked else 0.0


def rerank_score(query: Column, passage: Column, scorer: Callable[[str | None, str | None], float] = overlap) -> Column:
    """Score of each (query, passage) pair by a pluggable scorer."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages in parts:
            yield pd.Series([float(scorer(q, p)) for q, p in zip(queries, passages, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(query, passage)
