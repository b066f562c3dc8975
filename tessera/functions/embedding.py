"""Embeddings by a provider, in checked batches, and their resumable backfill."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.store import needs_embedding


class Embedder(Protocol):
    """What turns texts into vectors; it goes to the executors, so it must be picklable."""

    model: str

    def embed(self, texts: list[str]) -> list[Sequence[float]]: ...


class HashEmbedder:
    """Counts of hashed words, scaled to length 1: the same vector for the same text everywhere, for tests and offline use."""

    def __init__(self, size: int = 32, model: str = "hash-words"):
        self.size, self.model = size, model

    def embed(self, texts: list[str]) -> list[Sequence[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                digest = hashlib.blake2b(word.encode(), digest_size=4).digest()
                row[int.from_bytes(digest, "little") % self.size] += 1
            row /= max(np.linalg.norm(row), 1e-12)
        return out.tolist()


def checked(vectors: list[Sequence[float]], expected: int) -> list[Sequence[float]]:
    if len(vectors) != expected:
        raise RuntimeError("the provider returned another number of vectors")
    if expected and (len({len(v) for v in vectors}) != 1 or not len(vectors[0])):
        raise RuntimeError("the provider returned vectors of different lengths")
    if not all(math.isfinite(x) for v in vectors for x in v):
        raise RuntimeError("the provider returned a number that is not finite")
    return vectors


def embedded(rows: DataFrame, embedder: Embedder, *, key: str, content: str = "content", batch: int = 64) -> DataFrame:
    """(key, embedding, embedding_model) of rows, ``batch`` texts a call."""
    if batch <= 0:
        raise ValueError("batch must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                vectors = checked(embedder.embed([t or "" for t in part.column(content).to_pylist()]), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float64())), pa.array([embedder.model] * part.num_rows)], [key, "embedding", "embedding_model"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, content).mapInArrow(run, f"`{key}` {kind}, embedding array<double>, embedding_model string")


def backfill(rows: DataFrame, embedder: Embedder, *, key: str, content: str = "content") -> DataFrame:
    """Rows (key, content, embedding, embedding_model, ...) with vectors of the embedder's model; those that have one keep it, so
    a run that was broken off goes on where its written rows end."""
    open_ = needs_embedding(rows, embedding="embedding", model="embedding_model", wanted=embedder.model)
    new = embedded(open_, embedder, key=key, content=content).withColumnsRenamed({"embedding": "_e", "embedding_model": "_m"})
    both = rows.join(new, key, "left")
    return both.withColumn("embedding", F.coalesce("_e", "embedding")).withColumn("embedding_model", F.coalesce("_m", "embedding_model")).drop("_e", "_m")
