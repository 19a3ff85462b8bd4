"""Embedding of chunks by a pluggable embedder, and what is left to embed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32  # texts that an embedder gets at once


class Embedder(Protocol):
    """What turns texts into vectors. It is made once per worker by a factory."""

    id: str
    dim: int
    distance_floor: float | None

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A stand-in without meaning: bytes of a digest stream of the text, scaled to [-1, 1], at length 1."""

    id, dim, distance_floor = "hash-256", 256, None

    def embed(self, texts: list[str]) -> np.ndarray:
        raw = np.stack([np.frombuffer(hashlib.shake_256(t.encode()).digest(4 * self.dim), dtype="<u4") for t in texts])
        v = raw.astype(np.float64) / 2**31 - 1
        return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def embedder(choice: str | Callable[[], Embedder] | None) -> Callable[[], Embedder] | None:
    """The factory that CHOICE names: ``mock``, ``none`` (keywords and structure alone), or a factory of one's own.

    A factory that fails stands for none, so that a missing model never keeps an index from working.
    """
    if choice in (None, "none"):
        return None
    factory = HashEmbedder if choice == "mock" else choice
    if not callable(factory):
        raise ValueError(f"no embedder is named {choice}")
    try:
        factory()
    except Exception:  # whatever a model may raise while it loads
        return None
    return factory


def backlog(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (``chunk_id``) without a vector."""
    return chunks.join(vectors.select("chunk_id").distinct(), "chunk_id", "left_anti")


def embed(chunks: DataFrame, factory: Callable[[], Embedder]) -> DataFrame:
    """``chunk_id, embedding`` of CHUNKS (``chunk_id, content``), in batches, where they lie; null content has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for d in batches:
            for k in range(0, len(d), BATCH):
                part = d.iloc[k : k + BATCH]
                out = model.embed(part["content"].tolist())
                if out.shape != (len(part), model.dim):
                    raise ValueError(f"embedder {model.id} returned {out.shape} for {len(part)} texts")
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": list(out)})

    return chunks.where(F.col("content").isNotNull()).select("chunk_id", "content").mapInPandas(run, "chunk_id long, embedding array<float>")
