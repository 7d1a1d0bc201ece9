"""Embedders: a hash-based stand-in and the hook for a real model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STUB_DIM = 64
MODEL_DIM = 384

# Maps a batch of texts to one vector each.
Embedder = Callable[[list[str]], np.ndarray]


def hash_embedder(texts: list[str]) -> np.ndarray:
    """Signed word counts hashed to ``STUB_DIM`` places, scaled to unit length.

    A stand-in without a model: texts that share words have similar vectors.
    A text without words has a zero vector.
    """
    out = np.zeros((len(texts), STUB_DIM), dtype=np.float32)
    for row, text in enumerate(texts):
        codes = np.array([zlib.crc32(w.encode()) for w in re.findall(r"\w+", text.lower())], dtype=np.int64)
        np.add.at(out[row], codes % STUB_DIM, np.where(codes // STUB_DIM % 2, 1, -1).astype(np.float32))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def embed(text: Column, embedder: Embedder = hash_embedder) -> Column:
    """Vector of each text.  The embedder is created once per task, not per batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(embedder(texts.fillna("").tolist()), dtype=np.float32)))

    return run(text)


def embed_chunks(chunks: DataFrame, embedder: Embedder = hash_embedder) -> DataFrame:
    """``embeddings`` relation of a ``chunks`` relation."""
    return chunks.select("file_id", "chunk_index", embed(F.col("chunk_text"), embedder).alias("embedding"))


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit-length mean of token states under an attention mask, for real models.

    ``hidden`` is (texts, tokens, dim), ``mask`` is (texts, tokens).
    """
    weights = mask[..., None].astype(np.float32)
    pooled = (hidden * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9)
    norms = np.linalg.norm(pooled, axis=1, keepdims=True)
    return pooled / np.where(norms > 0, norms, 1)
