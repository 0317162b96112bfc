"""Embeddings of texts: a feature-hashing one that needs no model, and the hook for model backends."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")


def hash_embedding(text: str, dim: int = 384, ngram: int = 3, seed: int = 0) -> np.ndarray:
    """Signed hashed counts of tokens and runs of up to ``ngram`` of them, of unit length; zero for a text without tokens."""
    t = _TOKEN.findall(text.lower())
    key = str(seed).encode()
    made = (hashlib.blake2b(" ".join(t[i : i + n]).encode(), digest_size=8, key=key).digest() for n in range(1, ngram + 1) for i in range(len(t) - n + 1))
    h = np.frombuffer(b"".join(made), ">u8").astype(np.uint64)
    out = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), dim).astype(np.float32)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def embedder(dim: int = 384, ngram: int = 3, seed: int = 0):
    """A column function text -> array<float>; null stays null."""
    if dim <= 0:
        raise ValueError("dim must be positive")

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else hash_embedding(x, dim, ngram, seed))

    return embed


#: Prefixes that models of these families want before queries and passages.
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", "")}


def model_embedder(encode, family: str | None = None, query: bool = False):
    """A column function around ``encode`` (list of texts -> matrix), which is made once per worker by calling it without arguments."""
    prefix = PREFIXES.get(family or "", ("", ""))[0 if query else 1]

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encode()
        for text in parts:
            out = np.asarray(model([prefix + (x or "") for x in text]), np.float32)
            yield pd.Series(list(out))

    return embed


def normalised(vec: Column) -> Column:
    """A vector of unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm))
