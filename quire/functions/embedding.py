"""Embedders: text to unit vectors, in Arrow batches."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.config import EngineConfig


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic feature hashing of words and pairs of words: no model, equal on every machine."""

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", (t or "").lower())
            for gram in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = zlib.crc32(gram.encode())
                out[i, h % self.dim] += 1.0 if h >> 31 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1.0)


# Models of the profiles, whether they are looked for in the models folder only, and their dimensions.
PROFILES = {"fast": ("sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", False, 384), "bge": ("bge-m3", True, 1024)}


def resolve_model(config: EngineConfig) -> tuple[str, str]:
    """(name or path, device) of the model the settings ask for.

    Offline, only a local folder will do: the one named, or that of the model below ``models_dir``."""
    if config.embed_model:
        model, local_only = config.embed_model, False
    elif config.embed_profile in PROFILES:
        model, local_only, _ = PROFILES[config.embed_profile]
    else:
        raise ValueError(f"no profile {config.embed_profile!r}; there are {', '.join(sorted(PROFILES))} and hashing")
    folder = os.path.join(config.models_dir, model.rpartition("/")[2])
    if local_only:
        model = folder
    if not config.embed_offline or os.path.isdir(model):
        return model, config.embed_device
    if os.path.isdir(folder):
        return folder, config.embed_device
    raise FileNotFoundError(f"offline, and {model} is in no local folder; put it into {folder} or name its path")


class SentenceEmbedder:
    """A sentence-transformers model, loaded once in each worker that embeds; needs that library."""

    def __init__(self, model: str, device: str, dim: int) -> None:
        self.model, self.device, self.dim = model, device, dim

    def embed(self, texts: list[str]) -> np.ndarray:
        if (self.model, self.device) not in _LOADED:
            from sentence_transformers import SentenceTransformer  # optional

            _LOADED[self.model, self.device] = SentenceTransformer(self.model, device=self.device)
        return np.asarray(_LOADED[self.model, self.device].encode(texts, normalize_embeddings=True))


_LOADED: dict[tuple[str, str], object] = {}


def embedder_of(config: EngineConfig) -> Embedder:
    """By the settings: hashing, or the model of a profile or name, whose dimension is asked of it where none is fixed."""
    if config.embed_profile == "hashing" and not config.embed_model:
        return HashingEmbedder()
    model, device = resolve_model(config)
    known = None if config.embed_model else PROFILES[config.embed_profile][2]
    out = SentenceEmbedder(model, device, known or 0)
    if not known:
        out.dim = out.embed(["dimension"]).shape[1]
    return out


def embed(c: Column, embedder: Embedder) -> Column:
    """array<float> of each text; null for null.  The embedder is loaded once per worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vectors = embedder.embed([t or "" for t in s]).astype(np.float32)
            yield pd.Series([None if t is None else v.tolist() for t, v in zip(s, vectors)], index=s.index)

    return run(c)


def cosine_distance(a: Column, b: Column) -> Column:
    """In the JVM, for pairs already joined; 1 for a null or zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(norm > 0, 1.0 - dot(a, b) / norm), F.lit(1.0))
