"""Embedders: a protocol for models, and a deterministic one without a model (UDF-14, 15; STR-3, 4)."""

from __future__ import annotations

import hashlib
import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def hash_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector drawn from a generator seeded with the text's SHA-256: the same in every process."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(dim)
    return (v / np.linalg.norm(v)).astype(np.float32)


def hash_embedder(dim: int):
    """Column function of the deterministic embedder; null gives null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hash_vector(t, dim).tolist() for t in texts], dtype=object)

    return F.pandas_udf(run, ArrayType(FloatType()))


def embed(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "content", vector: str = "embedding", batch: int = 5, tries: int = 3, wait: float = 1.0, per_minute: int = 300) -> DataFrame:
    """Embed with a model that ``load`` opens once a task; each batch is tried ``tries`` times, ``wait`` seconds and then twice as
    long between the tries, then its rows get null. A task makes at most ``per_minute`` requests in any 60 seconds."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != vector), f"`{vector}` array<float>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        sent: deque[float] = deque()
        for rows in batches:
            out: list = []
            texts = list(rows[text])
            for at in range(0, len(texts), batch):
                part = [t or "" for t in texts[at : at + batch]]
                for attempt in range(tries):
                    now = time.monotonic()
                    while sent and now - sent[0] >= 60:
                        sent.popleft()
                    if len(sent) >= per_minute:
                        time.sleep(60 - (now - sent[0]))
                    sent.append(time.monotonic())
                    try:
                        out += model(part)
                        break
                    except Exception:
                        time.sleep(wait * 2**attempt)
                        if attempt + 1 == tries:
                            out += [None] * len(part)
            yield rows.drop(columns=[vector], errors="ignore").assign(**{vector: out})

    return df.mapInPandas(run, schema)
