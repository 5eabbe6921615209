"""Token shingles of texts as sets of 40-bit hashes, and exact Jaccard verification of candidate pairs.

A text's tokens are the maximal runs of a-z, 0-9 and _ (ASCII) in its lower-cased form; its shingles are the runs of
``width`` consecutive tokens. A shingle is kept as 40 bits of a 64-bit hash: for two sets of a thousand shingles the
chance that any two different shingles meet is below 2e-6, and it would move the similarity by a thousandth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.session import stage

_RUNS = re.compile(r"[a-z0-9_]+")
_BITS = np.uint64((1 << 40) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CACHE = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def token_hashes(tokens: list[str], cache: dict[str, int]) -> np.ndarray:
    """64-bit hash of each token; the cache is dropped when it has grown large."""
    if len(cache) > _CACHE:
        cache.clear()
    get, new = cache.get, xxhash.xxh64_intdigest
    out = np.empty(len(tokens), np.uint64)
    for i, t in enumerate(tokens):
        h = get(t)
        if h is None:
            h = cache[t] = new(t)
        out[i] = h
    return out


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 40-bit hashes of the runs of ``width`` tokens (empty if the text is shorter)."""
    m = len(ids) - width + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = ids[:m].copy()
    for k in range(1, width):
        h = mix(h) + ids[k : k + m]
    return np.unique(mix(h) & _BITS)


def pack(hashes: np.ndarray) -> bytes:
    """Five bytes a hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """The inverse of :func:`pack`."""
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def signatures(df: DataFrame, key: str, text: str, width: int = 3, min_tokens: int = 30, keep: tuple[str, ...] = (), scope: str | None = None, part: str | None = None) -> DataFrame:
    """(key, *keep, cls, c8, n, blob), one row per text of at least ``min_tokens`` tokens.

    ``cls`` names the text's class: texts with the same shingle set share it (16-byte digest), so exact and trivially
    reformatted copies collapse before any pair is formed; ``c8`` is its first half as a number, for candidate lists only.
    ``blob``, the set, stands in the first row of the class in a task and is null in the others: however many copies there
    are, a task passes on one. Null, empty and short texts give no row.

    With ``scope`` (one of ``keep``) classes are told apart by it, too, and short texts give a row without class; ``part``
    (one of ``keep``) asks for a set in every part.
    """
    at = keep.index(scope) if scope else -1
    within = keep.index(part) if part else -1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        seen: set = set()
        for batch in batches:
            rows = []
            for k, t, *more in zip(batch[key], batch[text], *[batch[c] for c in keep]):
                if k is None or t is None and not scope:
                    continue
                tokens = _RUNS.findall(t.lower()) if t else []
                if len(tokens) < max(min_tokens, width):
                    if scope:
                        rows.append((k, *more, None, None, None, None))
                    continue
                hs = shingle_hashes(token_hashes(tokens, cache), width)
                blob = pack(hs)
                cls = xxhash.xxh3_128_digest(more[at].encode() + b"\0" + blob if scope else blob)
                mark = (more[within], cls) if part else cls
                rows.append((k, *more, cls, int.from_bytes(cls[:8], "big", signed=True), len(hs), None if mark in seen else blob))
                if len(seen) > _CACHE:  # a class may be passed on again
                    seen.clear()
                seen.add(mark)
            if rows:  # an empty frame has no types to send
                out = pd.DataFrame(rows, columns=[key, *keep, "cls", "c8", "n", "blob"])
                yield out.astype({"c8": "Int64", "n": "Int32"}) if scope else out

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return df.select(key, text, *keep).mapInPandas(run, f"{kinds}, cls binary, c8 bigint, n int, blob binary")


def classes_of(sig: DataFrame) -> DataFrame:
    """(cls, c8, n, blob) of :func:`signatures`; a class may come from several tasks and then shows several times."""
    return sig.where("blob is not null").select("cls", "c8", "n", "blob")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """|a ∩ b| / |a ∪ b| of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return common / (len(a) + len(b) - common)


def blob_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact Jaccard similarity of two columns of packed shingle sets."""
    return pd.Series([jaccard(unpack(x), unpack(y)) for x, y in zip(a, b)], dtype="float64")


def verify(pairs: DataFrame, classes: DataFrame, threshold: float, ready: bool = False) -> DataFrame:
    """(a, b, sim): classes of the candidate pairs (a, b), given by ``c8``, whose sets reach the threshold; a < b.

    Two classes of one c8 (a matter of 10^10 classes) are both looked at, so a half id can add work, never a wrong pair.
    ``pairs`` should be staged: Spark then knows its size and sends the ids to the sets, not the sets to the ids, while
    they are few. Only the sets that occur in a pair are carried on; ``ready`` says that ``classes`` holds no others, once each.
    """
    sub = classes
    if not ready:
        ids = pairs.select(F.col("a").alias("c8")).union(pairs.select(F.col("b").alias("c8"))).distinct()
        sub = stage(classes.select("cls", "c8", "blob").join(ids, "c8", "left_semi").dropDuplicates(["cls"]), "verify")
    sim = F.pandas_udf(blob_jaccard, DoubleType())
    # sets are never broadcast, so that the plan is the same at every size
    left = sub.select(F.col("c8").alias("a"), F.col("cls").alias("cls_a"), F.col("blob").alias("blob_a")).hint("merge")
    right = sub.select(F.col("c8").alias("b"), F.col("cls").alias("cls_b"), F.col("blob").alias("blob_b")).hint("merge")
    met = pairs.join(left, "a").join(right, "b").withColumn("sim", sim("blob_a", "blob_b")).where(F.col("sim") >= threshold - 1e-12)
    return met.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"), "sim").where("a < b")
