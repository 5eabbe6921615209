"""Problem 1: near-duplicate records by a multi-match prefix join with adaptive prefix lengths.

Order every set by ascending document frequency. If two sets of sizes m and n reach Jaccard t, their prefixes of length
n - ceil(t n) + l share at least l elements, for every l >= 1. Each record picks its own l: a record whose prefix holds
frequent elements takes a longer prefix and in return asks for more common elements. A pair must then share
min(l_a, l_b) elements, which loses no pair. What passes is verified exactly.

Frequencies come from a table of counters filled from all records; any order is correct, a better one only saves work. The
table grows with the data up to 2^22 counters; a task, and the table itself, sends one byte a counter. The postings are shuffled once and
sorted by token, and the holders of a token are paired where they meet. A token with many holders is split: its holders
are hashed into blocks, and every pair of blocks is a group of its own, so no task holds more than two blocks of a token.
Copies collapse into classes first, so no group of copies meets itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tessera.llm.components import components
from tessera.llm.shingles import classes_of, mix, signatures, unpack, verify
from tessera.session import stage

LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 22
SLICE = 1 << 14
LEVELS = 4
VERIFY_COST = 20.0
#: Holders of a token in one block; two blocks meet in a group.
BLOCK = 2048


def encode_counts(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, on a scale of eight steps an octave; counts up to 8 are exact."""
    return np.minimum(np.where(counts <= 8, counts, np.rint(8 * np.log2(np.maximum(counts, 1) / 8.0)) + 8), 255).astype(np.uint8)


def decode_counts(codes: np.ndarray) -> np.ndarray:
    """The inverse of :func:`encode_counts`, within a twentieth."""
    c = codes.astype(np.float64)
    return np.where(c <= 8, c, np.rint(8 * 2 ** ((c - 8) / 8)))


def frequency_table(classes: DataFrame) -> np.ndarray:
    """Counts of all shingles of all classes, hashed into a power of two of counters: one for 16 shingles, within the bounds."""
    total = classes.agg(F.sum("n")).collect()[0][0] or 0
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(0, (total // 16)).bit_length()))
    width = min(SLICE, counters)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(counters, np.int64)
        for batch in batches:
            if len(batch):
                seen += np.bincount((unpack(b"".join(batch["blob"])) % counters).astype(np.int64), minlength=counters)
        codes = encode_counts(seen)
        for lo in range(0, counters, width):
            if codes[lo : lo + width].any():
                yield pd.DataFrame({"lo": [lo], "counts": [codes[lo : lo + width].tobytes()]})

    def add(parts: pd.Series) -> bytes:
        out = np.zeros(width, np.float64)
        for p in parts:
            out += decode_counts(np.frombuffer(p, np.uint8))
        return encode_counts(out).tobytes()

    summed = F.pandas_udf(add, BinaryType())
    rows = classes.select("blob").mapInPandas(count, "lo int, counts binary").groupBy("lo").agg(summed("counts").alias("counts")).collect()
    out = np.zeros(counters, np.int32)
    for r in rows:
        out[r.lo : r.lo + width] = np.minimum(decode_counts(np.frombuffer(r.counts, np.uint8)), 2**31 - 1)
    return out


def block_of(ids: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    """The block of each holder among the blocks of its token."""
    return (mix(ids.view(np.uint64)) % np.asarray(blocks, np.uint64)).astype(np.int64)


def prefix_level(others: np.ndarray, base: int, levels: int = LEVELS) -> int:
    """The l in 1..levels with the least estimated cost: emitted and scanned postings plus candidates to verify.

    ``others`` are the estimated numbers of other holders in prefix order; of the postings met in an l-prefix only a part that
    shrinks with l reaches l hits.
    """
    best, cost = 1, math.inf
    hits = float(others[:base].sum())
    for level in range(1, levels + 1):
        if base + level - 1 > len(others):
            break
        if level > 1:
            hits += float(others[base + level - 2])
        now = base + level - 1 + hits + VERIFY_COST * hits / (level * level)
        if now < cost:
            best, cost = level, now
    return best


def spread(tokens: np.ndarray, blocks: np.ndarray, cls: int) -> np.ndarray:
    """Group keys of a record's tokens: the token itself, or for a split one its meetings with every block."""
    plain = tokens[blocks == 1].astype(np.int64)
    if len(plain) == len(tokens):
        return plain
    keys = [plain]
    for t, m in zip(tokens[blocks > 1].astype(np.int64), blocks[blocks > 1]):
        own = int(block_of(np.array([cls], np.int64), int(m))[0])
        other = np.arange(m)
        keys.append(t + ((1 + np.minimum(own, other) * m + np.maximum(own, other)) << 32))
    return np.concatenate(keys)


def meetings(key: np.ndarray, cls: np.ndarray, n: np.ndarray, level: np.ndarray, table: np.ndarray, threshold: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, need) for every two holders of one key whose sizes allow the threshold; rows are sorted by key, then n."""
    fresh = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])] if len(key) else np.zeros(0, bool)
    key, cls, n, level = key[fresh], cls[fresh], n[fresh], level[fresh]
    at = np.flatnonzero(key[1:] == key[:-1]) if len(key) else np.zeros(0, np.int64)
    out_a, out_b, need = [], [], []
    step = 1
    while len(at):
        to = at + step
        ok = to < len(key)
        at, to = at[ok], to[ok]
        ok = (key[at] == key[to]) & (n[at] >= threshold * n[to] - 1e-9)
        at, to = at[ok], to[ok]
        x, y = cls[at], cls[to]
        differ = x != y
        split = key[at] >> 32 > 0
        if split.any():  # two blocks meet here: within one block only where it meets itself
            blocks = blocks_of(table[(key[at] & 0xFFFFFFFF) % len(table)], block)
            cell = (key[at] >> 32) - 1
            differ &= ~split | (cell // blocks == cell % blocks) | (block_of(x, blocks) != block_of(y, blocks))
        out_a.append(np.minimum(x, y)[differ])
        out_b.append(np.maximum(x, y)[differ])
        need.append(np.minimum(level[at], level[to])[differ])
        step += 1
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(need)


def blocks_of(counts: np.ndarray, block: int) -> np.ndarray:
    """Number of blocks of tokens with these counts."""
    return np.maximum(1, -(-counts.astype(np.int64) // block))


def candidates(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), a < b, of classes (by c8) that share enough of their prefixes; staged."""
    freq = classes.sparkSession.sparkContext.broadcast(frequency_table(classes))
    load = float(freq.value.mean())

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = freq.value
        for batch in batches:
            cls, ns, levels, keys = [], [], [], []
            for c, n, blob in zip(batch["c8"], batch["n"], batch["blob"]):
                hs = unpack(blob)
                est = table[(hs % len(table)).astype(np.int64)]
                order = np.lexsort((hs, est))
                base = n - math.ceil(threshold * n - 1e-9) + 1
                # a counter also holds other elements: their mean load is taken off; below it one other holder is assumed,
                # as a small frequency can't be told from none
                level = prefix_level(np.maximum(est[order].astype(np.float64) - load, 1.0), base)
                prefix = order[: base + level - 1]
                cls.append(c)
                ns.append(n)
                levels.append(level)
                keys.append(spread(hs[prefix] & np.uint64(0xFFFFFFFF), blocks_of(est[prefix], block), c))
            if cls:
                yield pd.DataFrame({"c8": cls, "n": ns, "level": levels, "keys": keys})

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = freq.value
        held: list[np.ndarray] | None = None  # the rows of the last key, which may go on in the next batch
        for batch in batches:
            rows = [batch[c].to_numpy() for c in ("key", "c8", "n", "level")]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            held = [r[cut:] for r in rows]
            a, b, need = meetings(*[r[:cut] for r in rows], table, threshold, block)
            if len(a):
                yield pd.DataFrame({"a": a, "b": b, "need": need})
        if held is not None:
            a, b, need = meetings(*held, table, threshold, block)
            if len(a):
                yield pd.DataFrame({"a": a, "b": b, "need": need})

    p = classes.select("c8", "n", "blob").mapInPandas(postings, "c8 bigint, n int, level tinyint, keys array<bigint>")
    p = p.select(F.explode("keys").alias("key"), "c8", "n", "level").repartition("key").sortWithinPartitions("key", "n", "c8")
    met = p.mapInPandas(pair, "a bigint, b bigint, need tinyint").groupBy("a", "b").agg(F.count("*").alias("hits"), F.min("need").alias("need"))
    return stage(met.where("hits >= need").select("a", "b"), "candidates")


def similar_classes(df: DataFrame, key: str, text: str, threshold: float = 0.7, width: int = 3, min_tokens: int = 30) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): (key, cls) for every record that can count, and (a, b, sim) for every similar pair of classes.

    Null keys and null, empty or short texts take part in nothing. Repeated rows of a key count once per text.
    """
    sig = stage(signatures(df, key, text, width, min_tokens), "signatures")
    classes = classes_of(sig)
    pairs = stage(verify(candidates(classes, threshold), classes, threshold), "pairs")
    return sig.select(key, "cls").distinct(), pairs


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.7, width: int = 3, min_tokens: int = 30) -> DataFrame:
    """Every pair of different records (key_a < key_b) that are alike, copies expanded."""
    members, pairs = similar_classes(df, key, text, threshold, width, min_tokens)
    ma = members.select(F.col("cls").alias("a"), F.col(key).alias("ka"))
    mb = members.select(F.col("cls").alias("b"), F.col(key).alias("kb"))
    within = ma.join(mb, F.col("a") == F.col("b")).where(F.col("ka") < F.col("kb")).select("ka", "kb")
    across = pairs.join(ma, "a").join(mb, "b").where(F.col("ka") != F.col("kb")).select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))
    return within.union(across).distinct().select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"))


def similar_groups(df: DataFrame, key: str, text: str, threshold: float = 0.7, width: int = 3, min_tokens: int = 30) -> DataFrame:
    """(key, group_id, n_links): one row per record, its connected group and its number of similar records.

    Copies count as links but are never expanded: a record's links are the sizes of its own and of the similar classes.
    """
    members, pairs = similar_classes(df, key, text, threshold, width, min_tokens)
    sizes = stage(members.groupBy("cls").agg(F.count("*").alias("size"), F.min(key).alias("first")), "sizes")
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.select(F.col("cls").alias("b"), "size"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("other"))
    comp = components(pairs.select("a", "b"))
    group = comp.join(sizes.select(F.col("cls").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("group_first"))
    named = comp.join(group, "root").select(F.col("node").alias("cls"), "group_first")
    out = members.join(sizes, "cls").join(links, "cls", "left").join(named, "cls", "left")
    return out.select(key, F.coalesce("group_first", "first").alias("group_id"), (F.col("size") - 1 + F.coalesce("other", F.lit(0))).cast("bigint").alias("n_links"))
