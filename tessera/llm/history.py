"""Problem 6: batches against all accepted history, by a forest of sorted signature permutations.

Every text has ``TREES`` min-hash signatures of ``DEPTH`` values, each read as a key of a prefix tree. A forest keeps, per scope
and tree, the keys of all accepted texts in runs sorted by (scope, tree, key); one batch adds one run, and many runs are merged
into one. A batch entry is located by its key's range: the entries of the batch and of the history below one prefix are
brought together in key order and merged in one linear pass. The widest range searched is the prefix at which a text of
the wanted similarity is met in some tree with probability ``RECALL``; candidates of the longest common prefixes are verified
first, and the range is widened only for texts that have found nothing. Verification is exact, so only misses are possible,
at most 1 - RECALL of the links.

A batch reads the history of its own scopes only: the runs are sorted by scope, so other row groups are skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shingles import mix, signatures, unpack, verify
from tessera.session import norm_key, shared_dir, stage, union_all

TREES, DEPTH, RECALL, THRESHOLD = 17, 5, 0.999, 0.7
#: New texts below one prefix of one scope from which on a batch is split by time instead of pairing them all.
CROWD = 2048
#: Scopes named in the filter on the history; a batch of more reads all of it.
SCOPES = 1000
SLICES = 3
BEFORE_ALL, AFTER_ALL = -(1 << 62), 1 << 62
TEXTS = "chunk_id string, scope string, hash string, at bigint, cls binary, c8 bigint, n int, blob binary, slice int"
ENTRIES = "scope string, tree tinyint, prefix bigint, tail int, c8 bigint"


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The deepest prefix at which a pair of similarity ``threshold`` shares a prefix in some tree with the wanted probability."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


WIDEST = 3  # least_depth() of the constants above; a key is stored as its first WIDEST values and the rest


def entries(texts: DataFrame) -> DataFrame:
    """(scope, tree, prefix, tail, c8) of each set: ``DEPTH`` min-hash values of 16 bits a tree, in key order; computed once."""
    rng = np.random.default_rng(20240601)
    mul = rng.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            low = np.empty((len(batch), TREES * DEPTH), np.uint64)
            for i, blob in enumerate(batch["blob"]):
                hs = mix(unpack(blob))
                low[i] = np.iinfo(np.uint64).max
                for at in range(0, len(hs), 2048):
                    np.minimum(low[i], (hs[at : at + 2048, None] * mul[None, :] + add[None, :]).min(axis=0), out=low[i])
            v = (mix(low) >> np.uint64(48)).astype(np.int64).reshape(len(batch), TREES, DEPTH)
            prefix = (v[:, :, 0] << 32) | (v[:, :, 1] << 16) | v[:, :, 2]
            tail = ((v[:, :, 3] << 16) | v[:, :, 4]) - (1 << 31)
            yield pd.DataFrame({"scope": batch["scope"], "c8": batch["c8"], "prefix": list(prefix), "tail": list(tail.astype(np.int32))})

    keys = stage(texts.where("blob is not null").select("scope", "c8", "blob").mapInPandas(run, "scope string, c8 bigint, prefix array<bigint>, tail array<int>"), "keys")
    pair = F.posexplode(F.arrays_zip("prefix", "tail")).alias("tree", "k")
    return keys.select("scope", "c8", pair).select("scope", F.col("tree").cast("tinyint").alias("tree"), "k.prefix", "k.tail", "c8")


def meet(rows: list[np.ndarray], crowd: int, apart: bool) -> pd.DataFrame:
    """(a, b, depth, old) of one stretch of rows (range, old, c8, tail), sorted: each new entry with the entries of its range.

    New entries meet each other only where the batch has an order (``apart`` false); where more than ``crowd`` new ones share
    a range, one row (0, 0, -1, 0) says so instead. ``old`` is 1 where b is of the history.
    """
    at, old, c8, tail = rows
    fresh = np.r_[True, (at[1:] != at[:-1]) | (old[1:] != old[:-1]) | (c8[1:] != c8[:-1])] if len(at) else np.zeros(0, bool)
    at, old, c8, tail = at[fresh], old[fresh], c8[fresh], tail[fresh]
    head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, len(at)])
    new = np.add.reduceat((old == 0).astype(np.int64), head) if len(head) else size
    full = np.repeat(new > crowd, size)
    out: list[tuple[np.ndarray, ...]] = []
    if full.any() and not apart:
        out.append((np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1), np.zeros(1, np.int64)))
    i = np.flatnonzero((old[:-1] == 0) & (at[1:] == at[:-1])) if len(at) else np.zeros(0, np.int64)
    if apart or full.any():  # nothing to pair among the new: go to the first old entry of the range at once
        first_old = np.repeat(head + new, size)
        jump = i if apart else i[full[i]]
        i = np.setdiff1d(i, jump)
        for k, j in zip(jump, first_old[jump]):
            end = np.searchsorted(at, at[k], "right")
            if j < end:
                out.append((np.full(end - j, c8[k]), c8[j:end], depths(tail[k], tail[j:end]), np.ones(end - j, np.int64)))
    step = 1
    while len(i):
        i = i[i + step < len(at)]
        i = i[at[i] == at[i + step]]
        differ = c8[i] != c8[i + step]
        out.append((c8[i][differ], c8[i + step][differ], depths(tail[i][differ], tail[i + step][differ]), old[i + step][differ].astype(np.int64)))
        step += 1
    if not out:
        return pd.DataFrame(columns=["a", "b", "depth", "old"])
    a, b, d, o = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"a": a, "b": b, "depth": d, "old": o})


def depths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two keys that agree in their first ``WIDEST`` values."""
    x, y = x.astype(np.int64) + (1 << 31), y.astype(np.int64) + (1 << 31)
    return WIDEST + (x >> 16 == y >> 16) + (x == y)


def probe(new: DataFrame, old: DataFrame | None, crowd: int = CROWD, apart: bool = False) -> DataFrame:
    """(a, b, depth, old): candidates of the new entries among the old and, unless ``apart``, among each other; one shuffle."""
    cut = F.xxhash64("scope", "tree", "prefix").alias("at")
    rows = new.select(cut, F.lit(0).cast("tinyint").alias("old"), "c8", "tail")
    if old is not None:
        rows = rows.union(old.select(cut, F.lit(1).cast("tinyint").alias("old"), "c8", "tail"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch[c].to_numpy() for c in ("at", "old", "c8", "tail")]
            if held is not None:
                now = [np.concatenate([h, r]) for h, r in zip(held, now)]
            if len(now[0]):
                end = int(np.searchsorted(now[0], now[0][-1], "left"))
                held = [r[end:] for r in now]
                out = meet([r[:end] for r in now], crowd, apart)
                if len(out):
                    yield out
        if held is not None:
            out = meet(held, crowd, apart)
            if len(out):
                yield out

    met = rows.repartition("at").sortWithinPartitions("at", "old", "c8").mapInPandas(merge, "a bigint, b bigint, depth bigint, old bigint")
    return met.groupBy("a", "b").agg(F.max("depth").alias("depth"), F.max("old").alias("old"))


def decide(nodes: DataFrame, group_edges: DataFrame) -> DataFrame:
    """Replay the order: (node, first, state) with state 1 accepted, 2 turned away.

    ``nodes`` are (node, hg, cg, first): texts by first appearance, in an equal-hash group hg and a similarity group cg (null
    for none); ``group_edges`` are (ca, cb), both ways. A node is turned away if an accepted node of its groups, or of a
    neighbouring cg, came strictly earlier, and accepted if no accepted or undecided one did. Groups pass on minima only, so
    no pair inside a group is formed; each round decides at least the earliest undecided node of every component.
    """
    state = stage(nodes.withColumn("state", F.lit(0)), "state")
    while True:
        live = state.where("state < 2")
        acc = F.min(F.when(F.col("state") == 1, F.col("first"))).alias("acc")
        low = F.min("first").alias("low")
        by_hash = live.groupBy("hg").agg(acc, low)
        by_class = live.where("cg is not null").groupBy("cg").agg(acc, low)
        near = group_edges.join(by_class.withColumnRenamed("cg", "ca"), "ca").select(F.col("cb").alias("cg"), "acc", "low")
        by_class = by_class.union(near).groupBy("cg").agg(F.min("acc").alias("acc_c"), F.min("low").alias("low_c"))
        j = state.join(by_hash, "hg", "left").join(by_class, "cg", "left")
        acc_all, low_all = F.least("acc", "acc_c"), F.least("low", "low_c")
        new = F.when(F.col("state") > 0, F.col("state")).when(acc_all < F.col("first"), 2).when(low_all >= F.col("first"), 1).otherwise(0)
        state = stage(j.select("node", "hg", "cg", "first", new.alias("state")), "state")
        if not state.where("state = 0").limit(1).count():
            return state.select("node", "first", "state")


def digest(*parts: Column) -> Column:
    """A 16-byte identity of a tuple of strings."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


class SignatureForest:
    """A forest persisted under ``path``: ``texts`` (sets of the texts seen, one part a batch), ``runs`` (sorted entries) and ``known`` (hashes and
    classes) of the accepted ones.

    ``accept(batch)`` takes (chunk_id, scope, content) rows, with or without content_hash and at, and returns (chunk_id, scope,
    at, accepted): a text is turned away if an accepted text of its scope, of an earlier batch or of an earlier ``at`` in the
    batch, is alike or has the same hash, ignoring case. Texts of one batch and ``at`` are not compared with each other. Null
    and short texts leave no entry in the trees; a hash that is null or not given matches nothing; a repeated chunk_id counts
    once, at its earliest. Rows without chunk_id or scope are left out.
    """

    def __init__(self, spark: SparkSession, path: str, max_runs: int = 4, threshold: float = THRESHOLD, crowd: int = CROWD):
        self.spark, self.path, self.max_runs, self.threshold, self.crowd = spark, path.rstrip("/"), max_runs, threshold, crowd

    def _list(self, kind: str) -> list[str]:
        """Finished tables of a kind, in order of their names."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory() and fs.exists(done(s.getPath(), "_SUCCESS")))

    def _read(self, kind: str, schema: str) -> DataFrame | None:
        found = self._list(kind)
        return self.spark.read.schema(schema).parquet(*found) if found else None

    def _slices(self) -> list[int]:
        """Numbers of the batches whose texts are held."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/texts")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix("slice=")) for n in names if n.startswith("slice="))

    def _write(self, df: DataFrame, kind: str) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{kind}/{len(self._list(kind)):06d}-{uuid.uuid4().hex[:8]}")

    def _write_run(self, df: DataFrame) -> None:
        self._write(df.repartitionByRange("scope", "tree", "prefix").sortWithinPartitions("scope", "tree", "prefix", "tail"), "runs")

    def add_texts(self, rows: DataFrame) -> None:
        """Read (chunk_id, scope, hash, at, slice, content) rows into sets; nothing is accepted yet."""
        sets = signatures(rows, "chunk_id", "content", keep=("scope", "hash", "at", "slice"), scope="scope", part="slice")
        sets.write.mode("append").partitionBy("slice").option("compression", "zstd").parquet(f"{self.path}/texts")

    def history(self, scopes: list[str] | None) -> DataFrame | None:
        """Entries of all runs, of the named scopes only where they are few."""
        old = self._read("runs", ENTRIES)
        return old if old is None or scopes is None else old.where(F.col("scope").isin(scopes))

    def accept(self, batch: DataFrame) -> DataFrame:
        given = F.lower("content_hash") if "content_hash" in batch.columns else F.lit(None).cast("string")
        at = F.col("at").cast("bigint") if "at" in batch.columns else F.lit(0).cast("bigint")
        no = max(self._slices(), default=-1) + 1
        rows = batch.where("chunk_id is not null and scope is not null")
        self.add_texts(rows.select("chunk_id", "scope", given.alias("hash"), at.alias("at"), F.lit(no).alias("slice"), "content"))
        return self.accept_texts(no).select("chunk_id", "scope", "at", "accepted")

    def accept_texts(self, slice_no: int) -> DataFrame:
        """Decide the texts of one slice, in order of ``at``, against the history and each other, and add what is accepted."""
        past = self.spark.read.schema(TEXTS).parquet(f"{self.path}/texts").where(F.col("slice") <= slice_no)
        texts = past.where(F.col("slice") == slice_no)
        # a repeated row of a chunk counts once, at its earliest
        rows = texts.groupBy("chunk_id").agg(F.min_by(F.struct("scope", "hash", "at", "cls", "c8"), F.struct("at", "scope", "hash")).alias("r")).select("chunk_id", "r.*")
        hg = digest(F.lit("hash"), "scope", F.coalesce(F.concat(F.lit("="), F.lower("hash")), F.concat(F.lit("chunk "), F.col("chunk_id"))))
        rows = stage(rows.withColumn("hg", hg).withColumn("hashed", F.col("hash").isNotNull()), "rows")
        span = rows.agg(F.min("at"), F.max("at")).collect()[0]
        if span[0] is None:
            return rows.select("chunk_id", "scope", "at", F.lit(True).alias("accepted"))
        return union_all(self._accept(rows, texts, past, *span, True))

    def _accept(self, rows: DataFrame, texts: DataFrame, past: DataFrame, low: int, high: int, whole: bool) -> list[DataFrame]:
        mine = rows if whole else rows.where(F.col("at").between(low, high))
        known = self._read("known", "id binary")
        open_ = mine.select("chunk_id", "scope", "at", "hg", "hashed", "cls", "c8")
        if known is not None:
            met = known.select("id").distinct()
            open_ = open_.join(met.withColumnRenamed("id", "hg"), "hg", "left_anti").join(met.withColumnRenamed("id", "cls"), "cls", "left_anti")
        open_ = stage(open_, "open")
        sets = texts.select("scope", "cls", "c8", "n", "blob")
        if not whole:
            sets = sets.join(open_.select("c8").distinct(), "c8", "left_semi")
        new = entries(sets)
        listed = [r.scope for r in open_.select("scope").distinct().limit(SCOPES + 1).collect()]
        met = stage(probe(new, self.history(listed if len(listed) <= SCOPES else None), self.crowd, low == high), "candidates")
        if low < high and met.where("depth < 0").limit(1).count():
            middle = mine.agg(F.percentile_approx("at", 0.5)).collect()[0][0]
            middle = middle if middle < high else high - 1
            return self._accept(rows, texts, past, low, middle, False) + self._accept(rows, texts, past, middle + 1, high, False)
        met = met.where("depth > 0")
        here = open_.where("cls is not null").select("cls", "c8").distinct()
        # the sets that can be compared at all: one pass over the texts for all rounds
        met = stage(met.join(here.select(F.col("c8").alias("a")), "a", "left_semi").join(here.select(F.col("c8").alias("b"), F.lit(1).alias("new")), "b", "left").where("old = 1 or new = 1").select("a", "b", "depth", "old"), "comparable")
        ids = met.select(F.col("a").alias("c8")).union(met.select(F.col("b").alias("c8"))).distinct()
        classes = past.where("blob is not null").select("cls", "c8", "n", "blob")
        classes = stage(classes.join(ids, "c8", "left_semi").dropDuplicates(["cls"]), "sets")
        # against the history: the longest common prefixes first, wider ranges for those that found nothing
        away = None
        if known is not None:
            old = met.where("old = 1")
            for deep in (F.col("depth") > WIDEST, F.col("depth") == WIDEST):
                todo = old.where(deep) if away is None else old.where(deep).join(away.select("a"), "a", "left_anti")
                hit = verify(todo.select("a", "b"), classes, self.threshold, ready=True)
                ends = hit.select(F.col("a").alias("cls")).union(hit.select(F.col("b").alias("cls")))
                hit = stage(ends.join(here, "cls").select(F.col("c8").alias("a"), "cls").distinct(), "alike")
                away = hit if away is None else away.union(hit)
            open_ = stage(open_.join(away.select("cls"), "cls", "left_anti"), "open")
            here = open_.where("cls is not null").select("cls", "c8").distinct()
        # among themselves, in order
        inner = met.join(here.select(F.col("c8").alias("a")), "a", "left_semi").join(here.select(F.col("c8").alias("b")), "b", "left_semi")
        inner = inner.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = stage(verify(inner, classes, self.threshold, ready=True).select("a", "b"), "pairs")
        edges = pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb")).union(pairs.select(F.col("b").alias("ca"), F.col("a").alias("cb")))
        node = digest(F.hex("hg"), F.coalesce(F.hex("cls"), F.lit("")))
        nodes = open_.groupBy("hg", F.col("cls").alias("cg")).agg(F.min("at").alias("first")).withColumn("node", digest(F.hex("hg"), F.coalesce(F.hex("cg"), F.lit(""))))
        # alone in both groups and without neighbour: nothing can turn it away
        crowded_h = nodes.groupBy("hg").agg(F.count("*").alias("k")).where("k > 1").select("hg")
        crowded_c = union_all([nodes.where("cg is not null").groupBy("cg").agg(F.count("*").alias("k")).where("k > 1").select("cg"), edges.select(F.col("ca").alias("cg"))]).distinct()
        tied = nodes.join(crowded_h.withColumn("h", F.lit(True)), "hg", "left").join(crowded_c.withColumn("c", F.lit(True)), "cg", "left").where("h or c").select("node", "hg", "cg", "first")
        decided = decide(tied, edges)
        left = open_.withColumn("node", node).join(nodes.select("node", "first"), "node").join(decided.select("node", "state"), "node", "left")
        good = (F.coalesce("state", F.lit(1)) == 1) & (F.col("at") == F.col("first"))
        kept = stage(left.where(good).select("chunk_id", "hg", "hashed", "cls", "c8"), "kept")
        out = stage(mine.join(kept.select("chunk_id", F.lit(True).alias("accepted")), "chunk_id", "left").select("chunk_id", "scope", "at", F.coalesce("accepted", F.lit(False)).alias("accepted")), "decided")
        self._write(kept.where("hashed").select(F.col("hg").alias("id")).union(kept.where("cls is not null").select("cls")).distinct(), "known")
        self._write_run(new.join(kept.where("cls is not null").select("c8").distinct(), "c8", "left_semi").select("scope", "tree", "prefix", "tail", "c8").distinct())
        if len(self._list("runs")) > self.max_runs:
            self.merge()
        return [out]

    def merge(self) -> None:
        """Merge all runs into one sorted run; the new run is complete before an old one is removed."""
        old = self._list("runs")
        self._write_run(self.spark.read.schema(ENTRIES).parquet(*old).distinct())
        for p in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def replay(chunks: DataFrame, runs: DataFrame, slices: int = SLICES, crowd: int = CROWD) -> DataFrame:
    """(chunk_id, project, at, turned_away) of every chunk with a project, deciding run after run by received_at.

    Chunks without commit come before all runs, chunks of an unknown commit after all. A repeated row counts once. The runs go
    through a :class:`SignatureForest` in ``slices`` batches of about equal size, cut between runs; in a batch the runs are
    decided in order.
    """
    spark = chunks.sparkSession
    order = runs.groupBy(F.lower("commit_hash").alias("commit")).agg(F.min(F.unix_micros(F.col("received_at").cast("timestamp"))).alias("at"))
    c = chunks.select("chunk_id", norm_key(F.col("project_id")).alias("scope"), F.lower("commit_hash").alias("commit"), F.lower("content_hash").alias("hash"), "content").where("chunk_id is not null and scope is not null")
    at = F.when(F.col("commit").isNull(), F.lit(BEFORE_ALL)).otherwise(F.coalesce("at", F.lit(AFTER_ALL)))
    c = c.join(order, "commit", "left").select("chunk_id", "scope", "hash", at.alias("at"), "content")
    bounds = c.agg(F.percentile_approx("at", [k / slices for k in range(1, slices)], 10_000)).collect()[0][0] or []
    bounds = sorted(set(bounds))
    no = sum(((F.col("at") > b).cast("int") for b in bounds), F.lit(0))
    forest = SignatureForest(spark, f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}", crowd=crowd)
    forest.add_texts(c.withColumn("slice", no.cast("int")))
    done = union_all([forest.accept_texts(k) for k in range(len(bounds) + 1)])
    # a chunk that shows in several slices counts in its first
    w = done.groupBy("chunk_id").agg(F.min_by(F.struct("scope", "at", "accepted"), "at").alias("r")).select("chunk_id", "r.*")
    return w.select("chunk_id", F.col("scope").alias("project"), "at", (~F.col("accepted")).alias("turned_away"))
