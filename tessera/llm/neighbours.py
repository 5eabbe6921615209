"""Problem 4: the k most similar vectors of every vector, by vantage-point trees per shard with relaxed pruning.

Unit vectors, Euclidean distance d = sqrt(2 - 2 cos). A top tree of vantage points, fitted on a bounded sample, cuts the space
into shards; every vector is indexed in exactly one shard. A query with search radius r visits the near side of a node, and
the far side only while |d(q, vp) - mu| <= r / relax. With relax = 1 this is the triangle inequality and the search is exact;
a larger factor prunes more, as in many dimensions a difference of distances to one point is far smaller than the distance.
Within a shard the same rule runs down a local tree to leaves that are scanned by matrix products. A search without a least
similarity has no radius at first: a query's own leaf, then its own shard, give it the distance of its k-th best so far, and
that radius shrinks from leaf to leaf.

Equal vectors collapse into one class with its first k + 1 ids before anything is routed, so copies can't fill a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stage

DIM = 64
SAMPLE = 20_000
SHARD = 100_000
LEAF = 192
#: Visiting queries of a shard in one task; a shard with more is searched by several tasks, each with all of its points.
QUERY_BLOCK = 65_536


def usable(df: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """(key, vec) with vec the unit vector as ``4 * dim`` bytes; null, short, long, all-zero and non-finite vectors are dropped.

    A repeated row of a key counts once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, vecs = [], []
            for k, v in zip(batch[key], batch[vector]):
                if k is None or v is None or len(v) != dim:
                    continue
                x = np.asarray(v, dtype=np.float64)
                norm = np.sqrt((x * x).sum())
                if not np.isfinite(norm) or norm == 0:
                    continue
                keys.append(k)
                vecs.append((x / norm).astype("<f4").tobytes())
            if keys:
                yield pd.DataFrame({key: keys, "vec": vecs})

    good = df.select(F.col(key).cast("string").alias(key), vector).where(F.col(vector).isNotNull() & (F.size(vector) == dim))
    return good.mapInPandas(run, f"{key} string, vec binary").groupBy(key).agg(F.min("vec").alias("vec"))


def matrix(vecs, dim: int = DIM) -> np.ndarray:
    """Rows of packed vectors as a float32 matrix."""
    return np.frombuffer(b"".join(vecs), "<f4").reshape(-1, dim)


class TopTree:
    """A balanced tree of vantage points; leaves are shards. Fitted on a sample, it stays below sample size in bytes."""

    def __init__(self, sample: np.ndarray, shards: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, shards)))))
        self.points: list[np.ndarray | None] = [None] * (2**self.depth - 1)
        self.mus = [0.0] * (2**self.depth - 1)
        self._fit(0, sample, rng)

    def _fit(self, at: int, rows: np.ndarray, rng) -> None:
        if at >= len(self.points):
            return
        if not len(rows):
            self.points[at], self.mus[at] = np.eye(1, DIM, dtype=np.float32)[0], 1.0
            self._fit(2 * at + 1, rows, rng), self._fit(2 * at + 2, rows, rng)
            return
        vp, d = best_vantage(rows, rng)
        mu = float(np.median(d))
        self.points[at], self.mus[at] = vp, mu
        self._fit(2 * at + 1, rows[d <= mu], rng)
        self._fit(2 * at + 2, rows[d > mu], rng)

    def route(self, x: np.ndarray, slack: float | np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(shard, row numbers) of the shards that rows of ``x`` visit; slack 0 gives each row its own shard alone."""
        slack = np.broadcast_to(slack, len(x))
        out, todo = [], [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if at >= len(self.points):
                out.append((at - len(self.points), rows))
                continue
            gap = distance(x[rows], self.points[at]) - self.mus[at]
            todo.append((2 * at + 1, rows[gap <= slack[rows]]))
            todo.append((2 * at + 2, rows[gap > -slack[rows]]))
        return out


def distance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit rows to a unit vector."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ p), 0.0))


def best_vantage(rows: np.ndarray, rng, tries: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Of a few random rows the one whose distances spread most: it separates best."""
    probe = rows if len(rows) <= 512 else rows[rng.integers(0, len(rows), 512)]
    picks = rows[rng.integers(0, len(rows), min(tries, len(rows)))]
    spread = np.sqrt(np.maximum(2.0 - 2.0 * (probe @ picks.T), 0.0)).std(axis=0)
    vp = picks[int(spread.argmax())]
    return vp, distance(rows, vp)


def search_shard(points: np.ndarray, queries: np.ndarray, same: np.ndarray, k: int, least: float, slack: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, sim) of the up to k most similar points with sim >= least of each query, itself left out.

    ``same[i]`` is the point row of query i, or -1. The tree is walked with whole blocks of queries; every query reaches
    the leaves the relaxed rule leaves it, and each leaf is one matrix product.
    """
    rng = np.random.default_rng(seed)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            vp, d = best_vantage(points[p], rng)
            mu = float(np.median(d))
            near = d <= mu
            if near.all():  # more than half at one distance: no cut
                near = d < mu
            if near.any() and not near.all():
                gap = distance(queries[q], vp) - mu
                todo.append((p[near], q[gap <= slack]))
                todo.append((p[~near], q[gap > -slack]))
                continue
        for lo in range(0, len(q), 4096):
            qs = q[lo : lo + 4096]
            for plo in range(0, len(p), 4096):
                ps = p[plo : plo + 4096]
                sims = queries[qs] @ points[ps].T
                i, j = np.nonzero(sims >= least - 1e-4)
                keep = ps[j] != same[qs[i]]
                i, j = i[keep], j[keep]
                if len(i) > k * len(qs):  # dense: only the best k of the block
                    order = np.lexsort((j, -sims[i, j], i))
                    i, j = i[order], j[order]
                    first = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
                    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
                    i, j = i[rank < k], j[rank < k]
                if len(i):
                    qi, pj = qs[i], ps[j]
                    exact = np.einsum("ij,ij->i", queries[qi].astype(np.float64), points[pj].astype(np.float64))
                    hits.append((qi, pj, exact))
    if not hits:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    qi, pj, s = (np.concatenate(c) for c in zip(*hits))
    order = np.lexsort((pj, -s, qi))
    qi, pj, s = qi[order], pj[order], s[order]
    first = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
    keep = (rank < k) & (s >= least)
    return qi[keep], pj[keep], s[keep]


def search_open(points: np.ndarray, queries: np.ndarray, same: np.ndarray, k: int, relax: float, floor: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, sim) of the k most similar points of each query, however unlike, itself left out.

    ``floor[i]`` is a similarity that k other points are known to reach, or -1. Only a point below it may be left out.
    """
    wide = k + 3  # spare ones, as the order by float32 products is not exact
    floor = floor.astype(np.float64)
    for first in (True, False):  # the own leaf alone, for a radius to begin with; then the walk
        rng = np.random.default_rng(seed)
        best = np.full((len(queries), wide), -2.0, np.float32)
        at = np.full((len(queries), wide), -1, np.int64)
        todo = [(np.arange(len(points)), np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            p, q, beyond = todo.pop()
            if not first:
                q = q[beyond <= radius(floor[q]) / relax]  # the radius may have shrunk since
            if not len(p) or not len(q):
                continue
            if len(p) > LEAF:
                vp, d = best_vantage(points[p], rng)
                mu = float(np.median(d))
                near = d <= mu
                if near.all():  # more than half at one distance: no cut
                    near = d < mu
                if near.any() and not near.all():
                    gap = distance(queries[q], vp) - mu
                    slack = 0.0 if first else radius(floor[q]) / relax
                    inner, outer = gap <= slack, gap > -slack
                    todo.append((p[near], q[inner], np.maximum(gap[inner], 0.0)))
                    todo.append((p[~near], q[outer], np.maximum(-gap[outer], 0.0)))
                    continue
            for lo in range(0, len(q), 1024):
                qs = q[lo : lo + 1024]
                for plo in range(0, len(p), 4096):
                    ps = p[plo : plo + 4096]
                    sims = queries[qs] @ points[ps].T
                    sims[ps[None, :] == same[qs][:, None]] = -2.0
                    s = np.concatenate([best[qs], sims], axis=1)
                    w = np.concatenate([at[qs], np.broadcast_to(ps, sims.shape)], axis=1)
                    take = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
                    best[qs], at[qs] = np.take_along_axis(s, take, 1), np.take_along_axis(w, take, 1)
                    floor[qs] = np.maximum(floor[qs], np.sort(best[qs], axis=1)[:, -k] - 1e-4)
    best[at < 0] = -2.0
    qi, j = np.nonzero(best >= -1.5)
    pj = at[qi, j]
    s = np.einsum("ij,ij->i", queries[qi].astype(np.float64), points[pj].astype(np.float64))
    order = np.lexsort((pj, -s, qi))
    qi, pj, s = qi[order], pj[order], s[order]
    begin = np.r_[0, np.flatnonzero(np.diff(qi)) + 1] if len(qi) else np.empty(0, np.int64)
    keep = np.arange(len(qi)) - np.repeat(begin, np.diff(np.r_[begin, len(qi)])) < k
    return qi[keep], pj[keep], s[keep]


def radius(sim: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors of similarity ``sim``."""
    return np.sqrt(np.maximum(2.0 - 2.0 * np.maximum(sim, -1.0), 0.0))


def neighbours(vectors: DataFrame, key: str, k: int = 5, least: float | None = 0.9, relax: float = 4.0, queries: DataFrame | None = None, shard_rows: int = SHARD) -> DataFrame:
    """(key, other, sim): the up to k most similar other records with sim >= least, ties by id.

    ``vectors`` come from :func:`usable`. ``least`` sets the search radius sqrt(2 - 2 least); None asks for the
    k most similar however unlike they are. ``queries`` (a subset of the
    rows, given by key) restricts who asks, not who is found. An empty table gives no row.
    """
    spark = vectors.sparkSession
    # equal vectors: one class each, with its first k + 1 ids; the window keeps k + 1 rows a group while it sorts
    w = Window.partitionBy("vec").orderBy(key)
    ranked = vectors.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    classes = stage(ranked.groupBy("vec").agg(F.array_sort(F.collect_list(key)).alias("ids")).withColumn("cls", F.element_at("ids", 1)), "classes")
    total = classes.count()
    if not total:
        return vectors.select(key, F.col(key).alias("other"), F.lit(0.0).alias("sim")).limit(0)
    shards = max(1, -(-total // shard_rows))
    sample = max(SAMPLE, 64 * shards)  # so many rows fit the top tree; 16 KB a shard on the driver
    share = min(1.0, sample / total)
    picked = classes.select("vec").where(F.pmod(F.xxhash64("vec", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * sample).toPandas()
    top = spark.sparkContext.broadcast(TopTree(matrix(sorted(picked["vec"])) if len(picked) else np.empty((0, DIM), np.float32), shards))
    slack = 0.0 if least is None else float(np.sqrt(max(0.0, 2.0 - 2.0 * least))) / relax

    def route(width: float, mark: int, by_floor: bool = False):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x = matrix(batch["vec"])
                for shard, rows in top.value.route(x, radius(batch["floor"].to_numpy()) / relax if by_floor else width):
                    out = pd.DataFrame({"shard": shard, "cls": batch["cls"].to_numpy()[rows], "vec": batch["vec"].to_numpy()[rows], "asks": mark})
                    yield out.assign(floor=batch["floor"].to_numpy()[rows] if by_floor else -1.0) if least is None else out

        return run

    schema = "shard int, cls string, vec binary, asks int" + (", floor double" if least is None else "")
    asking = classes.select("cls", "vec", "ids")
    if queries is not None:
        ids = classes.select("cls", F.explode("ids").alias(key)).join(queries.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")
        asking = asking.join(ids.select("cls").distinct(), "cls", "left_semi")
    asks = total if queries is None else asking.count()
    salts = max(1, -(-3 * asks // (2 * shards * QUERY_BLOCK)))
    mine = F.pmod(F.xxhash64("cls", F.lit(13)), F.lit(salts)).cast("int")
    stored = classes.select("cls", "vec").mapInPandas(route(0.0, 0), schema).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    visits = asking.select("cls", "vec").mapInPandas(route(slack, 1), schema).withColumn("salt", mine)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls", kind="stable", ignore_index=True)  # the same tree whatever order the rows come in
        asks = group["asks"].to_numpy() == 1
        pid, qid = group["cls"].to_numpy()[~asks], group["cls"].to_numpy()[asks]
        if not len(pid) or not len(qid):
            return pd.DataFrame({"cls": pd.Series([], dtype=object), "near": pd.Series([], dtype=object), "sim": pd.Series([], dtype=float)})
        vec = group["vec"].to_numpy()
        at = {c: i for i, c in enumerate(pid)}
        same = np.array([at.get(c, -1) for c in qid], np.int64)
        if least is None:
            qi, pj, s = search_open(matrix(vec[~asks]), matrix(vec[asks]), same, k, relax, group["floor"].to_numpy()[asks])
        else:
            qi, pj, s = search_shard(matrix(vec[~asks]), matrix(vec[asks]), same, k, least, slack)
        return pd.DataFrame({"cls": qid[qi], "near": pid[pj], "sim": s})

    found = "cls string, near string, sim double"
    if least is None and top.value.depth:  # the own shard first; a shard with fewer than k others leaves the radius open
        kth = stored.union(visits).groupBy("shard", "salt").applyInPandas(search, found).groupBy("cls").agg(F.when(F.count("*") >= k, F.min("sim")).alias("floor"))
        known = stage(asking.select("cls", "vec").join(kth, "cls", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)) - 1e-4), "radius")
        visits = known.mapInPandas(route(0.0, 1, True), schema).withColumn("salt", mine)
    met = stored.union(visits).groupBy("shard", "salt").applyInPandas(search, found)
    return expand(classes, met, vectors, key, k, queries)


def expand(classes: DataFrame, met: DataFrame, vectors: DataFrame, key: str, k: int, queries: DataFrame | None) -> DataFrame:
    """Neighbour classes back to records: (key, other, sim), k a record, own copies first, ties by id."""
    w = Window.partitionBy("cls").orderBy(F.desc("sim"), "near")
    best = met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("cls", "near", "sim")
    ids = classes.select(F.col("cls").alias("near"), F.col("ids").alias("near_ids"))
    own = classes.select("cls", "ids", F.col("ids").alias("near_ids"), F.lit(1.0).alias("sim")).where(F.size("ids") > 1)
    far = best.join(ids, "near").join(classes.select("cls", "ids"), "cls").select("cls", "ids", "near_ids", "sim")
    rows = far.unionByName(own).select(F.explode("ids").alias(key), "near_ids", "sim").select(key, F.explode("near_ids").alias("other"), "sim").where(F.col(key) != F.col("other"))
    top = Window.partitionBy(key).orderBy(F.desc("sim"), "other")
    out = rows.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select(key, "other", "sim")
    # copies beyond the first k + 1 of a class: their k nearest are the class's first k ids
    full = classes.where(F.size("ids") > k).select("vec", "ids")
    rest = vectors.join(full, "vec").where(~F.array_contains("ids", F.col(key))).select(key, F.explode(F.slice("ids", 1, k)).alias("other"), F.lit(1.0).alias("sim"))
    out = out.union(rest)
    if queries is not None:
        out = out.join(queries.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")
    return out


def exact_neighbours(vectors: DataFrame, key: str, queries: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """Brute force for a stated query set: every shard of vectors meets every block of queries; per-shard top k, then merged."""
    n = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    q = vectors.join(queries.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")
    blocks = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(max(1, -(-q.count() // block)))).cast("int")
    q = q.withColumn("block", blocks).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("part", "block", key, "vec")
    nb = q.select("block").distinct().count()
    v = vectors.withColumn("part", F.pmod(F.xxhash64(key, F.lit(9)), F.lit(n)).cast("int"))
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, nb - 1))))).select("part", "block", key, "vec")

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy() == 1
        if not asks.any() or asks.all():
            return pd.DataFrame({key: pd.Series([], dtype=object), "other": pd.Series([], dtype=object), "sim": pd.Series([], dtype=float)})
        ids, vec = group[key].to_numpy(), group["vec"].to_numpy()
        x, p, xi, pi = matrix(vec[asks]), matrix(vec[~asks]), ids[asks], ids[~asks]
        out = []
        for lo in range(0, len(x), 256):
            s = x[lo : lo + 256] @ p.T
            take = np.argpartition(-s, min(k + 1, s.shape[1] - 1), axis=1)[:, : k + 1]
            i = np.repeat(np.arange(len(s)), take.shape[1])
            out.append(pd.DataFrame({key: xi[lo + i], "other": pi[take.ravel()], "sim": np.einsum("ij,ij->i", x[lo + i].astype(float), p[take.ravel()].astype(float))}))
        r = pd.concat(out)
        return r[r[key] != r["other"]]

    both = q.withColumn("asks", F.lit(1)).unionByName(v.withColumn("asks", F.lit(0)))
    met = both.groupBy("part", "block").applyInPandas(scan, f"{key} string, other string, sim double")
    w = Window.partitionBy(key).orderBy(F.desc("sim"), "other")
    return met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(key, "other", "sim")


def every_twentieth(vectors: DataFrame, key: str) -> DataFrame:
    """The stated query set: records whose id, a UUID read as a number, is divisible by 20.

    16 is 4 * 4, so a hexadecimal number is divisible by 4 if its last digit is, and by 5 if its digit sum is (16 leaves 1).
    """
    digits = F.filter(F.split(F.regexp_replace(F.lower(key), "[^0-9a-f]", ""), ""), lambda c: c != "")
    value = lambda c: F.conv(c, 16, 10).cast("int")
    total = F.aggregate(digits, F.lit(0), lambda a, c: a + value(c))
    return vectors.where((F.size(digits) > 0) & (total % 5 == 0) & (value(F.element_at(digits, -1)) % 4 == 0)).select(key)


def recall(approx: DataFrame, exact: DataFrame, key: str, least: float) -> DataFrame:
    """(queries, true_links, found_links, missed_share) over the exact links with sim >= least."""
    true = exact.where(F.col("sim") >= least).select(key, "other")
    hit = true.join(approx.select(key, "other").distinct().withColumn("hit", F.lit(1)), [key, "other"], "left")
    n = hit.agg(F.countDistinct(key).alias("queries"), F.count("*").alias("true_links"), F.count("hit").alias("found_links"))
    return n.withColumn("missed_share", F.round(F.lit(1.0) - F.try_divide(F.col("found_links").cast("double"), F.col("true_links")), 4))
