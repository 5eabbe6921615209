"""Problems 1, 4 and 6 against brute force on small fixtures, with nulls, ties, copies, long texts and clashing columns."""

import datetime as dt
import random

import numpy as np
import pytest

from tessera.llm import history, neardup, neighbours
from tessera.llm.components import components

CHUNKS = "chunk_id string, content string, cls string, n int, blob string, a string"


def shingles(text):
    import re

    t = re.findall("[a-z0-9_]+", text.lower())
    return set(zip(t, t[1:], t[2:])) if len(t) >= 30 else set()


def alike(x, y):
    a, b = shingles(x), shingles(y)
    return bool(a and b) and len(a & b) >= 0.7 * len(a | b) - 1e-12


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    out = {}
    for f in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        for v in range(6):
            t = list(base)
            for _ in range(v * 2):
                t[rng.randrange(len(t))] = rng.choice(words)
            out[f"id{f:02}-{v}"] = " ".join(t) + ("" if v % 2 else " \r\n")
    out |= {"short": "a b c", "empty": "", "null": None, "long": "x y z " * 200_000, "long2": "x  Y z " * 200_000, "uni": "é " * 40}
    return out


def test_similar_pairs(spark, texts):
    rows = [(k, t, "c", 1, "b", "a") for k, t in texts.items()] * 2 + [(None, "w " * 50, "c", 1, "b", "a")]
    df = spark.createDataFrame(rows, CHUNKS)
    ids = sorted(k for k, t in texts.items() if t)
    want = {(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :] if alike(texts[x], texts[y])}
    got = neardup.similar_pairs(df, "chunk_id", "content").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and ("long", "long2") in want and len(want) > 15
    groups = {r.chunk_id: r for r in neardup.similar_groups(df, "chunk_id", "content").collect()}
    for k in groups:
        assert groups[k].n_links == sum(k in p for p in want)
    assert all(groups[x].group_id == groups[y].group_id for x, y in want)
    assert neardup.similar_pairs(df.limit(0), "chunk_id", "content").count() == 0
    assert neardup.similar_groups(df.limit(0), "chunk_id", "content").count() == 0


def test_prefix_levels_lose_nothing():
    assert neardup.prefix_level(np.array([0.0] * 10), 3) == 1  # nobody else holds the elements
    assert neardup.prefix_level(np.array([500.0] * 10), 3) > 1


def test_split_tokens(spark, texts):
    """Tokens split into blocks of two holders give the pairs of unsplit ones."""
    df = spark.createDataFrame([(k, t) for k, t in texts.items() if t], "chunk_id string, content string")
    sig = neardup.stage(neardup.signatures(df, "chunk_id", "content"), "sig")
    whole, split = ({tuple(r) for r in neardup.verify(neardup.candidates(neardup.classes_of(sig), 0.7, block), neardup.classes_of(sig), 0.7).select("a", "b").collect()} for block in (2048, 2))
    assert whole == split and len(whole) > 10


def test_count_codes():
    c = np.r_[np.arange(4000), 10**6, 10**9]
    back = neardup.decode_counts(neardup.encode_counts(c))
    assert (back[:9] == c[:9]).all() and (abs(back - c) <= 0.05 * c + 0.5).all() and (np.diff(back) >= 0).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def vectors(spark, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, 64))
    rows = [(f"v{i:03}", (base[i % 40] + rng.standard_normal(64) * 0.12).tolist()) for i in range(240)]
    rows += [(f"copy{i}", base[0].tolist()) for i in range(9)]
    bad = [("null", None), ("short", [1.0] * 63), ("zero", [0.0] * 64), ("nan", [float("nan")] + [1.0] * 63), (None, [1.0] * 64)]
    return rows, spark.createDataFrame([(k, v, "x") for k, v in rows + rows[:5] + bad], "id string, embedding array<float>, vec string")


def test_neighbours(spark, monkeypatch):
    rows, df = vectors(spark)
    v = neighbours.usable(df, "id", "embedding")
    assert v.count() == len(rows)
    ids = [k for k, _ in rows]
    x = np.array([np.array(e, np.float32).astype(float) for _, e in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    want = set()
    for i, k in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 6), ids[j]))[:5]
        want |= {(k, ids[j]) for j in order if s[i, j] >= 0.9}
    exact = {(r.id, r.other) for r in neighbours.neighbours(v, "id", relax=1.0, shard_rows=80).collect()}
    assert exact == want
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)  # several tasks a shard
    assert {(r.id, r.other) for r in neighbours.neighbours(v, "id", relax=1.0, shard_rows=80).collect()} == want
    loose = {(r.id, r.other) for r in neighbours.neighbours(v, "id", shard_rows=80).collect()}
    assert len(loose & want) >= 0.9 * len(want)
    assert neighbours.neighbours(neighbours.usable(df.limit(0), "id", "embedding"), "id").count() == 0
    q = df.where("id = 'v003'").select("id")
    assert {r.id for r in neighbours.neighbours(v, "id", queries=q).collect()} <= {"v003"}
    truth = neighbours.exact_neighbours(v, "id", df.where("id like 'v00%'").select("id").distinct())
    r = neighbours.recall(neighbours.neighbours(v, "id"), truth, "id", 0.9).collect()[0]
    assert r.missed_share <= 0.1


def test_neighbours_however_unlike(spark):
    """All k nearest come out below any similarity, in one shard and in many, smaller than a leaf and larger."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 64)).astype(np.float32)
    x[:300] = x[0] + rng.standard_normal((300, 64)).astype(np.float32) * 0.3
    ids = [f"v{i:03}" for i in range(len(x))]
    v = neighbours.usable(spark.createDataFrame([(k, e.tolist()) for k, e in zip(ids, x)], "id string, embedding array<float>"), "id", "embedding")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:5]}
    assert np.median(np.sort(s, axis=1)[300:, -5]) < 0.4
    for shard_rows in (10_000, 150):
        exact = [(r.id, r.other) for r in neighbours.neighbours(v, "id", least=None, relax=1.0, shard_rows=shard_rows).collect()]
        assert len(exact) == len(set(exact)) and set(exact) == want
        loose = [r.id for r in neighbours.neighbours(v, "id", least=None, relax=3.0, shard_rows=shard_rows).collect()]
        assert sorted(loose) == sorted(ids * 5)
    few = neighbours.neighbours(v.where("id < 'v004'"), "id", least=None, relax=3.0, shard_rows=2)
    assert few.count() == 12


def test_every_twentieth(spark):
    import uuid

    ids = [str(uuid.UUID(int=random.Random(i).getrandbits(128))) for i in range(400)]
    got = {r.id for r in neighbours.every_twentieth(spark.createDataFrame([(i,) for i in ids], "id string"), "id").collect()}
    assert got == {i for i in ids if uuid.UUID(i).int % 20 == 0}


def test_replay(spark, texts):
    rng = random.Random(9)
    keys = [k for k, t in texts.items() if t is not None]
    runs = [(f"C{i}", dt.datetime(2024, 1, 1 + i)) for i in range(8)]
    rows = []
    for n in range(160):
        k = rng.choice(keys)
        commit = rng.choice([None] + [c for c, _ in runs])
        rows.append((f"k{n}", rng.choice([" P1 ", "p2", None]), commit and commit.lower(), rng.choice([f"H{k}", f"h{k}", f"only{n}", None]), texts[k]))
    schema = "chunk_id string, project_id string, commit_hash string, content_hash string, content string"
    chunks = spark.createDataFrame(rows + rows[:4], schema)
    r = spark.createDataFrame(runs + runs[:2], "commit_hash string, received_at timestamp_ntz")
    got = {x.chunk_id for x in history.replay(chunks, r).where("turned_away").collect()}
    order = {c.lower(): at for c, at in runs}
    want = set()
    for p in ("p1", "p2"):
        mine = [x for x in rows if x[1] and x[1].strip().lower() == p]
        kept = []
        for at in sorted({order.get(x[2], dt.datetime.min) for x in mine}):
            new = [x for x in mine if order.get(x[2], dt.datetime.min) == at]
            good = [x for x in new if not any((x[3] and y[3] and x[3].lower() == y[3].lower()) or alike(x[4], y[4]) for y in kept)]
            want |= {x[0] for x in new} - {x[0] for x in good}
            kept += good
    assert got == want and len(want) > 20
    # batches split because too many new texts meet in one range
    assert {x.chunk_id for x in history.replay(chunks, r, slices=2, crowd=3).where("turned_away").collect()} == want
    assert history.replay(chunks.limit(0), r.limit(0)).count() == 0


def test_forest(spark, texts, tmp_path):
    assert history.least_depth() == history.WIDEST
    f = history.SignatureForest(spark, str(tmp_path / "forest"), max_runs=2)
    frame = lambda ks, s="p": spark.createDataFrame([(k, s, texts[k]) for k in ks], "chunk_id string, scope string, content string")
    first = {r.chunk_id: r.accepted for r in f.accept(frame(["id00-0", "id01-0", "short", "null"])).collect()}
    assert all(first.values())
    second = {r.chunk_id: r.accepted for r in f.accept(frame(["id00-1", "id02-0", "short"])).collect()}
    assert second == {"id00-1": not alike(texts["id00-0"], texts["id00-1"]), "id02-0": True, "short": True}
    assert f.accept(frame(["id00-0"], "other")).collect()[0].accepted
    third = {r.chunk_id: r.accepted for r in f.accept(frame(["id02-0", "id01-0"])).collect()}
    assert third == {"id02-0": False, "id01-0": False} and len(f._list("runs")) <= 2


def test_forest_hashes(spark, tmp_path):
    """A text too short for the trees is turned away by its content hash, in its scope and ignoring case; a null hash is no match."""
    f = history.SignatureForest(spark, str(tmp_path / "forest"))
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, scope string, content string, content_hash string")
    took = lambda rows: {r.chunk_id: r.accepted for r in f.accept(frame(rows)).collect()}
    assert took([("a", "p", "x y", "H1"), ("b", "p", "q", None)]) == {"a": True, "b": True}
    assert took([("c", "p", "other", "h1"), ("d", "q", "x y", "h1"), ("e", "p", "q", None), ("f", "p", "z", "h2")]) == {"c": False, "d": True, "e": True, "f": True}
    assert took([("g", "p", "zz", "H2"), ("h", "q", "x y", "H1")]) == {"g": False, "h": False}


def test_recall_of_the_queries(spark):
    """At sf0.1 hardly a link of the stated query set is missed, at 0.90 as for all 5 nearest."""
    from tessera.llm import catalog

    rows = catalog.p4_recall(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 4 and all(r.true_links > 0 and r.missed_share <= 0.002 for r in rows)
