"""Training-data queries agree with their brute-force statements on the smallest tables; helpers against plain loops."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest import DATA
from test_catalog import canon

from tessera.llm import catalog, history, neardup, origin, statements


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_statement(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_every_statement_has_a_query():
    assert {n.lower() for n in vars(statements) if n[0] == "P" and n[1].isdigit()} == set(catalog.oracle_sql())


def test_leaders_reach_every_member():
    """Every member of a bucket is compared with the last leader at or before it in size, unless sizes are too far apart."""
    rng = np.random.default_rng(3)
    band = np.sort(rng.integers(0, 40, 600)).astype(np.int64)
    n = rng.integers(20, 60, 600).astype(np.int32)
    order = np.lexsort((n, band))
    band, n = band[order], n[order]
    c8, bits = np.arange(600, dtype=np.int64), np.zeros(600, np.int64)
    rows, by = origin.leaders(band, n, c8, bits, bits)
    assert (band[rows] == band[by]).all() and (n[by] <= n[rows]).all() and (n[by] >= 0.8 * n[rows] - 1e-9).all()
    assert np.bincount(rows).max() <= 2
    first = np.r_[True, band[1:] != band[:-1]]
    alone = set(range(600)) - set(rows.tolist())
    leads = set(by.tolist())
    assert all(first[i] or i in leads or n[i] > n[i - 1] / origin.LEAD - 1 for i in alone)
    far = np.full(600, (1 << 56) - 1, np.int64)
    far[::2] = 0
    rows, by = origin.leaders(band, n, c8, far, far)
    assert (far[rows] == far[by]).all()


def test_meetings_of_a_range():
    """New entries meet old ones and each other, an old one never an old one; crowds are told, not paired."""
    at = np.array([1, 1, 1, 1, 2, 2, 3], np.int64)
    old = np.array([0, 0, 1, 1, 1, 1, 0], np.int8)
    c8 = np.array([5, 6, 6, 7, 8, 9, 4], np.int64)
    tail = np.array([1, 1, 1, 1 << 17, 0, 0, 0], np.int32)
    pairs = lambda **kw: {tuple(r) for r in history.meet([at, old, c8, tail], kw.get("crowd", 9), kw.get("apart", False)).to_numpy().tolist()}
    assert pairs() == {(5, 6, 5, 0), (5, 6, 5, 1), (5, 7, 3, 1), (6, 7, 3, 1)}
    with_old = {(5, 6, 5, 1), (5, 7, 3, 1), (6, 6, 5, 1), (6, 7, 3, 1)}
    assert pairs(apart=True) == with_old
    assert pairs(crowd=1) == with_old | {(0, 0, -1, 0)}


def test_meetings_of_a_token():
    """Holders of a token pair once, whatever blocks they are split into."""
    rng = np.random.default_rng(8)
    cls = rng.integers(-(1 << 62), 1 << 62, 50)
    n = np.sort(rng.integers(20, 40, 50)).astype(np.int32)
    want = {(min(a, b), max(a, b)) for i, a in enumerate(cls) for j, b in enumerate(cls) if i < j and n[i] >= 0.7 * n[j] - 1e-9}
    for block in (2048, 20, 7):
        table = np.full(16, 50, np.int32)
        blocks = neardup.blocks_of(table[:1], block)
        rows = [(k, c, m) for c, m in zip(cls, n) for k in neardup.spread(np.array([3], np.uint64), blocks, int(c))]
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        key, c, m = (np.array(x) for x in zip(*rows))
        a, b, _ = neardup.meetings(key.astype(np.int64), c.astype(np.int64), m, np.ones(len(m), np.int8), table, 0.7, block)
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == {(int(x), int(y)) for x, y in want}
