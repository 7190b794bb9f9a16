from collections import Counter

import numpy as np
import pytest

from tidemark.llm import search
from tidemark.llm.search import _Block, candidates, top_products

SCHEMA = "vec_id long, embedding array<double>, score int"


def brute(rows, queries, k):
    """Every query against every row but its own, one by one."""
    grid = lambda v: [int(np.floor(64 * x)) for x in v]
    good = lambda r: r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])
    out = Counter()
    for q in filter(good, queries):
        others = list(filter(good, rows))
        others.remove(q)
        scored = sorted((-sum(a * b for a, b in zip(grid(q[1]), grid(p[1]))), p[0]) for p in others if len(p[1]) == len(q[1]))
        out.update((q[0], n, i, -s) for n, (s, i) in enumerate(scored[:k], 1))
    return out


def made(rng, n, d):
    """Vectors of many lengths, near copies and exact ones among them."""
    x = rng.standard_normal((n, d)) * rng.choice([0.02, 0.3, 1.0, 4.0], size=(n, 1))
    x[n // 2 : n // 2 + n // 4] = x[3] + 0.01 * rng.standard_normal((n // 4, d))
    x[-n // 6 :] = x[5]
    return x


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(made(rng, 240, 6))]
    rows += [(40, [1.0] * 6, 1), (40, [1.0] * 6, 1), (60, [0.0] * 6, 1), (61, [1.0, 2.0], 1), (80, [3.0, 1.0], 1), (1000, [1.0] * 9, 1)]
    rows += [(100, None, 1), (101, [], 1), (120, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (140, [float("nan")] * 6, 1), (160, [float("inf")] * 6, 1), (None, [9.0] * 6, 1)]
    monkeypatch.setattr(search, "TILE_ROWS", 16)
    monkeypatch.setattr(search, "SAMPLE", 4)
    table = spark.createDataFrame(rows, SCHEMA)
    got = top_products(table, table.where("vec_id % 20 = 0"), 20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 20)


def test_no_rows_few_rows_and_large_numbers(spark):
    table = spark.createDataFrame([(0, [1e7, -3.0], 1), (20, [2e7, 5.0], 1), (1, [1e7, 1.0], 1)], SCHEMA)
    got = top_products(table, table.where("vec_id % 20 = 0")).collect()
    assert Counter(map(tuple, got)) == brute([tuple(r) for r in table.collect()], [tuple(r) for r in table.where("vec_id <> 1").collect()], 20)
    assert top_products(table.limit(0), table).collect() == [] == top_products(table, table.limit(0)).collect()
    with pytest.raises(OverflowError):
        list(candidates(block(np.array([[1 << 40]])), block(np.array([[1 << 40]])), np.array([-np.inf]), 1))


def block(x):
    order = np.argsort(-(x.astype(float) ** 2).sum(axis=1), kind="stable")
    return _Block(x.shape[1], np.arange(len(x), dtype=np.int64).tobytes(), x[order].astype(np.int64).tobytes())


def test_pruning_loses_nothing_and_prunes():
    """Both ways of pruning, at thresholds from none to steep, keep each pair that reaches its threshold."""
    rng = np.random.default_rng(2)
    x = np.floor(64 * made(rng, 600, 12)).astype(np.int64)
    q, p = block(x[::7]), block(x)
    scores = q.whole @ p.whole.T
    for share in (-0.5, 0.0, 0.3, 0.8, 0.95, 0.999, 1.2):
        least = share * q.length * p.length[0]
        row, column, found = candidates(q, p, least, 20)
        assert {*zip(row.tolist(), column.tolist())} == {*zip(*(a.tolist() for a in np.nonzero(scores >= least[:, None])))}
        assert np.array_equal(scores[row, column], found)
    alive = np.ones(len(q.ids), dtype=bool)
    rows, _ = search._by_coordinate(q, p, np.flatnonzero(q.length > 0), np.full(len(q.ids), 0.97), alive)
    assert alive.sum() < len(alive) and len(rows) < 0.3 * scores.size
