import numpy as np
import pytest

from tidemark.llm.queries import QUERIES
from tidemark.llm.whitening import leading, whiten

SCHEMA = "vec_id long, embedding array<float>, whitened int"


def table(spark, vectors, more=()):
    return spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)] + list(more), SCHEMA).repartition(5)


def plain(vectors, count):
    """x, S and the leading eigenpairs by numpy's own solver, on the whole matrix."""
    x = np.floor(64 * np.asarray(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    y = x - x.sum(axis=0) / len(x)
    values, axes = np.linalg.eigh(y.T @ y / len(x))
    return x, x.sum(axis=0), y, values[::-1][:count], axes[:, ::-1][:, :count], np.trace(y.T @ y / len(x))


@pytest.mark.parametrize("n, d, components", [(400, 48, 32), (300, 5, 32), (200, 90, 7)])
def test_against_a_full_solver(spark, n, d, components):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((n, d)) * np.linspace(0.2, 3, d)).astype(np.float32)
    vectors[n // 3 : 2 * n // 3] = vectors[0]
    got = whiten(table(spark, vectors), components).toPandas()
    x, sums, y, values, axes, trace = plain(vectors, components)
    count = min(d, components)
    assert len(got) == n * count and (got.n == n).all() and got.identity_error.max() < 1e-9
    deviations = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    assert all(int(r.deviation) == deviations[r.vec_id] for r in got[got.component == 1].itertuples())
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = y @ axes / np.sqrt(values)
    want *= np.sign((white * want).sum(axis=0))
    assert np.abs(white - want).max() < 1e-7
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, values / trace, rtol=1e-9)


def test_leading_without_all_dimensions():
    """The basis is cut back several times, and never spans all."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    values = 0.97 ** np.arange(300)
    matrix, widest = q * values @ q.T, []

    def times(block):
        widest.append(block.shape[1])
        return matrix @ block

    found, axes = leading(times, 300, 4, most_basis=24)
    assert np.allclose(found, values[:4], rtol=1e-12) and np.abs(np.abs((q[:, :4] * axes).sum(axis=0)) - 1).max() < 1e-12
    assert len(widest) * 4 > 24 and max(widest) == 4


@pytest.mark.parametrize("values", [np.ones(40), np.r_[np.full(6, 5.0), np.zeros(34)], np.r_[3.0, np.zeros(39)], np.zeros(40)])
def test_breakdowns(values):
    """Invariant blocks from the first step on: equal eigenvalues, few ranks, nothing at all."""
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))
    matrix = q * values @ q.T
    found, axes = leading(lambda b: matrix @ b, 40, 8)
    assert np.allclose(found, values[:8], atol=1e-12) and np.allclose(axes.T @ axes, np.eye(8), atol=1e-12)
    assert np.abs(matrix @ axes - axes * found).max() < 1e-12


def test_rows(spark):
    """Unusable vectors take no part; null and repeated ids stay; without variance there are no components."""
    rng = np.random.default_rng(5)
    good = rng.standard_normal((30, 3)).astype(np.float32)
    bad = [(90, None, 1), (91, [], 1), (92, [1.0, None, 1.0], 1), (93, [1.0, float("nan"), 1.0], 1), (94, [float("-inf"), 1.0, 1.0], 1)]
    twice = [(None, [float(x) for x in good[0]], 1), (7, [float(x) for x in good[7]], 1)]
    got = whiten(table(spark, good, bad + twice))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.toPandas()
    assert len(rows) == 32 * 3 and rows.vec_id.isna().sum() == 3 and (rows.vec_id == 7).sum() == 6 and (rows.n == 32).all()
    assert abs(rows.groupby("component").explained.first().sum() - 1) < 1e-9
    flat = [[a, a, 2.0] for a in (1.0, 2.0, 4.0)]  # one direction only
    assert {r["component"] for r in whiten(table(spark, flat)).collect()} == {1}
    for none in ([[1.0, 2.0]], [[1.0, 2.0]] * 5, []):
        assert whiten(table(spark, none, bad)).collect() == []
    with pytest.raises(ValueError):
        whiten(table(spark, [[1.0], [1.0, 2.0]]))
    large = whiten(table(spark, [[3e9, 1.0], [-3e9, 0.0], [5e8, 7.0]]), 1).collect()
    assert len(large) == 3 and all(r["deviation"] > 2**63 for r in large if r["vec_id"] < 2)


def test_query(spark):
    got = QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 500 * 32 and str(got.deviation.dtype) == "int64" and got.identity_error.max() < 1e-9
    assert got.explained.between(0, 1).all() and (got[got.vec_id == 0].explained.diff().dropna() <= 1e-15).all()
    assert np.allclose(got.groupby("component").whitened.agg(lambda w: (w**2).mean()), 1)
