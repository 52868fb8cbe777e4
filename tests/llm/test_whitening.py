from fractions import Fraction

import numpy as np
import pytest

from quernel.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, deviation string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def brute(vectors):
    """n, exact deviations, eigenvalues, components and trace of what is usable, by one dense decomposition."""
    x = np.floor(np.array(vectors, np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    c = np.array([[float(Fraction(n * int(a) - int(b), n)) for a, b in zip(row, s)] for row in x])
    values, axes = np.linalg.eigh(c.T @ c / n)
    return n, deviation, values[::-1], axes[:, ::-1], c


def compare(rows, vectors, k):
    n, deviation, values, axes, c = brute(vectors)
    want = c @ axes[:, :k] / np.sqrt(values[:k])
    got = np.zeros_like(want)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9 and r.identity_error <= 1e-8
    assert len(rows) == len(vectors) * k
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-6


@pytest.mark.parametrize("n, d, spread", [(300, 64, "flat"), (200, 96, "steep"), (400, 20, "flat"), (150, 64, "steep")])
def test_equals_a_dense_decomposition(spark, n, d, spread):
    rng = np.random.default_rng(n + d)
    scale = np.ones(d) * 2 if spread == "flat" else 40.0 * 0.8 ** np.arange(d) + 0.05
    vectors = (rng.standard_normal((n, d)) * scale @ np.linalg.qr(rng.standard_normal((d, d)))[0]).astype(np.float32).tolist()
    compare(whitening.whiten(frame(spark, vectors).repartition(5)).collect(), vectors, min(32, d))


def test_steep_spectra_need_no_full_width(spark):
    rng = np.random.default_rng(5)
    d = 160
    scale = np.where(np.arange(d) < 32, 400.0 * 0.9 ** np.arange(d), 0.02)
    vectors = (rng.standard_normal((400, d)) * scale @ np.linalg.qr(rng.standard_normal((d, d)))[0]).astype(np.float32).tolist()
    found = whitening.fit(frame(spark, vectors))
    assert found.width < d and found.residual <= whitening.TOLERANCE
    compare(whitening.whiten(frame(spark, vectors)).collect(), vectors, 32)


def test_unusable_repeated_and_degenerate(spark):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((40, 3)).astype(np.float32).tolist()
    good[7] = good[6]
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0]]
    rows = whitening.whiten(frame(spark, good + odd, [*range(40), None, None, 98, 99, 100])).collect()
    compare(rows, good, 3)
    flat = [[*v, 5.0] for v in good]  # an entry that doesn't vary is no component
    assert {r.component for r in whitening.whiten(frame(spark, flat)).collect()} == {1, 2, 3}
    assert len(whitening.whiten(frame(spark, good[:3])).collect()) == 3 * 2
    assert whitening.whiten(frame(spark, [good[0]] * 5)).count() == 0
    none = whitening.whiten(frame(spark, []))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError):
        whitening.fit(frame(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(ValueError):
        whitening.fit(frame(spark, [[1e30], [2.0]]))


def test_query(spark):
    rows = whitening.op12_whitening(spark, "/root/testdata/sf0.001").collect()
    vectors = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()]
    compare(rows, vectors, 32)
