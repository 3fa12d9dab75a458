"""The Gaussian product by moments: all pairs to a double's rounding, in work that grows with the points."""

import math

import numpy as np
import pytest

from latticework.operators import nbody
from latticework.plans import points


def _frame(spark, p, q):
    return spark.createDataFrame([(k, None if x is None else [float(c) for c in x], float(w)) for k, (x, w) in enumerate(zip(p, q))], "id long, p array<double>, q double")


def _exact(p, q, length, mu):
    return [math.fsum(w * (1.0 + mu if i == j else math.exp(-math.fsum((a - b) ** 2 for a, b in zip(x, y)) / length**2)) for j, (y, w) in enumerate(zip(p, q))) for i, x in enumerate(p)]


@pytest.mark.parametrize("spread, offset, dims", [(0.4, 0.0, 3), (1.0, 1e3, 3), (2.0, -7.0, 2), (3.0, 0.0, 1), (0.0, 2.0, 3)])
def test_moments_give_all_pairs_to_rounding(spark, monkeypatch, spread, offset, dims):
    rng = np.random.default_rng(12)
    p, q = (rng.random((150, dims)) * 2 - 1) * spread + offset, rng.normal(size=150) * 1e3
    p[3] = p[4]  # two points at one place
    monkeypatch.setattr(nbody, "kernel_matvec", None)
    monkeypatch.setattr(nbody, "MOMENT_TILE", 5000)
    got = {r["id"]: r["v"] for r in nbody.gauss_matvec(_frame(spark, p, q), 2.0, 0.01).collect()}
    error = np.abs(np.array([got[k] for k in range(150)]) - _exact(p, q, 2.0, 0.01)).max()
    assert error < 1e-15 * np.abs(q).sum()


def test_far_points_and_many_coordinates_meet_in_pairs(spark):
    rng = np.random.default_rng(13)
    for p in (rng.random((40, 3)) * 100, rng.random((40, 12)), np.zeros((1, 3)), np.zeros((0, 3))):
        q = rng.normal(size=len(p))
        got = {r["id"]: r["v"] for r in nbody.gauss_matvec(_frame(spark, p, q), 2.0, 0.01).collect()}
        assert [got[k] for k in range(len(p))] == pytest.approx(_exact(p, q, 2.0, 0.01), abs=1e-12)


def test_degree_bounds_what_is_left_out():
    for reach in (0.0, 0.3, 1.0, 3.0):
        m = nbody.gauss_degree(reach)
        rest = (reach * reach) ** (m + 1) / math.factorial(m + 1)
        assert rest <= 2.0**-60 and (m == 0 or (reach * reach) ** m / math.factorial(m) > 2.0**-60)
    assert len(nbody.gauss_terms(3, 14)) == math.comb(17, 3)


def test_the_solver_makes_no_pairs(spark, tmp_path, monkeypatch):
    """The products of nested_solve go by moments: with a pair product they took squares of the points."""
    rng = np.random.default_rng(14)
    vectors = [(k, [float(x) for x in rng.normal(size=8) * 0.2], 0) for k in range(400)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(nbody, "kernel_matvec", None)
    got = {r["id"]: (r["v"], r["few"]) for r in points.nested_solve(spark, str(tmp_path)).collect()}
    assert got == {k: (float(k % 7), True) for k in range(400)}
