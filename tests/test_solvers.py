import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import factor, grid, solve
from latticework.streaming import channel
from latticework.tables import cut

SIZES, BCS, CELL = (3, 3, 3), (1, 1, 1), (1.0, 1.0, 1.0)


@pytest.fixture(scope="module")
def system(spark):
    offsets = [(a, b, c, -w) for a, b, c, w in grid.laplacian_offsets(SIZES, BCS, CELL, 1)]
    a = cut(grid.stencil_coo(spark, offsets, SIZES, BCS).coalesce(1))
    b = cut(spark.range(27).select(F.col("id").alias("i"), (F.col("id") % 5 - 1).cast("double").alias("v")).coalesce(1))
    dense = np.zeros((27, 27))
    for r in a.collect():
        dense[r["i"], r["j"]] = r["v"]
    want = np.linalg.solve(dense, [(k % 5) - 1 for k in range(27)])
    return solve.operator(a), b, want, dense[0, 0]


def vector(df):
    return np.array([r["v"] for r in df.orderBy("i").collect()])


def test_conjugate_gradient(system):
    apply, b, want, _ = system
    s = solve.conjugate_gradient(apply, b, 1e-9, 12)
    assert s.converged and vector(s.x) == pytest.approx(want, abs=1e-7)


def test_preconditioned_from_a_guess(system):
    apply, b, want, d = system
    s = solve.conjugate_gradient(apply, b, 1e-9, 12, x0=b, precondition=lambda r: r.select("i", (F.col("v") / d).alias("v")))
    assert s.converged and vector(s.x) == pytest.approx(want, abs=1e-7)


def test_bicgstab(system):
    apply, b, want, _ = system
    s = solve.bicgstab(apply, b, 1e-9, 12)
    assert s.converged and vector(s.x) == pytest.approx(want, abs=1e-7)


def test_anderson_richardson(system):
    apply, b, want, d = system
    s = solve.anderson_richardson(apply, b, d, 1e-4, 18)
    assert s.residuals[-1] < 1e-2 * s.residuals[0]
    assert vector(s.x) == pytest.approx(want, abs=1e-1 * np.abs(want).max())


def test_gmres_with_restart(system):
    apply, b, want, _ = system
    s = solve.gmres(apply, b, 6, 1e-6, 12)
    assert s.residuals[-1] < 1e-2 * s.residuals[0]


def test_zero_right_hand_side(system):
    apply, b, _, _ = system
    s = solve.conjugate_gradient(apply, b.withColumn("v", F.lit(0.0)), 1e-9, 5)
    assert s.converged and s.iterations == 0


def test_power_iteration(system, spark):
    apply, b, _, _ = system
    x, norm = solve.power_iteration(apply, b, 3)
    assert np.linalg.norm(vector(x)) == pytest.approx(1.0) and norm > 0


def test_multigrid_converges_on_a_periodic_grid(spark):
    sizes = (4, 4, 4)
    m = solve.Multigrid(spark, sizes, (0, 0, 0), (2.0, 2.0, 2.0), 1, 1)
    b = spark.range(64).select(F.col("id").alias("i"), (F.col("id") % 11).cast("double").alias("v"))
    s = m.solve(b, 1e-3, 3, project=True)
    assert s.residuals[-1] < 0.2 * s.residuals[0]


def test_jacobi_residuals_fall(spark):
    _, norms = grid.jacobi(spark, 6, 5, 4)
    assert norms == sorted(norms, reverse=True)


# ---- dense kernels ----


def symmetric(n, seed=0):
    a = np.random.default_rng(seed).normal(size=(n, n))
    return a + a.T


@pytest.mark.parametrize("n,panel", [(9, 4), (16, 5), (7, 7)])
def test_blocked_qr(n, panel):
    a = np.random.default_rng(n).normal(size=(n + 6, n))
    q, r = factor.blocked_qr(a, panel)
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(n + 6)) and np.allclose(r, np.triu(r))
    reflectors, r2 = factor.householder_qr(a)
    assert np.allclose(factor.apply_q(reflectors, r2), a)
    assert np.allclose(factor.apply_q(reflectors, factor.apply_q(reflectors, a), transpose=True), a)


@pytest.mark.parametrize("n,width", [(8, 2), (13, 3), (20, 4), (3, 1)])
def test_two_stage_tridiagonalization(n, width):
    a = symmetric(n)
    q, t = factor.two_stage(a, width)
    assert np.allclose(q @ t @ q.T, a) and np.allclose(q.T @ q, np.eye(n))
    assert np.allclose(np.linalg.eigvalsh(t), np.linalg.eigvalsh(a))
    q, t = factor.tridiagonalize(a)
    assert np.allclose(q @ t @ q.T, a)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 33])
def test_divide_and_conquer(n):
    rng = np.random.default_rng(n)
    for d, e in ((rng.normal(size=n), rng.normal(size=max(0, n - 1))), (np.ones(n), np.zeros(max(0, n - 1))), (np.full(n, 2.0), np.full(max(0, n - 1), -1.0))):
        t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
        w, v = factor.tridiagonal_eigh(d, e)
        assert np.allclose(w, np.linalg.eigvalsh(t), atol=1e-9)
        assert np.abs(t @ v - v * w).max() < 1e-8 and np.abs(v.T @ v - np.eye(n)).max() < 1e-8


def test_inverses_and_generalized_eigenproblem():
    a = symmetric(11, 3)
    spd = a @ a + np.eye(11)
    assert np.allclose(factor.lu_inverse(a) @ a, np.eye(11))
    assert np.allclose(factor.cholesky_inverse(spd) @ spd, np.eye(11))
    assert np.allclose(factor.gauss_jordan_inverse(spd, 4) @ spd, np.eye(11))
    w, v = factor.generalized_eigh(a, spd)
    assert np.allclose(a @ v, spd @ v * w)


def test_pivoted_qr_finds_the_rank():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(12, 3)) @ rng.normal(size=(3, 6))
    q, r, order, rank = factor.pivoted_qr(a, 1e-10)
    assert rank == 3 and np.allclose(q @ r, a[:, order])
    assert (np.diff(np.abs(np.diag(r))[:3]) <= 1e-12).all()


def test_tall_factorizations(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(a)], "i long, v array<double>").repartition(3)
    for q, r in (factor.cholesky_qr2(rows), factor.tall_qr(rows), factor.block_gram_schmidt(rows, 5, 2)):
        m = np.array([x["v"] for x in q.orderBy("i").collect()])
        assert np.allclose(m @ r, a) and np.allclose(m.T @ m, np.eye(5))
    r, order, rank = factor.tall_pivoted(rows)
    assert rank == 5 and np.allclose(np.abs(np.diag(r)), np.abs(np.diag(factor.pivoted_qr(a)[1])[:5]))


# ---- stream ----


def test_channel_drains_in_order(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("issue_idx"), F.col("id").cast("double").alias("value")).repartition(5).write.parquet(str(tmp_path / "in"))
    seen, total = [], [0.0]

    def consume(batch, k):
        rows = batch.collect()
        seen.append([r["issue_idx"] for r in rows])
        total[0] += sum(r["value"] for r in rows)

    stream = channel.file_source(spark, str(tmp_path / "in"), 2)
    assert channel.drain(stream, consume, str(tmp_path / "state"), 120)
    assert len(seen) > 1 and all(s == sorted(s) for s in seen) and total[0] == 99 * 100 / 2


def test_ring_flags_turn(spark):
    rows = channel.produce(spark.range(12).select(F.col("id").alias("issue_idx"), F.lit(1.0).alias("value")), 2).orderBy("issue_idx").collect()
    assert [r["slot"] for r in rows] == [0, 1, 2, 3] * 3
    assert [r["flag"] for r in rows] == [1] * 4 + [0] * 4 + [1] * 4


def test_dense_queries_take_whole_vectors(spark, tmp_path):
    """Forty columns, of which the last depends on two others."""
    from latticework.plans import dense

    x = np.random.default_rng(6).normal(size=(120, 40)).astype(np.float32)
    x[:, 39] = x[:, 3] + x[:, 30]
    x = x.astype(float)
    spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = np.sort(np.linalg.svd(x, compute_uv=False) ** 2)[::-1]
    top = dense.eigh_topk(spark, str(tmp_path)).orderBy("k").collect()
    assert [r["eigenvalue"] for r in top] == pytest.approx(want[:10], rel=1e-6) and all(r["residual"] < 1e-6 for r in top)
    assert dense.eigh_sum_whole(spark, str(tmp_path)).first()[0] == pytest.approx(want.sum(), abs=1e-3)
    r = dense.pivoted_qr(spark, str(tmp_path)).collect()
    assert sorted(q["column"] for q in r) == list(range(40)) and np.prod([q["diagonal"] for q in r[:39]]) > 0 and r[39]["diagonal"] < 1e-6
    kernels = {q["kernel"]: q["residual"] for q in dense.dense_kernels(spark, str(tmp_path)).collect()}
    assert len(kernels) == 7 and max(kernels.values()) < 1e-6


def test_multigrid_with_a_large_coarsest_grid(spark, monkeypatch):
    """Where the coarsest grid is above the bound and odd, conjugate gradients solve it."""
    monkeypatch.setattr(solve, "COARSEST", 5)
    m = solve.Multigrid(spark, (6, 6, 2), (1, 1, 1), (2.0, 2.0, 2.0), 1, 1)
    assert m.coarse is None and len(m.m) == 1
    b = spark.range(72).select(F.col("id").alias("i"), (F.col("id") % 7 - 3).cast("double").alias("v"))
    s = m.solve(b, 1e-2, 6)
    assert s.residuals[-1] < 0.5 * s.residuals[0]


def test_states_of_a_solver_are_dropped(spark, tmp_path):
    import os

    from latticework.operators import grid
    from latticework.tables import shared_dir

    a = grid.laplacian_coo(spark, (3, 3, 3), (1, 1, 1), (1.0, 1.0, 1.0), 1).withColumn("v", -F.col("v"))
    b = spark.range(27).select(F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("v"))
    folder = shared_dir(spark).removeprefix("file://")
    before = len(os.listdir(folder))
    s = solve.conjugate_gradient(solve.operator(a), b, 1e-8, 30)
    assert s.converged and s.iterations > 3 and len(os.listdir(folder)) - before <= 4
    assert s.x.count() == 27
