"""Kernel products: the thin query is over whole coordinates, blocks are few, leaves within blocks meet once."""

import numpy as np
import pytest

from latticework.functions import kernels
from latticework.operators import nbody
from latticework.plans import points, registry


def test_the_thin_query_is_over_all_coordinates(spark, tmp_path):
    rng = np.random.default_rng(6)
    vectors = [(k, [float(x) for x in rng.normal(size=8) * 0.5], 0) for k in range(200)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    x, q = np.array([np.float32(v) for _, v, _ in vectors], np.float64), np.arange(200) % 7
    a = np.exp(-((x[:, None] - x[None, :]) ** 2).sum(2) / 4.0)
    np.fill_diagonal(a, 1.01)
    got = {r["id"]: r["v"] for r in points.kernel_gauss_thin(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(200)] == pytest.approx(list(a @ q), abs=2e-6)
    sql = registry.oracle_sql()
    assert sql["kernel_gauss_thin"] == sql["kernel_gauss_mv"]


def test_leaves_within_blocks_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, q = rng.random((900, 3)) * 4, rng.normal(size=900)
    df = spark.createDataFrame([(k, [float(a) for a in p], float(w)) for k, (p, w) in enumerate(zip(x, q))], "id long, p array<double>, q double")
    a = np.exp(-((x[:, None] - x[None, :]) ** 2).sum(2) / 4.0)
    np.fill_diagonal(a, 1.1)
    monkeypatch.setattr(nbody, "FEW_BLOCKS", 4)
    for tolerance, rows in ((1e-10, 60), (1e-10, 40), (0.0, 40)):
        sent = nbody._block_pairs(df, rows, tolerance > 0)
        assert sent.count() == 4 * 900  # a point is sent for each block, not for each leaf
        got = {r["id"]: r["v"] for r in nbody.kernel_matvec(df, kernels.gauss_array(2.0), 0.1, rows=rows, tolerance=tolerance).collect()}
        assert np.allclose([got[k] for k in range(900)], a @ q, atol=1e-7)


def test_kernel_tiles_stay_in_a_cache(spark):
    """A kernel sees a megabyte at a time, whatever the blocks: larger tiles took twice the time of a pair."""
    rng = np.random.default_rng(9)
    p, q = rng.normal(size=(2600, 3)), rng.normal(size=2600)

    def kernel(r2):
        assert r2.nbytes <= 1 << 20
        return np.exp(-r2 / 4.0)

    df = spark.createDataFrame([(k, p[k].tolist(), float(q[k])) for k in range(len(p))], "id long, p array<double>, q double")
    k = np.exp(-((p[:, None] - p[None]) ** 2).sum(2) / 4.0)
    np.fill_diagonal(k, 1.01)
    got = {r["id"]: r["v"] for r in nbody.kernel_matvec(df, kernel, 0.01).collect()}
    assert np.allclose([got[i] for i in range(len(p))], k @ q, rtol=0, atol=1e-9)
