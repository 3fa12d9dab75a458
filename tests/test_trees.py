"""k-d trees, nested low-rank kernels, products by equal blocks and by tiles: against numpy, and how work is shared out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import kernels
from latticework.operators import factor, nbody, nested, sparse, trees

KERNEL = kernels.gauss_array(2.0)


def points_of(spark, p):
    return spark.createDataFrame([(int(k), [float(x) for x in row], 1.5) for k, row in enumerate(p)], "id long, p array<double>, leaf_of double").repartition(3)


def dense(p, mu):
    k = KERNEL(((p[:, None, :] - p[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(k, 1.0 + mu)
    return k


def leaves(p, axes):
    """Leaf of each point by sorting."""
    n, leaf = len(p), np.zeros(len(p), int)
    for level, axis in enumerate(axes):
        order = np.lexsort((np.arange(n), p[:, axis], leaf))
        leaf[order] = np.arange(n) * (2 << level) // n
    return leaf


@pytest.mark.parametrize("task_rows", [1, 40, 1 << 16])
def test_trees_by_ranges_and_in_tasks_agree(spark, task_rows):
    p = np.random.default_rng(2).normal(size=(173, 3))
    p[:60] = p[0]  # coincident points
    got, levels = trees.kd_tree(points_of(spark, p), leaf_rows=25, task_rows=task_rows)
    assert levels == 3
    axes = trees.axes_of(points_of(spark, p), levels)
    found = {r["id"]: r["leaf"] for r in got.collect()}
    assert [found[k] for k in range(173)] == leaves(p, axes).tolist()
    sizes = np.bincount(list(found.values()))
    assert sizes.max() - sizes.min() <= 1 and sizes.max() <= 25 and len(sizes) == 8


def test_tree_of_few_points(spark):
    tree, levels = trees.kd_tree(points_of(spark, np.zeros((3, 2))), leaf_rows=10)
    assert levels == 0 and {r["leaf"] for r in tree.collect()} == {0}
    assert trees.kd_tree(points_of(spark, np.zeros((0, 2))), leaf_rows=10)[0].count() == 0


def test_axes_follow_the_longest_side(spark):
    p = np.random.default_rng(0).uniform(size=(50, 2)) * [8.0, 1.5]
    assert trees.axes_of(points_of(spark, p), 4) == [0, 0, 0, 1]


def test_row_skeletons_interpolate():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 80))
    rows, w = nested.row_skeleton(a, 1e-12)
    assert len(rows) == 6 and np.abs(w @ a[rows] - a).max() < 1e-10
    assert np.abs(w[rows] - np.eye(6)).max() < 1e-10


@pytest.mark.parametrize("n", [10, 300])
def test_nested_products_and_solves(spark, n):
    p = np.random.default_rng(3).normal(size=(n, 3)) * 0.3
    k = nested.nested_kernel(points_of(spark, p), KERNEL, 0.1, leaf_rows=40, tolerance=1e-10, proxies=150, audits=50)
    x = np.random.default_rng(4).normal(size=n)
    vector = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    got = {r["i"]: r["v"] for r in k.apply(vector).collect()}
    exact = dense(p, 0.1)
    assert max(abs(got[i] - v) for i, v in enumerate(exact @ x)) < 1e-7
    kept = k.storage().agg(F.sum("compressed"), F.sum("stored"), F.sum("nodes")).first()
    if n == 300:
        assert kept[0] > 4 and kept[2] == 15 and k.error <= 1e-7
    solved = {r["i"]: r["v"] for r in k.inverse().apply(vector).collect()}
    assert np.abs(exact @ [solved[i] for i in range(n)] - x).max() < 1e-5


def test_thin_blocks_are_counted(spark):
    p = np.random.default_rng(3).normal(size=(300, 3)) * 0.3
    points = points_of(spark, p).withColumn("q", F.col("id").cast("double"))
    got = {r["id"]: r for r in nbody.kernel_matvec(points, KERNEL, 0.1, rows=80, tolerance=1e-6).collect()}
    assert max(abs(got[i]["v"] - v) for i, v in enumerate(dense(p, 0.1) @ np.arange(300.0))) < 0.3
    assert sum(r["thin"] > 0 for r in got.values()) > 150
    assert {r["thin"] for r in nbody.kernel_matvec(points, KERNEL, 0.1, rows=80).collect()} == {0}


def skewed(spark, n=3000):
    """A third of all entries in row 5, a third in column 9, one coordinate repeated often."""
    rng = np.random.default_rng(8)
    i, j, v = rng.integers(0, 400, n), rng.integers(0, 300, n), rng.integers(1, 9, n).astype(float)
    i[: n // 3], j[n // 3 : 2 * n // 3] = 5, 9
    i[-100:], j[-100:] = 7, 7
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(i, j, v)], "i long, j long, v double").repartition(4), i, j, v


def test_products_by_equal_blocks(spark):
    a, i, j, v = skewed(spark)
    x = np.random.default_rng(1).integers(1, 9, 300).astype(float)
    blocked = sparse.blocked(a, 16).cache()
    sizes = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1  # however long row 5 is
    spans = blocked.groupBy("block").agg(F.min("i"), F.max("i")).orderBy("block").collect()
    assert all(b[1] >= a[2] for a, b in zip(spans, spans[1:]))  # in row order
    want = np.zeros(400)
    np.add.at(want, i, v * x[j])
    got = sparse.spmv_blocked(blocked, spark.createDataFrame([(k, float(y)) for k, y in enumerate(x)], "i long, v double"))
    assert {r["i"]: r["v"] for r in got.collect()} == {k: y for k, y in enumerate(want) if k in set(i.tolist())}


@pytest.mark.parametrize("bound", [40, 1 << 13])
def test_products_by_tiles(spark, bound):
    a, i, j, v = skewed(spark)
    dense_a = np.zeros((400, 300))
    np.add.at(dense_a, (i, j), v)
    for got, want in ((sparse.gram(a, bound), dense_a.T @ dense_a), (sparse.matmul(a, a, bound), dense_a[:, :300] @ dense_a[:300])):
        found = {(r["i"], r["j"]): r["v"] for r in got.collect()}
        assert all(want[k] == y for k, y in found.items())
        assert np.count_nonzero(want) == len(found)


def test_tiles_share_out_a_heavy_index(spark):
    a, i, *_ = skewed(spark)
    side = a.select(F.col("i").alias("k"), F.col("j").alias("at"), "v")
    heavy = a.groupBy(F.col("i").alias("_k")).agg(F.count("v").alias("ta")).withColumn("tb", F.col("ta")).where("ta > 100")
    dealt = sparse._dealt(side, heavy, "ta", "tb", 100)
    most = dealt.groupBy("k", "ta", "tb").count().agg(F.max("count")).first()[0]
    assert most < 200 < (i == 5).sum()  # tiles of about 100, where the index has a third of all entries


@pytest.mark.parametrize("rows,block", [(2000, 64), (300, 1024), (7, 3)])
def test_orthogonal_factor_by_a_tree(spark, rows, block):
    """Condition 1e14, where A R^-1 loses three digits in a thousand: Q'Q is the identity to rounding."""
    rng = np.random.default_rng(6)
    u, _ = np.linalg.qr(rng.normal(size=(rows, 12)))
    v, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    k = u.shape[1]
    a = (u * np.logspace(0, -14, k)) @ v[:k]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "i long, v array<double>").repartition(5)
    q, r = factor.tall_qr(df, block=block, fan=3)
    found = {x["i"]: x["v"] for x in q.collect()}
    q = np.array([found[i] for i in range(rows)])
    assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-13
    assert np.abs(q @ r - a).max() < 1e-14 and (np.diag(r) >= 0).all() and np.abs(np.tril(r, -1)).max() == 0
