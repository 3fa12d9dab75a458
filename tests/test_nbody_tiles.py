"""All-pairs sums by tiles: few blocks whatever the size, no pair as a row, nulls as SQL has them, rows of the Stokes matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import kernels
from latticework.operators import nbody

POINTS = "id long, x double, y double, z double, q double, qx double, qy double, qz double"


def test_what_is_sent_grows_with_the_points():
    assert [nbody.blocks_of(n) for n in (1, 4096, 8193, 120_000, 720_000, 32 << 16, (32 << 16) + 1)] == [1, 1, 3, 30, 32, 32, 33]


@pytest.mark.parametrize("name", ["scalar_sum", "vector_sum", "symmetric_sum", "symmetric_vector_sum"])
def test_no_pair_is_a_row(spark, name):
    p = spark.range(50).select("id", *[F.rand(k).alias(c) for k, c in enumerate(["x", "y", "z", "q", "qx", "qy", "qz"])])
    assert "Join" not in getattr(nbody, name)(p, p)._jdf.queryExecution().optimizedPlan().toString()


def test_nulls_and_many_tiles(spark):
    rng = np.random.default_rng(8)
    rows = [[k, *map(float, rng.uniform(0, 2, 7))] for k in range(2100)]
    rows[5][1:4] = rows[9][1:4]
    rows[7][2] = rows[11][4] = rows[12][6] = None
    p = spark.createDataFrame(rows, POINTS)
    got = {r["id"]: r["v"] for r in nbody.scalar_sum(p, p, blocks=2).collect()}
    both = {(r["side"], r["id"]): r["v"] for r in nbody.symmetric_sum(p, p, blocks=2).collect()}
    vectors = {r["id"]: (r["vx"], r["vy"], r["vz"]) for r in nbody.vector_sum(p, p, kernels.stokes, blocks=2).collect()}
    x = np.array([[np.nan if c is None else c for c in r[1:4]] for r in rows])
    charged = [k for k in range(2100) if k not in (7, 11)]
    whole = [k for k in range(2100) if k not in (7, 12)]
    assert got[7] is None and vectors[7] == (None, None, None) and both["left", 7] is None
    c = 1 / (6 * math.pi * 0.25 * 0.5)
    for k in (0, 5, 9, 11, 12, 2099):
        d = x[k] - x
        r = np.sqrt((d * d).sum(1))
        inv = np.where(r == 0, 0.0, 1 / np.where(r == 0, 1.0, r))
        want = sum(inv[j] * rows[j][4] for j in charged)
        assert got[k] == pytest.approx(want) and both["left", k] == pytest.approx(want) and both["right", k] == pytest.approx(want)
        t = np.where(r == 0, c, inv * c * 0.25 * 0.75)
        e = d * inv[:, None]
        q = np.array([[0.0 if v is None else v for v in row[5:]] for row in rows])
        want = sum(t[j] * (q[j] + e[j] * (e[j] @ q[j])) for j in whole)
        assert vectors[k] == pytest.approx(tuple(want))
    none = p.where("id < 0")
    assert nbody.scalar_sum(p, none).count() == nbody.scalar_sum(none, p).count() == 0
    assert {r["v"] for r in nbody.scalar_sum(p.where("id < 3"), p.where("id = 11")).collect()} == {None}


def test_rows_of_the_stokes_matrix_are_those_of_its_entries(spark):
    rng = np.random.default_rng(9)
    p = spark.createDataFrame([(3 * k, *map(float, rng.uniform(0, 2, 7))) for k in range(40)] + [(1, *[0.5] * 7), (2, *[0.5] * 7)], POINTS)
    want = {r["i"]: (r["t"], r["w"]) for r in nbody.stokes_matrix(p).groupBy("i").agg(F.sum("v").alias("t"), F.sum(F.col("v") * F.col("j")).alias("w")).collect()}
    got = {r["i"]: (r["total"], r["weighted"]) for r in nbody.stokes_rows(p).collect()}
    assert set(got) == set(want) and len(got) == 126
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
